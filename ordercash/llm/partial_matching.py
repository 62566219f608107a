"""Prediction by partial matching over bytes, trained on the corpus.

A text is its words and one end; white space only separates, and A-Z count as a-z. A blank, its
words with a blank behind each, and the end are predicted byte after byte, but for the first blank,
from the bytes before: at most ``order`` of them, back to the text's first, across blanks. The longest
context is tried first, first among
texts of the same alphabet, then among all; a symbol not seen there is reached by an escape to the
context one byte shorter, where the symbols just excluded no longer count. Escapes follow method D:
with counts c that sum to T over d symbols, a symbol has (2c - 1) / 2T and the escape d / 2T. Below
the empty context all symbols left are alike. A text's alphabet, its most frequent character beyond
ASCII, is stated ahead of it and paid for.

The trie is a table of any size, cut into bins by the last three bytes of the context, so that a context
and all longer ones that end in it lie together down to three bytes; what is shorter is small (at most
65,793 contexts) and goes to every task. Neither the driver nor a worker holds the trie.

1. Tasks write the texts in chunks to the shared folder and give each chunk's distinct contexts and symbols
   with their counts, packed in one row for each bin and alphabet, its alphabets, and its distinct words with
   their counts, packed by a hash of the word.
2. The chunks' rows of a bin are summed, by teams of chunks and then all: the trie, and a lexicon.
3. Each bin of the trie meets the chunks' rows of the bin, team by team, and gives the probability of each
   context and symbol there, all steps of escape and exclusion in one pass.
4. Probabilities and words' counts return to the chunks, whose texts are read again, and are summed by text.

Chunks are what tasks read one after the other, so rows that repeat fall into as many chunks as others.
Nulls: a null text is the empty one, just an end; a null id is learnt from. Equal rows count each.
An empty table gives no rows; with nothing to learn from, every symbol has one chance in 257.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercash.llm.common import crc_of_id, fresh_path, give_back, lean, ship, small_batches, written

ship(__name__)

ORDER = 5
REACH = 6  # the longest order: a context is packed into one number
LENGTH = 48  # its length lies above this many bits of its bytes
#: The end of a text, a byte that UTF-8 never has.
END = b"\xff"
SYMBOLS = 257  # 256 bytes and the end, which is written as a byte that UTF-8 never has
HELD_OUT, FOLDS = 2, 7
SHORT = 2  # contexts up to this length are everywhere, longer ones lie in a bin
#: Rows of a chunk that are in no bin: alphabets, short contexts. In a bin, words have this alphabet.
ALPHABETS, SHORTS, WORDS = -2, -3, -1
MOST_BINS = 4096
PACKED = "chunk long, bin int, z int, keys binary, counts binary, n long"
_BEYOND = re.compile("[^\x00-\x7f]")


def alphabet(text: str) -> int:
    """The most frequent character beyond ASCII, the lowest of equals; 0 if there is none."""
    if text.isascii():
        return 0
    seen = Counter(_BEYOND.findall(text))
    most = max(seen.values())
    return min(ord(c) for c, n in seen.items() if n == most)


def words_of(text: str | None) -> tuple[int, list[bytes]]:
    text = text if isinstance(text, str) else ""
    return alphabet(text), [*text.encode("utf-8", "replace").lower().split(), END]


class Word(bytes):
    """A word of a text; ``before`` is what stands ahead of it, as far back as a context reaches."""

    before = b" "


def tokens(text: str | None) -> tuple[int, list[Word]]:
    z, words = words_of(text)
    before, out = Word.before, []
    for w in map(Word, words):
        w.before = before
        before = (before + w + b" ")[-REACH:]
        out.append(w)
    return z, out


def positions(word: Word, order: int = ORDER) -> Iterator[tuple[bytes, bytes]]:
    """Longest context and symbol of each byte of a word."""
    whole = word.before + word + (b"" if word == END else b" ")
    for i in range(len(word.before), len(whole)):
        yield whole[max(0, i - order) : i], whole[i : i + 1]


def packed(context: bytes) -> int:
    """A context as one number: its length above its bytes, the latest byte lowest."""
    return len(context) << LENGTH | int.from_bytes(context, "big")


def _whole(words: list[bytes]) -> bytes:
    """A text as it is predicted: a blank ahead of each word and of the end. A word is an object of some fifty
    bytes, so the texts of a chunk are held like this, and their words told in arrays."""
    return b" " + b" ".join(words)


def _told_words(texts: Sequence[bytes], step: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of whole texts, the place in them of each word, and the place where each text begins;
    the words are found for texts of ``step`` bytes at a time, or a longer one."""
    ends = np.cumsum([len(t) for t in texts])
    slices, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, side="right")))
        raw = np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8)
        blanks = np.flatnonzero(raw == ord(" "))
        offsets = np.append(blanks - np.arange(len(blanks)), len(raw) - len(blanks)).astype(np.int32)
        letters = raw[raw != ord(" ")]
        slices.append(pa.BinaryArray.from_buffers(
            pa.binary(), len(blanks), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
        ))
        lo = hi
    told = pa.chunked_array(slices).dictionary_encode().chunks  # all with the same distinct words
    first = np.cumsum([0] + [t.count(b" ") for t in texts[:-1]])
    return told[0].dictionary.to_pylist(), np.concatenate([c.indices.to_numpy() for c in told]), first


def _keys(texts: list[bytes] | list[list[bytes]], order: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed context and symbol of the bytes of all texts, whole or as words, as ``context * 256 + symbol``,
    and the number of the text of each, for ``step`` bytes at a time."""
    whole = [t if isinstance(t, bytes) else _whole(t) for t in texts]
    starts = np.cumsum([0] + [len(t) for t in whole[:-1]])
    raw = np.frombuffer(b"".join([bytes(order), *whole]), dtype=np.uint8)
    del whole
    masks = np.array([_mask(k) for k in range(order + 1)], dtype=np.int64)
    for lo in range(order, len(raw), step):
        hi = min(lo + step, len(raw))
        # The texts that reach into the step, and how many of its bytes are each one's.
        first, last = np.searchsorted(starts, [lo - order, hi - order - 1], side="right") - 1
        here = starts[first : last + 1]
        bytes_of = np.diff(np.concatenate([[lo - order], here[1:], [hi - order]]))
        depth = np.arange(lo - order, hi - order) - np.repeat(here, bytes_of)
        length = np.minimum(depth, order)
        near = raw[lo - order : hi].astype(np.int64)
        context = np.zeros(hi - lo, dtype=np.int64)
        for k in range(1, order + 1):
            context |= near[order - k : len(near) - k] << (8 * (k - 1))
        context &= masks[length]  # what is ahead of a text is none of its context
        context |= length << LENGTH
        predicted = depth > 0
        yield (context << 8 | near[order:])[predicted], np.repeat(np.arange(first, last + 1), bytes_of)[predicted]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of n for each."""
    by = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[by], prepend=-1))
    return keys[by][first], np.add.reduceat(n[by], first)


def _by_alphabet(texts: pa.ChunkedArray) -> dict[int, list[tuple[int, bytes]]]:
    """Place of the texts of each alphabet, and the texts whole."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    for i, text in enumerate(texts):
        z, words = words_of(text.as_py())
        out.setdefault(z, []).append((i, _whole(words)))
    return out


def _distinct(texts: list[tuple[int, bytes]], held: np.ndarray, order: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed contexts and symbols of texts in order, and their counts in those learnt from."""
    none = np.zeros(0, dtype=np.int64)
    parts, size, kept = [(none, none)], 0, 0
    for learnt in (True, False):
        some = [text for i, text in texts if held[i] != learnt]
        for key, _ in _keys(some, order, step) if some else ():
            key, n = np.unique(key, return_counts=True)
            parts.append((key, n if learnt else np.zeros_like(n)))
            size += len(key)
            if size > max(1 << 20, 2 * kept):
                parts = [_summed(*map(np.concatenate, zip(*parts, strict=True)))]
                size = kept = len(parts[0][0])
    return _summed(*map(np.concatenate, zip(*parts, strict=True)))


def _mask(k: int) -> int:
    return (1 << 8 * k) - 1


def _cut(keys: np.ndarray, k: int) -> np.ndarray:
    """Packed contexts and symbols, with the context's last k bytes."""
    return (k << LENGTH | keys >> 8 & _mask(k)) << 8 | keys & 255


def _bin(keys: np.ndarray, bins: int) -> np.ndarray:
    last = keys >> 8 & _mask(SHORT + 1)
    return ((last * 0x9E3779B1 & 0xFFFFFFFF) >> 8) % bins


def _squeeze(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loosen(data: bytes, dtype) -> np.ndarray:
    n, kind = int.from_bytes(data[:8], "little"), np.dtype(dtype)
    raw = pa.decompress(data[8:], n * kind.itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=0))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_loosen(data, np.int64))


def _pack_words(words: list[bytes]) -> bytes:
    raw = b" ".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_words(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b" ")


def _by_bin(place: np.ndarray) -> dict[int, np.ndarray]:
    """Where what is in each bin stands, in one pass however many bins there are."""
    by = np.argsort(place.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(place[by], prepend=-1))
    return dict(zip(place[by[first]].tolist(), np.split(by, first)[1:], strict=True))


def _word_bins(words: list[bytes], bins: int) -> dict[int, np.ndarray]:
    """Where the words of each bin stand, in the words' order."""
    order = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)
    place = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % bins
    return {b: order[at] for b, at in _by_bin(place[order]).items()}


def _pack_values(values: np.ndarray) -> bytes:
    """Floats of which many are equal."""
    told, at = np.unique(values, return_inverse=True)
    first = _squeeze(told)
    return len(first).to_bytes(8, "little") + first + _squeeze(at.astype(np.uint32))


def _unpack_values(data: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(data[:8], "little")
    return _loosen(data[8:end], np.float64)[_loosen(data[end:], np.uint32)]


def _write_chunks(folder: str, order: int, step: int, bins: int, chunk_bytes: int):
    def chunk_rows(held_texts: pa.Table) -> pa.RecordBatch:
        from pyarrow import fs, parquet

        chunk = uuid.uuid4().int >> 65
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        parquet.write_table(held_texts, f"{root}/{chunk}.parquet", filesystem=store)
        held = held_texts.column("held_out").to_numpy()
        by_alphabet = _by_alphabet(held_texts.column("text"))
        del held_texts
        rows, short = [], []
        at, texts = zip(*(t for some in by_alphabet.values() for t in some), strict=True)
        words, place, first = _told_words(texts, step)
        learnt = np.repeat(~held[list(at)], np.diff(first, append=len(place)))
        n = np.bincount(place[learnt], minlength=len(words)).astype(np.uint32)
        for b, at in _word_bins(words, bins).items():
            rows.append((b, WORDS, _pack_words([words[i] for i in at.tolist()]), _squeeze(n[at]), 0))
        del at, texts, words, place, first, learnt
        for z, texts in by_alphabet.items():
            key, n = _distinct(texts, held, order, step)
            short.append((np.where(key >> LENGTH + 8 > SHORT, _cut(key, SHORT), key), n))
            for b, at in _by_bin(_bin(key, bins)).items():
                rows.append((b, z, _pack_keys(key[at]), _squeeze(n[at].astype(np.uint32)), 0))
            rows.append((ALPHABETS, z, b"", b"", sum(not held[i] for i, _ in texts)))
        key, n = _summed(*map(np.concatenate, zip(*short, strict=True)))
        rows.append((SHORTS, 0, _pack_keys(key), _squeeze(n), 0))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        names = [c.split()[0] for c in PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), *columns], names=names)

    @lean
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lo = 0
            lengths = np.cumsum(pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy() + 1)
            while lo < batch.num_rows:
                # Rows up to the one that fills the chunk.
                before = lengths[lo - 1] if lo else 0
                hi = min(int(np.searchsorted(lengths, before + chunk_bytes - size)) + 1, batch.num_rows)
                held.append(batch.slice(lo, hi - lo))
                size += int(lengths[hi - 1] - before)
                lo = hi
                if size >= chunk_bytes:
                    chunk, held, size = pa.Table.from_batches(held), [], 0
                    yield chunk_rows(chunk)
                    del chunk
                    give_back()
        if held:
            yield chunk_rows(pa.Table.from_batches(held))

    return write


def _sum_words(rows: pd.DataFrame, kind) -> tuple[list[bytes], np.ndarray]:
    total: Counter = Counter()
    for data, counts in zip(rows["keys"], rows["counts"], strict=True):
        for w, n in zip(_unpack_words(data), _loosen(counts, kind).tolist(), strict=True):
            if n:
                total[w] += n
    words = sorted(total)
    return words, np.array([total[w] for w in words], dtype=np.int64)


def _sum_bin(first: bool):
    def summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The rows of a bin summed, one for each alphabet, without what is only held out."""
        give_back()
        out = []
        kind = np.uint32 if first and key[0] != SHORTS else np.int64
        for z, some in rows.groupby("z"):
            if z == WORDS:
                words, n = _sum_words(some, kind)
                if words:
                    out.append((key[0], z, _pack_words(words), _squeeze(n), int(n.sum()), len(words)))
                continue
            keys = np.concatenate([_unpack_keys(k) for k in some["keys"]])
            n = np.concatenate([_loosen(c, kind) for c in some["counts"]]).astype(np.int64)
            keys, n = _summed(keys, n)
            keys, n = keys[n > 0], n[n > 0]
            out.append((key[0], z, _pack_keys(keys), _squeeze(n), 0, 0))
        return pd.DataFrame(out, columns=["bin", "z", "keys", "counts", "total", "words"])

    return summed


class Level:
    """Contexts of one length with their symbols: counts, their sum ``t`` and number ``d`` by context."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        self.first = np.flatnonzero(np.diff(keys >> 8, prepend=-1))
        self.contexts = keys[self.first] >> 8
        self.t = np.add.reduceat(n, self.first) if len(n) else n
        self.d = np.diff(np.append(self.first, len(keys)))
        self.rest_t, self.rest_d = np.zeros_like(self.t), np.zeros_like(self.d)

    def under(self, parent: Level, k: int) -> Level:
        """Tell what is left in the parents, whose contexts are the last k bytes, once these symbols are excluded."""
        if len(self.keys):
            common = np.add.reduceat(parent.count(_cut(self.keys, k)), self.first)
            at = parent.find(k << LENGTH | self.contexts & _mask(k))
            self.rest_t, self.rest_d = parent.t[at] - common, parent.d[at] - self.d
        return self

    def find(self, contexts: np.ndarray) -> np.ndarray:
        """Places of contexts, -1 where there is none."""
        if not len(self.contexts):
            return np.full(len(contexts), -1)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[at] == contexts, at, -1)

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], 0)


def all_levels(keys: np.ndarray, n: np.ndarray, short_keys: np.ndarray, short_n: np.ndarray, order: int) -> list[Level]:
    """Levels 0 to ``order`` over all alphabets, from the longest contexts of a bin and the short ones of all."""
    levels: list[Level] = []
    for k in range(order + 1):
        held, m = (short_keys, short_n) if k <= SHORT else (keys, n)
        long = held >> LENGTH + 8 >= k
        level = Level(*_summed(_cut(held[long], k), m[long]))
        levels.append(level.under(levels[-1], k - 1) if k else level)
    return levels


def log_probabilities(wanted: np.ndarray, keys: np.ndarray, n: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of packed contexts and symbols of an alphabet, whose own counts are ``keys`` and ``n``."""
    out = np.zeros(len(wanted))
    lengths, own = wanted >> LENGTH + 8, keys >> LENGTH + 8
    for length in np.unique(lengths):
        at = lengths == length
        mine = own == length
        first = Level(keys[mine], n[mine]).under(levels[length], int(length))
        out[at] = _walk(wanted[at], first, levels[: int(length) + 1])
    return out


def _walk(wanted: np.ndarray, first: Level, levels: list[Level]) -> np.ndarray:
    """Down from the alphabet's own context over all shorter ones until the symbol is met."""
    p = np.zeros(len(wanted))
    going, begun = np.ones(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=bool)
    t, d = np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=np.int64)
    chain = [(len(levels) - 1, first), *((k, levels[k]) for k in range(len(levels) - 1, -1, -1))]
    for k, level in chain:
        if not len(level.keys):
            continue
        keys = _cut(wanted, k)
        at = level.find(keys >> 8)
        there = going & (at >= 0)
        # What a context met before has excluded is gone; the first one met is whole.
        t, d = np.where(begun, t, level.t[at]), np.where(begun, d, level.d[at])
        c = level.count(keys)
        hit, miss = there & (c > 0), there & (c == 0)
        p[hit] += np.log10((2 * c[hit] - 1) / (2 * t[hit]))
        paid = miss & (d > 0)
        p[paid] += np.log10(d[paid] / (2 * t[paid]))
        t, d = np.where(there, level.rest_t[at], t), np.where(there, level.rest_d[at], d)
        begun |= there
        going &= ~hit
    left = SYMBOLS - (len(levels[0].keys) if levels else 0)
    p[going] -= np.log10(left)
    return p


def _look_up(order: int, short_keys: np.ndarray, short_n: np.ndarray):
    def look_up(chunks: pd.DataFrame, trie: pd.DataFrame) -> pd.DataFrame:
        """Probabilities of the chunks' rows of a bin, packed in the order of their keys."""
        give_back()
        known, lexicon = {}, {}
        for z, k, c in zip(trie["z"], trie["keys"], trie["counts"], strict=True):
            n = _loosen(c, np.int64)
            if z == WORDS:
                lexicon = dict(zip(_unpack_words(k), n.tolist(), strict=True))
            else:
                known[z] = (_unpack_keys(k), n)
        none = np.zeros(0, dtype=np.int64)
        every = _summed(*map(np.concatenate, zip((none, none), *known.values(), strict=True)))
        levels = all_levels(*every, short_keys, short_n, order)
        out = []
        for z, some in chunks.groupby("z"):
            if z == WORDS:
                for chunk, b, k in zip(some["chunk"], some["bin"], some["keys"], strict=True):
                    n = np.array([lexicon.get(w, 0) for w in _unpack_words(k)], dtype=np.float64)
                    out.append((chunk, b, z, _pack_values(n)))
                continue
            held = [_unpack_keys(k) for k in some["keys"]]
            wanted, at = np.unique(np.concatenate(held), return_inverse=True)
            p = log_probabilities(wanted, *known.get(z, (none, none)), levels)[at]
            for chunk, b, part in zip(some["chunk"], some["bin"], np.split(p, np.cumsum([len(k) for k in held])[:-1]), strict=True):
                out.append((chunk, b, z, _pack_values(part)))
        return pd.DataFrame(out, columns=["chunk", "bin", "z", "values"])

    return look_up


def _score_chunk(folder: str, total: int, distinct: int, order: int, step: int, bins: int):
    def score(key: tuple, told: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs, parquet

        give_back()
        store, root = fs.FileSystem.from_uri(folder)
        rows = parquet.read_table(f"{root}/{key[0]}.parquet", filesystem=store)
        held, by_alphabet = rows.column("held_out").to_numpy(), _by_alphabet(rows.column("text"))
        rows = rows.drop_columns("text")
        kind = told["bin"].to_numpy()
        alike = told[kind == ALPHABETS]
        stated = dict(zip(alike["z"], alike["value"], strict=True))
        packed = {(z, b): v for z, b, v in told.loc[kind >= 0, ["z", "bin", "values"]].itertuples(index=False)}
        codes, base = np.zeros(len(held)), np.zeros(len(held))
        sizes, seen = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        at, texts = zip(*(t for some in by_alphabet.values() for t in some), strict=True)
        at = list(at)
        words, place, first = _told_words(texts, step)
        n = np.zeros(len(words))
        for b, told_of in _word_bins(words, bins).items():
            n[told_of] = _unpack_values(packed[WORDS, b])
        sizes[at] = np.diff(first, append=len(place))
        seen[at] = np.add.reduceat((n > 0).astype(np.int64)[place], first)
        base[at] = np.add.reduceat(np.log10((n + 1) / (total + distinct + 1))[place], first)
        del at, texts, words, place, first, n
        for z, some in by_alphabet.items():
            here, _ = _distinct(some, held, order, step)
            p = np.zeros(len(here))
            for b, there in _by_bin(_bin(here, bins)).items():
                p[there] = _unpack_values(packed[z, b])
            code = np.full(len(some), stated[z])
            # Each context and symbol of the texts is known once.
            for wanted, text in _keys([text for _, text in some], order, step):
                wanted, at = np.unique(wanted, return_inverse=True)
                code += np.bincount(text, weights=p[np.searchsorted(here, wanted)][at], minlength=len(some))
            codes[[i for i, _ in some]] = code
        return pd.DataFrame({
            "doc_id": rows.column("doc_id").to_pandas().astype("Int64"), "held_out": held, "n_tokens": sizes,
            "n_known": seen, "train_tokens": total, "base_score": base, "score": codes,
        })

    return score


def scores(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    order: int = ORDER,
    chunk_bytes: int = 16 << 20,
    bucket_words: int = 20_000,
    bin_bytes: int = 16 << 20,
) -> DataFrame:
    """One row a document, learnt from those whose crc32 of the id mod 7 is not 2.

    ``chunk_bytes`` of text are worked on at once, and ``bin_bytes`` of text (a share of each chunk's) make
    a bin of the trie, or, where there are ``MOST_BINS``, a team in it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"),
        (F.pmod(crc_of_id(id_column), F.lit(FOLDS)) == HELD_OUT).alias("held_out"),
    )
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bins = min(MOST_BINS, max(1, -(-size // bin_bytes)))
    teams = max(1, -(-size // (bins * bin_bytes)))
    step = 8 * bucket_words
    folder = fresh_path(spark, "texts")
    used = written(rows.mapInArrow(_write_chunks(folder, order, step, bins, chunk_bytes), PACKED), "used")
    of_alphabets = used.filter(F.col("bin") == ALPHABETS)
    packed = used.filter(F.col("bin") != ALPHABETS).select(
        "chunk", "bin", "z", "keys", "counts", F.pmod("chunk", F.lit(teams)).alias("team")
    )
    summed = "bin int, z int, keys binary, counts binary, total long, words long"
    sums = packed.groupBy("bin", "team").applyInPandas(_sum_bin(True), summed)
    if teams > 1:
        sums = sums.groupBy("bin").applyInPandas(_sum_bin(False), summed)
    trie = written(sums, "trie")
    lexicon = trie.agg(F.sum("total").alias("n"), F.sum("words").alias("v")).first()
    total, distinct = lexicon["n"] or 0, lexicon["v"] or 0
    # At most 257 symbols in each of the contexts of at most two bytes.
    short = trie.filter(F.col("bin") == SHORTS).first()
    none = np.zeros(0, dtype=np.int64)
    short_keys, short_n = (_unpack_keys(short["keys"]), _loosen(short["counts"], np.int64)) if short else (none, none)
    team = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(teams - 1).cast("long")))
    everywhere = trie.filter("bin >= 0").withColumn("team", team)
    known = written(
        packed.filter("bin >= 0").groupBy("bin", "team").cogroup(everywhere.groupBy("bin", "team")).applyInPandas(
            _look_up(order, short_keys, short_n), "chunk long, bin int, z int, values binary"
        ),
        "probabilities",
    )
    # What stating an alphabet costs.
    alphabets = of_alphabets.groupBy("z").agg(F.sum("n").alias("n"))
    all_texts = alphabets.agg(F.sum("n").alias("s"), F.count("*").alias("k"))
    stated = written(
        alphabets.select(
            "z",
            F.log10((F.col("n") + 1) / (all_texts.select("s").scalar() + all_texts.select("k").scalar() + 1)).alias("value"),
        ),
        "stated",
    )
    told = known.withColumn("value", F.lit(None).cast("double")).unionByName(
        of_alphabets.join(stated, "z").select("chunk", "bin", "z", "value", F.lit(None).cast("binary").alias("values"))
    )
    return told.groupBy("chunk").applyInPandas(
        _score_chunk(folder, total, distinct, order, step, bins),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
