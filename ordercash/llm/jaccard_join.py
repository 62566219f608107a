"""N-gram Jaccard self-join by MinHash banding, with verification on full n-gram sets.

1. Each text becomes its set of n-grams of words (64-bit hashes of five words in a row; a shorter
   text with words is one n-gram). Texts of equal sets are one class and travel once.
2. Rows a band are as many as keep most pairs well below the threshold apart, and bands as many as
   reach ``recall`` for a pair right at the threshold. Classes shuffle on band hashes.
3. A bucket of many classes is dealt into blocks, and every pair of blocks is one task's work; so
   a bucket of any size is split, at the price of its rows being repeated once per block. A pair
   that also shares an earlier band is left to that band. Rows without a pair to verify go.
4. The n-gram sets of the others are joined in, and each pair of blocks counts the exact overlaps.
   It returns a count of links for each class and a spanning forest, never the pairs.
5. Components of the forests are found by passing the smallest label along and jumping; each round
   is written to the shared folder.

The result has one row a document: its class, the group of all it is linked to directly or through
others, and how many documents and how many other classes it is linked to.

Nulls: a null text has no n-grams, as an empty one; such documents are linked to nothing and each is
a group by itself. A null id is carried and never chosen as a group's id while another is there.
Equal rows are documents of one class. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordercash.llm.common import give_back, lean, ship, spread, written

ship(__name__)

NGRAM = 5
THRESHOLD = 0.8


def bands_for(threshold: float, recall: float, rows: int = 4) -> tuple[int, int]:
    """Bands of ``rows`` rows such that a pair at the threshold shares one with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


class Hasher:
    """N-gram sets and band hashes of texts."""

    def __init__(self, n: int, bands: int, rows: int, seed: int = 1):
        import xxhash

        self.word = xxhash.xxh64_intdigest
        self.n, self.bands, self.rows = n, bands, rows
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, size=bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(1, 2**63, size=bands * rows, dtype=np.uint64)
        self.known: dict[bytes, int] = {}

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def ngrams(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's n-grams."""
        ws = (text or "").encode("utf-8", "replace").split()
        if not ws:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > 100_000:
            self.known.clear()
        known, word = self.known, self.word
        ids = [known.get(w) or known.setdefault(w, word(w)) for w in ws]
        h = np.array(ids, dtype=np.uint64)
        if len(h) < self.n:
            h = np.concatenate([h, np.full(self.n - len(h), len(h), dtype=np.uint64)])
        m = len(h) - self.n + 1
        out = np.zeros(m, dtype=np.uint64)
        for k in range(self.n):
            out = self.mix(out + h[k : k + m] + np.uint64(k + 1))
        return np.unique(out)

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(grams), 4096):
            part = grams[at : at + 4096, None] * self.a + self.b
            least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
        out = np.zeros(self.bands, dtype=np.uint64)
        for row in least.reshape(self.bands, self.rows).T:
            out = self.mix(out ^ row)
        return out.view(np.int64)


def signatures(docs: DataFrame, id_column: str, text_column: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, ``set`` (hash of the whole n-gram set, null if that is empty), n_grams, bands."""
    schema = T.StructType([
        T.StructField("set", T.BinaryType()), T.StructField("n_grams", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    @F.pandas_udf(schema)
    @lean
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(n, bands, rows)
        for texts in batches:
            out = []
            for text in texts:
                grams = hasher.ngrams(text)
                out.append((
                    _digest(grams), len(grams), hasher.band_hashes(grams) if len(grams) else None
                ))
            yield pd.DataFrame(out, columns=["set", "n_grams", "bands"])

    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), sign(F.col(text_column)).alias("s")
    ).select("doc_id", "s.*")


def _new_pairs(bands: np.ndarray, other: np.ndarray, band: int, same: bool) -> np.ndarray:
    """Which pairs of two blocks of a bucket share no band before this one."""
    new = np.ones((len(bands), len(other)), dtype=bool)
    for k in range(band):
        new &= bands[:, k][:, None] != other[:, k][None, :]
    if same:
        new &= np.tri(len(bands), k=-1, dtype=bool).T
    return new


def _tasks(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Band and the rows' places of both blocks, for every pair of blocks in ``rows``; a block
    with itself is given twice."""
    columns = [rows[c].to_numpy(np.int64) for c in ("j", "i", "hash", "band")]
    order = np.lexsort(columns)
    ordered = np.stack([c[order] for c in columns])
    cuts = np.flatnonzero((ordered[:, 1:] != ordered[:, :-1]).any(axis=0)) + 1
    block, (j, i, _, band) = rows["block"].to_numpy(np.int64), columns
    for at in np.split(order, cuts) if len(order) else []:
        one = at[0]
        if i[one] == j[one]:
            yield int(band[one]), at, at, True
        else:
            yield int(band[one]), at[block[at] == i[one]], at[block[at] == j[one]], False


def _band_matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["bands"].tolist(), dtype=np.int64).reshape(len(rows), -1)


def _open(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows that have a pair to verify in their pair of blocks."""
    bands, keep = _band_matrix(rows), []
    for band, left, right, same in _tasks(rows):
        new = _new_pairs(bands[left], bands[right], band, same)
        if same:
            keep.append(left[new.any(axis=1) | new.any(axis=0)])
        else:
            keep += [left[new.any(axis=1)], right[new.any(axis=0)]]
    return rows.iloc[np.concatenate(keep)].drop(columns="part")


def _verifier(threshold: float):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        give_back()  # what the group before took
        bands, copies = _band_matrix(rows), rows["copies"].to_numpy(np.int64)
        sets, grams = rows["set"].to_numpy(), rows["grams"].to_numpy()
        out = []
        for band, left, right, same in _tasks(rows):
            if not len(left) or not len(right):
                continue
            linked = _new_pairs(bands[left], bands[right], band, same)
            linked &= _similar([grams[k] for k in left], [grams[k] for k in right], linked, threshold)
            if not linked.any():
                continue
            texts = [linked.sum(axis=1), linked.sum(axis=0)]
            links = [linked @ copies[right], copies[left] @ linked]
            if same:
                texts, links = [texts[0] + texts[1]], [links[0] + links[1]]
            here = sets[left if same else np.concatenate([left, right])]
            to = _forest(linked, same)
            texts, links = np.concatenate(texts), np.concatenate(links)
            some = np.flatnonzero(texts)
            out += zip(here[some], links[some], texts[some], here[to[some]], strict=True)
        return pd.DataFrame(out, columns=["set", "links", "texts", "to"])

    return verify


def _similar(left: list, right: list, wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Exact Jaccard at the threshold, for the wanted pairs, by sorted n-gram columns."""
    out = np.zeros_like(wanted)
    if not wanted.any():
        return out
    a = [np.asarray(g, dtype=np.int64) for g in left]
    b = [np.asarray(g, dtype=np.int64) for g in right]
    na, nb = np.array([len(g) for g in a]), np.array([len(g) for g in b])
    if wanted.sum() <= 4 * (len(a) + len(b)):
        for i, j in zip(*np.nonzero(wanted), strict=True):
            if min(na[i], nb[j]) >= threshold * max(na[i], nb[j]):
                common = len(np.intersect1d(a[i], b[j], assume_unique=True))
                out[i, j] = common >= threshold * (na[i] + nb[j] - common) - 1e-9
        return out
    # Many pairs: n-grams as columns of 0/1 matrices, a slice of columns at a time.
    names, columns = np.unique(np.concatenate(a + b), return_inverse=True)
    rows = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]))
    common = np.zeros(wanted.shape, dtype=np.float32)
    order = np.argsort(columns, kind="stable")
    columns, rows = columns[order], rows[order]
    step = 8_192
    for at in range(0, len(names), step):
        lo, hi = np.searchsorted(columns, (at, at + step))
        ones = np.zeros((len(a) + len(b), min(step, len(names) - at)), dtype=np.float32)
        ones[rows[lo:hi], columns[lo:hi] - at] = 1
        common += ones[: len(a)] @ ones[len(a) :].T
    return wanted & (common >= threshold * (na[:, None] + nb[None, :] - common) - 1e-6)


def _forest(linked: np.ndarray, same: bool) -> np.ndarray:
    """For each row (left ones, then right ones unless the same) the first row of its component."""
    n = linked.shape[0] + (0 if same else linked.shape[1])
    i, j = np.nonzero(linked)
    j = j if same else j + linked.shape[0]
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _digest(grams: np.ndarray) -> bytes | None:
    """Hash of a whole n-gram set, None for an empty one."""
    import hashlib

    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _gram_sets(n: int):
    @lean
    def gram_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(n, 1, 1)
        for batch in batches:
            for at in range(0, len(batch), 256):  # sets are larger than texts; few at a time
                found = [hasher.ngrams(t) for t in batch["text"].iloc[at : at + 256]]
                yield pd.DataFrame({
                    "set": [_digest(g) for g in found], "grams": [g.view(np.int64) for g in found],
                })

    return gram_sets


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(set, root) for every end of ``edges`` (set, to): the smallest end of its component.

    Rounds of: each end takes the smallest label among its neighbours', then the label's own label.
    A round is written before the next; there are as many as the logarithm of the longest path.
    """
    both = written(edges.unionAll(edges.select(F.col("to").alias("set"), F.col("set").alias("to"))), "edges")
    labels = written(both.groupBy("set").agg(F.min("to").alias("root")).select(
        "set", F.least("set", "root").alias("root")), name)
    while True:
        near = (
            both.withColumn("_spread", spread("to"))
            .join(labels.select(F.col("set").alias("to"), "root", spread("set").alias("_spread")), ["to", "_spread"])
            .groupBy("set").agg(F.min("root").alias("low"))
        )
        lower = labels.join(near, "set").select(
            "set", "root", F.least("root", "low").alias("low")
        )
        # The old root learns the lower label too, so that whole trees hook on at once.
        told = lower.select("set", "low").unionAll(lower.select(F.col("root").alias("set"), "low"))
        hooked = written(told.groupBy("set").agg(F.min("low").alias("low")), f"{name}-hooked")
        jumped = (
            hooked.withColumn("_spread", spread("low"))
            .join(
                hooked.select(F.col("set").alias("low"), F.col("low").alias("lower"), spread("set").alias("_spread")),
                ["low", "_spread"],
            )
            .select("set", F.least("low", "lower").alias("root"))
        )
        new = written(jumped, name)
        changed = (
            new.join(labels.withColumnRenamed("root", "old"), "set")
            .filter(F.col("root") != F.col("old")).limit(1).count()
        )
        labels = new
        if not changed:
            return labels


def linked(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = 0.9999,
    block_rows: int = 256,
    block_grams: int = 500_000,
    group_rows: int = 20_000,
) -> DataFrame:
    """One row a document: doc_id, ``class`` (of equal n-gram sets), ``group_id`` and
    ``group_class``, the smallest doc_id of all linked to it directly or through others and that
    one's class, ``n_links`` and ``n_texts``, the other documents and other classes of similarity
    ``threshold`` or more."""
    bands, rows = bands_for(threshold, recall)
    signed = written(signatures(docs, id_column, text_column, n, bands, rows), "signatures")
    with_set = signed.filter(F.col("set").isNotNull())
    classes = written(
        with_set.groupBy("set").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("copies"),
            F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"),
        ),
        "classes",
    )
    at = classes.select("set", "n_grams", F.posexplode("bands").alias("band", "hash"))
    buckets = (
        at.groupBy("band", "hash")
        .agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
        .filter(F.col("n") > 1)
        .select(
            "band", "hash", spread("band", "hash").alias("_spread"),
            F.ceil(F.greatest(F.col("n") / block_rows, F.col("grams") / block_grams)).cast("int").alias("blocks"),
        )
    )
    dealt = (
        at.withColumn("_spread", spread("band", "hash"))
        .join(buckets, ["band", "hash", "_spread"])
        .withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "set", "band", "hash", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
            "block",
        )
        # Only what shares a bucket takes all its bands along.
        .join(classes.select("set", "bands", "copies", "n_grams"), "set")
        .select("set", "band", "hash", "i", "j", "block", "bands", "copies", "n_grams")
    )
    # Many small pairs of blocks share a group, whose rows are about ``group_rows``.
    task = F.xxhash64("band", "hash", "i", "j")
    columns = (
        "set binary, band int, hash long, i int, j int, block int, bands array<long>, copies long, "
        "n_grams long"
    )
    parts = max(1, -(-classes.count() * bands // group_rows))
    todo = written(
        dealt.withColumn("part", F.pmod(task, F.lit(parts))).groupBy("part").applyInPandas(_open, columns),
        "todo",
    )
    size = todo.agg(F.sum("n_grams")).first()[0] or 0
    parts = max(1, -(-size // (2 * block_grams)))
    # One text of each class that is to be verified; a null id stands for all rows without one,
    # and so does an id for all its rows, which is why the set's hash is taken once more.
    needed = written(
        todo.select("set").distinct().join(classes.select("set", "first_id"), "set"), "needed"
    )
    wanted = needed.select(F.col("first_id").alias("wanted_id")).distinct()
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = (
        texts.select("text").mapInPandas(_gram_sets(n), "set binary, grams array<long>")
        .join(needed.select("set"), "set", "left_semi").dropDuplicates(["set"])
    )
    verified = written(
        todo.withColumn("_spread", spread("set"))
        .join(sets.withColumn("_spread", spread("set")), ["set", "_spread"]).drop("_spread")
        .withColumn("part", F.pmod(task, F.lit(parts)))
        .groupBy("part").applyInPandas(_verifier(threshold), "set binary, links long, texts long, to binary"),
        "verified",
    )
    counts = verified.groupBy("set").agg(F.sum("links").alias("links"), F.sum("texts").alias("n_texts"))
    roots = components(verified.filter(F.col("set") != F.col("to")).select("set", "to").distinct())
    labelled = classes.select("set", "first_id", "copies").join(roots, "set", "left").join(counts, "set", "left")
    labelled = written(labelled.withColumn("root", F.coalesce("root", "set")), "labelled")
    first = F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "set")
    group_ids = labelled.groupBy("root").agg(F.min(first).alias("first")).select(
        "root", F.col("first.first_id").alias("group_id"), F.col("first.set").alias("group_set")
    )
    about = (
        labelled.withColumn("_spread", spread("root"))
        .join(group_ids.withColumn("_spread", spread("root")), ["root", "_spread"])
        .select(
            "set", "group_id", "group_set", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        )
    )
    about = written(about, "about")
    members = signed.select("doc_id", "set", spread("set").alias("_spread"))
    return members.join(about.withColumn("_spread", spread("set")), ["set", "_spread"], "left").select(
        "doc_id", F.hex("set").alias("class"),
        F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
        F.hex("group_set").alias("group_class"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
    )


def deduplicated(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = NGRAM, **options
) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; documents without a word
    are no copies of each other. Of rows that share both id and class one stays."""
    about = linked(docs, id_column, text_column, n, **options)
    stays = about.filter(
        F.col("doc_id").eqNullSafe(F.col("group_id")) & F.col("class").eqNullSafe(F.col("group_class"))
    ).select(F.col("doc_id").alias("_kept"), F.unhex("class").alias("_kept_set")).distinct()
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tagged = docs.select(
        record.alias("record"), F.col(id_column).cast("long").alias("_id"),
        _set_hash(n)(F.col(text_column)).alias("_set"),
    )
    kept = tagged.join(
        written(stays, "stays"),
        F.col("_id").eqNullSafe(F.col("_kept")) & F.col("_set").eqNullSafe(F.col("_kept_set")),
        "left_semi",
    )
    return kept.dropDuplicates(["_id", "_set"]).select("record.*")


def _set_hash(n: int):
    @F.pandas_udf("binary")
    @lean
    def set_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher(n, 1, 1)
        for texts in batches:
            yield pd.Series([_digest(hasher.ngrams(t)) for t in texts], dtype=object)

    return set_hash
