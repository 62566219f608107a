"""WARC archives: a writer of gzip members with revisit records, and a splittable reader.

Reader: a file is cut into byte ranges, and each task owns the records whose member starts inside
its range. It scans the range for the gzip magic, decodes what follows and takes it for a record
only if that begins as a WARC header and the member's own checksum holds; after a record the scan
goes on behind it, so a range that ends inside a record reads on to that record's end.

Writer: every task writes one archive under a fresh name and returns it; only archives of tasks
that succeeded are listed, so a retried task leaves at most a file that nobody reads.

Nulls: a null html is an empty payload, a null url an empty address; a null id is written as such
and is the last choice for the response among equal payloads. Equal rows are records each: one is
the response, the others revisit it. Empty table: no archive, no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordercash.llm.common import fresh_path, ship, spread, written

ship(__name__)

MAGIC = b"\x1f\x8b\x08"
REVISIT_FROM = 100
READERS = 100_000  # tasks of one reading stage
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "file string, offset long, record_type string, record_id string, target_uri string, "
    "page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
)


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def member(page, url, payload: bytes, digest: str, refers_to, date: str, level: int = 6) -> bytes:
    """One record as a gzip member; a revisit of page ``refers_to`` unless that is None."""
    revisit = refers_to is not None
    block = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page is None else page}",
    ]
    if revisit:
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def linked(pages: DataFrame) -> DataFrame:
    """``pages`` with digest, size and, for all but the first of equal payloads, ``refers_to``.

    Rows get their number once and are written with it, as a second run over an input that is not a plain
    scan may number them otherwise.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = written(base, "numbered")
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    firsts = (
        base.filter(F.col("size") >= REVISIT_FROM)
        .groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
        # Only payloads that come more than once; written, so that few are known to be few.
        .filter(F.col("n") > 1).select("digest", F.col("first.page_id").alias("first"), F.col("first.row").alias("first_row"))
    )
    firsts = written(firsts, "firsts")
    joined = base.withColumn("_spread", spread("digest")).join(
        firsts.withColumn("_spread", spread("digest")), ["digest", "_spread"], "left"
    )
    later = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    return joined.withColumn("refers_to", F.when(later, F.col("first"))).drop("_spread", "row", "first", "first_row")


def write_archives(pages: DataFrame, path: str | None = None, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` as archives under ``path``; one row an archive: path, bytes, records."""
    folder = path or fresh_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        name, out, size, n = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page, url, html, digest, refers in zip(
                batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["refers_to"], strict=True
            ):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = html.encode("utf-8", "replace") if isinstance(html, str) else b""
                raw = member(
                    None if pd.isna(page) else int(page), url if isinstance(url, str) else "", payload,
                    digest, None if pd.isna(refers) else int(refers), date,
                )
                out.write(raw)
                size += len(raw)
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame([(f"{folder}/{name}", size, n)], columns=["path", "bytes", "records"])

    return written(linked(pages).mapInPandas(write, "path string, bytes long, records long"), "archives")


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a decoded record."""
    head, found, block = raw.partition(b"\r\n\r\n")
    if not found:
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        return None
    size = int(fields["content-length"])
    return (fields, block[:size]) if len(block) >= size else None


def members(file, start: int, end: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and decoded bytes of the records that start in [start, end) of an open file."""
    file.seek(start)
    buffer, base = file.read(max(0, end - start) + len(MAGIC) - 1), start
    at = 0
    while True:
        at = buffer.find(MAGIC, at)
        if at < 0 or base + at >= end:
            return
        unpack, fed, decoded, good = zlib.decompressobj(31), at, [], True
        got = 0
        try:
            while not unpack.eof:
                if fed >= len(buffer):
                    more = file.read(step)
                    if not more:
                        break
                    buffer += more
                piece = buffer[fed : fed + step]
                fed += len(piece)
                decoded.append(unpack.decompress(piece))
                got += len(decoded[-1])
                if len(decoded) == 1 and got >= 7 and not decoded[0].startswith(b"WARC/1."):
                    good = False
                    break
        except zlib.error:
            good = False
        raw = b"".join(decoded) if good and unpack.eof else b""
        if raw.startswith(b"WARC/1."):
            yield base + at, raw
            at = fed - len(unpack.unused_data)
        else:
            at += 1


def read_archives(
    spark: SparkSession, archives: DataFrame, split_bytes: int = 32 << 20, with_payload: bool = True
) -> DataFrame:
    """All records of archives given as rows (path, bytes), by one task a range up to ``READERS`` tasks."""
    ranges = archives.select(
        "path", "bytes",
        F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")).alias("start"),
    )
    readers = min(max(1, ranges.count()), READERS)
    # The ranges of an archive go to one task after the other.
    task = F.pmod(F.xxhash64("path") + F.floor(F.col("start") / split_bytes), F.lit(readers)).cast("int")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        columns = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"], batch["start"], strict=True):
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for offset, raw in members(file, int(start), min(int(size), int(start) + split_bytes)):
                        parsed = parse(raw)
                        if parsed is None:
                            continue
                        rows.append((path, offset, *_row(*parsed, with_payload)))
                        held += len(raw)
                        if held > 8 << 20:
                            yield _frame(rows, columns)
                            rows, held = [], 0
                yield _frame(rows, columns)

    return ranges.repartitionById(readers, task).mapInPandas(read, RECORDS)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("offset", "page_id", "refers_to", "payload_bytes"):
        out[c] = out[c].astype("Int64")
    return out


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = fields.get("warc-type", "")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    if kind == "revisit":  # the payload is the other record's; the headers tell of it
        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        told = [x[15:] for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")]
        size = int(told[0]) if told else None
    number = lambda name: int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None
    return (
        kind, fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""), number("x-page-id"),
        number("x-refers-to-page-id"), digest, size, payload if with_payload and kind != "revisit" else None,
    )
