"""WARC archives: a writer with revisit records, and a reader that verifies the chain of record boundaries.

A payload may hold anything, the magic of a record included, so finding the magic does not prove a record. The reader's
tasks emit every place where a record could begin together with the place where its successor would, by its header's
Content-Length. Pointer jumping from the start of each file then doubles the set of reachable places until it is
closed; only reachable records are kept. Content-Length counts bytes, so a file's records are an unbroken chain.

Writing goes through Spark's text sink: the bytes of a record, with the line separator of the sink as the record's end. No
executor touches a local file. Reading goes through Spark's binary file source, a task a file, so files are kept to FILE_BYTES: records are
written by size class, each with as many records a file as fit, and only a single larger record makes a larger file. A payload of up to 1.9 GB
can be written and read, which is what a Spark row holds.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

MAGIC = b"WARC/1.0\r\n"
#: Payloads of fewer bytes are written anew each time.
REVISIT_BYTES = 1000
#: Bytes of payload and records of one file at most, which bounds what a task holds.
FILE_BYTES = 64 << 20
FILE_RECORDS = 2000
#: Bytes at the head of a record in which its fields are looked for; the writer puts the one field of unbounded length last.
HEADER_BYTES = 16 << 10
_END = "\r\n\r\n"
_FIELD = re.compile(rb"(?m)^([A-Za-z-]+): ?(.*?)\r$")
_LENGTH = re.compile("[0-9]{1,18}")
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def plan(pages: DataFrame, scratch: Scratch, page_id: str = "page_id", payload: str = "html", url: str = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """(page id, url) of pages under their names, with `payload` (bytes, null as none), `payload_bytes`, `payload_digest`, `record_type`, `refers_to`.

    Other columns are left out, so that none can clash. Of rows with equal payloads of at least `least` bytes the one with the largest id is the response, all others revisit it. Rows
    that share the largest id are all responses; rows whose id is null revisit the largest id, or are responses if there is none.
    The choice shuffles ids and digests; payloads stay where they are read as long as repeated digests are few enough to broadcast.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(page_id, url, body.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    long = rows.filter(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_d"))
    last = scratch.cut(long.agg(F.max(page_id).alias("_last"), F.count("*").alias("_n")).filter("_n > 1 AND _last IS NOT NULL").drop("_n"), "repeated")
    found = rows.join(small(last, last.count()), (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") >= least), "left")
    revisit = F.col("_last").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("_last"))
    return found.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_last"))}).drop("_d", "_last")


def _uri(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def write(planned: DataFrame, path: str, page_id: str = "page_id", url: str = "url", file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """Writes one record per row of a plan() to files under path. A revisit record has no block; its digest is that of the full payload.

    A folder `size-k` has the records whose payloads have less than 16 ** k bytes, in files of file_records records and file_bytes bytes at
    most, or of a single record. An empty plan writes an empty folder.
    """

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    # A line feed or carriage return in a URL would end its header field.
    target = F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("urn:unknown")), r"[\r\n]", "")
    is_revisit = F.col("record_type") == "revisit"
    extra = F.when(is_revisit, F.concat(line("WARC-Refers-To", _uri(F.col("refers_to"))), line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(F.lit(""))
    block = F.when(is_revisit, F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uri(F.col(page_id))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        extra,
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(block).cast("string")),
        line("WARC-Target-URI", target),
        F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), block).cast("string").alias("value")
    # A record's class follows from the longest that its URL and payload can make it; smaller ones than 16 ** 3 bytes are one class.
    length = F.octet_length("payload") + F.octet_length(target) + 1024
    size = F.greatest(F.lit(3), F.ceil(F.log(16.0, length + 1)).cast("int"))
    for k in sorted(r[0] for r in planned.select(size.alias("k")).distinct().collect()) or [3]:  # 8 classes at most
        most = max(1, min(file_records, file_bytes // 16**k))
        planned.filter(size == k).select(record).write.mode("overwrite").option("lineSep", _END).option("compression", "none").option("maxRecordsPerFile", most).text(f"{path}/size-{k}")


def _header(content: bytes, at: int, end: int) -> tuple[dict[str, str], int] | None:
    """Fields and block length of the record that would begin at `at`, its header ending at `end`; None if there can't be one."""
    fields = {k.decode("latin-1").lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(content[at + len(MAGIC) : min(end + 2, at + HEADER_BYTES)])}
    length = fields.get("content-length", "")
    return (fields, int(length)) if _LENGTH.fullmatch(length) else None


def candidates(path: str, spark) -> DataFrame:
    """(file, at, next, size, type, id, refers_to, digest, block_bytes, payload_bytes, block_digest) for every magic in the archives.

    next is where the successor would begin, or the file's size for a record that would be the last; null if the record
    would run over the end of the file or has no valid header. The columns behind size are null for records that the file's chain doesn't reach.
    """
    schema = "file string, at long, next long, size long, type string, id string, refers_to string, digest string, block_bytes long, payload_bytes long, block_digest string"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.string()]

    def places(content: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(at, end of header, end of block, successor) for every magic, negative where there is none."""
        at, end = content.find(MAGIC), -1
        while at >= 0:
            # Candidates come in order, so each blank line is looked for once.
            if end < at:
                end = content.find(b"\r\n\r\n", at)
                end = end if end >= 0 else len(content)
            stop = after = -1
            if end < len(content) and (head := _header(content, at, end)):
                stop = end + 4 + head[1]
                after = stop + len(_END)
                if after > len(content) or content[stop:after] != _END.encode():
                    stop = after = -1
            yield at, end, stop, after
            at = content.find(MAGIC, at + 1)

    def found(file: str, content: bytes) -> Iterator[list]:
        spots = np.array(list(places(content)), np.int64).reshape(-1, 4)
        # Fields and digests are for records that the file's chain reaches: a false one may claim any length of block.
        kept = reachable(spots[:, 0], spots[:, 3], len(content))
        for (at, end, stop, after), ok in zip(spots.tolist(), kept.tolist(), strict=True):
            row = [file, at, after if after >= 0 else None, len(content), *[None] * 7]
            if ok:
                fields, length = _header(content, at, end)
                payload = fields.get("warc-payload-length", str(length))
                digest = hashlib.sha1(memoryview(content)[end + 4 : stop]).hexdigest()
                row[4:] = [fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), length, int(payload) if _LENGTH.fullmatch(payload) else None, digest]
            yield row

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, cell in zip(b["path"].to_pylist(), b["content"], strict=True):
                rows = found(file, cell.as_py())
                while some := list(itertools.islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(scan, schema)


def reachable(at: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Which candidates the chain from the start of a file reaches, by pointer jumping; raises if it breaks before the end.

    at: the candidates' places, ascending; after: where each one's successor would begin, negative if there is none.
    """
    n = len(at)
    spot = np.searchsorted(at, after)
    good = (after >= 0) & (spot < n) & (at[np.minimum(spot, max(0, n - 1))] == after) if n else np.zeros(0, bool)
    jump = np.append(np.where(good, spot, n), n)  # n: nowhere
    marked = np.zeros(n + 1, bool)
    if n and at[0] == 0:
        marked[0] = True
    while True:
        grown = marked.copy()
        grown[jump[marked]] = True
        if np.array_equal(grown[:n], marked[:n]):
            break
        marked, jump = grown, jump[jump]
    kept = marked[:n]
    ends = after[kept & ~good]
    if size and (len(ends) != 1 or ends[0] != size):
        raise ValueError("the chain of records does not end at the end of the file")
    return kept


def read(path: str, spark) -> DataFrame:
    """The records of the archives under path: candidates() without those that no chain from a file's start reaches."""
    found = candidates(path, spark)

    def keep(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        after = rows["next"].combine_chunks().fill_null(-1).to_numpy()
        return rows.filter(pa.array(reachable(rows["at"].to_numpy(), after, rows["size"][0].as_py())))

    # A group is the candidates of one file, which the writer and the reader's file source bound.
    return found.groupBy("file").applyInArrow(keep, found.schema)


def page_of(uri: Column) -> Column:
    """The page id in a record id of write(); null for a page without one."""
    return F.nullif(F.regexp_extract(uri, r"^<urn:page:(.*)>$", 1), F.lit("null"))


def verified(records: DataFrame) -> DataFrame:
    """(id, type, refers_to, payload_bytes, payload_digest, verified) for records as read, from the bytes of the blocks.

    A response has its own block's bytes and digest and is verified if its header says the same digest. A revisit has those of the response that
    it refers to, and is verified if there is one with the digest that its header says; if not, it has what its header says.
    """
    said = F.regexp_replace("digest", "^sha1:", "")
    own = records.filter("type = 'response'").select("id", "type", "refers_to", F.col("block_bytes").alias("payload_bytes"), F.col("block_digest").alias("payload_digest"), F.coalesce(F.col("block_digest") == said, F.lit(False)).alias("verified"))
    again = records.filter("type = 'revisit'").select("id", "type", "refers_to", F.col("payload_bytes").alias("_said"), said.alias("_d"))
    full = own.filter("verified").groupBy(F.col("id").alias("_id"), F.col("payload_digest").alias("_of")).agg(F.max("payload_bytes").alias("_n"))
    again = again.join(full, (F.col("refers_to") == F.col("_id")) & (F.col("_d") == F.col("_of")), "left")
    again = again.select("id", "type", "refers_to", F.coalesce("_n", "_said").alias("payload_bytes"), F.col("_d").alias("payload_digest"), F.col("_n").isNotNull().alias("verified"))
    return own.unionByName(again)
