"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content: the SHA-256 of its UTF-8 bytes is its blob. A ledger in the shared folder
has one row for each pair of blob and rule version that was ever scanned, with the spans found. A scan reads only blobs whose
pair the ledger lacks, appends them, and joins findings back to every path that has the blob.

Scale. Each task hashes its texts and passes on each blob once, compressed, so a text with a third of all rows reaches
the scan at most once a task; the join back moves only paths and findings, and only of blobs that have any.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, bounded, texts_of

KINDS = ("assign", "access", "hex")
#: Changes with every change of the rules below, so that old blobs are scanned again.
RULES = "base-1"

#: The rules. A match is kept if it is as long as the rule asks.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Texts that none of these match have no finding. Each matches whatever its rule does.
_MAY = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
}


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every finding in code points, by start and then kind; matches of a kind do not overlap."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # A run of 24 or more is a whole maximal run from where it starts, so asking for the length in the pattern is the same.
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def said(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, body): the texts of a task by content address, each once."""
    seen, squeeze = set(), zstandard.ZstdCompressor(level=1)
    for b in bounded(batches, 0):
        blobs, bodies = [], []
        for t in texts_of(b.column(0)):
            raw = t.encode("utf-8", "surrogatepass")
            blob = hashlib.sha256(raw).digest()
            if blob not in seen:
                seen.add(blob)
                blobs.append(blob)
                bodies.append(squeeze.compress(raw))
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(bodies, pa.binary())], names=["blob", "body"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, rules, spans) for the blobs of a partition, each scanned once."""
    seen, expand = set(), zstandard.ZstdDecompressor()
    for b in bounded(batches, "body", SLICE_BYTES // 4):  # compressed
        new = [i for i, k in enumerate(b["blob"].to_pylist()) if not (k in seen or seen.add(k))]
        blobs = b["blob"].take(pa.array(new, pa.int64()))
        texts = [expand.decompress(x).decode("utf-8", "surrogatepass") for x in b["body"].take(pa.array(new, pa.int64())).to_pylist()]
        column = pa.array(texts, pa.large_string())
        may = None
        for pattern in _MAY.values():
            hit = pc.match_substring_regex(column, pattern)
            may = hit if may is None else pc.or_(may, hit)
        found = [said(spans(t)) if m else "" for t, m in zip(texts, may.to_pylist(), strict=True)] if texts else []
        yield pa.RecordBatch.from_arrays([blobs, pa.array([RULES] * len(new), pa.string()), pa.array(found, pa.string())], names=["blob", "rules", "spans"])


LEDGER = "blob binary, rules string, spans string"


def scan(versions: DataFrame, ledger: str, text: str = "text") -> int:
    """Scans the blobs of versions that the ledger (a folder) lacks under the present RULES and appends them. Returns how many.

    Null texts are the empty blob. Rows may repeat; a blob is scanned once. An empty table appends nothing.
    """
    spark = versions.sparkSession
    blobs = versions.select(F.col(text).alias("t")).mapInArrow(_blobs, "blob binary, body binary")
    known = read(spark, ledger).filter(F.col("rules") == RULES).select("blob").distinct()
    new = blobs.join(known, "blob", "left_anti") if not known.isEmpty() else blobs
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = read(spark, ledger).count()
    new.repartition(n, "blob").mapInArrow(_scan, LEDGER).write.mode("append").parquet(ledger)
    return read(spark, ledger).count() - before


def read(spark, ledger: str) -> DataFrame:
    """The ledger's rows; none where it does not exist yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger)


def findings(paths: DataFrame, ledger: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of paths: the columns keep, `blob` and `spans` of its text under the present RULES ('' if it has none).

    Every blob of paths must have been scanned.
    """
    blob = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    found = read(paths.sparkSession, ledger).filter((F.col("rules") == RULES) & (F.col("spans") != "")).select("blob", "spans").distinct()
    return paths.select(*keep, blob.alias("blob")).join(found, "blob", "left").select(*keep, "blob", F.coalesce("spans", F.lit("")).alias("spans"))


def scan_all(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """findings() of docs over a ledger of its own."""
    ledger = Scratch(docs.sparkSession, "secrets").path("ledger")
    scan(docs, ledger, text)
    return findings(docs, ledger, text, keep)
