"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is found in a document if at least `threshold` of the item's distinct word shingles occur there. Words are
maximal runs of letters and digits, in lower case; shingles take `width` words, an item of fewer words is one shingle.

Search. Items are partitioned by size (number of distinct shingles), each partition between two powers of two. The
partition's sketch length is floor((1 - threshold) * largest size) + 1, and an item's sketch is that many of its shingles
with the least MinHash values. A document that holds at least the threshold of an item lacks fewer shingles than the
sketch has, so at least one value of the sketch is among the document's: no document is lost, however long it is. A
document shorter than an item's required shingle count can't contain it and is pruned by size. Candidates are then
verified: their documents are read again and the item's shingles in them counted by their text.

All of it is DataFrame expressions. Documents are split into words once in the search, and once more for the few that are verified; they never leave
their input partition. Only matches are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, row_key, small

WIDTH = 5
THRESHOLD = 0.8
#: Runs of anything but letters and digits part words.
SEPARATOR = r"[^\p{L}\p{N}]+"


def words(text: str) -> Column:
    """The words of a text column in lower case; none for a null or wordless text."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATOR), lambda w: w != "")


def _minhash(words: list[Column]) -> Column:
    """The MinHash value of a shingle: the hash of its words' hashes, in order."""
    return F.xxhash64(F.lit(len(words)), *words)


def item_shingles(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(item_id, length, shingle, value): the distinct shingles of each item with their MinHash values.

    Items without a word or with a null id are left out: nothing can be said to contain them. Rows that share an id count as one item
    with the shingles of all of them.
    """
    w = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words(text).alias("w")).filter(F.size("w") > 0)
    w = w.withColumns({"length": F.least(F.size("w"), F.lit(width)), "h": F.transform("w", lambda x: F.xxhash64(x))})
    rows = w.select("item_id", "length", "w", "h", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("i"))
    value = F.coalesce(*[F.when(F.col("length") == k, _minhash([F.get("h", F.col("i") + j) for j in range(k)])) for k in range(1, width + 1)])
    return rows.select("item_id", "length", F.array_join(F.slice("w", F.col("i") + 1, F.col("length")), " ").alias("shingle"), value.alias("value")).distinct()


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, length, value, needed): each item's sketch, as long as its size partition asks; needed: shingles that must be found."""
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct("value", "length"))).alias("all"))
    largest = F.pow(F.lit(2), F.ceil(F.log2("size")))
    sketch = F.floor((1 - F.lit(threshold) + 1e-12) * largest).cast("int") + 1
    needed = F.ceil(F.lit(threshold) * F.col("size") - 1e-9)
    cut = sizes.select("item_id", needed.alias("needed"), F.explode(F.slice("all", 1, sketch)).alias("s"))
    return cut.select("item_id", "needed", F.col("s.length").alias("length"), F.col("s.value").alias("value"))


def _document_shingles(docs: DataFrame, lengths: list[int], keep: list[str], least: int, text: bool) -> DataFrame:
    """keep, `n` words and every shingle (repeats included) of the given lengths: as `value`, and as `shingle` text if asked for.

    Documents of fewer than `least` words have none that counts.
    """
    w = docs.select(*keep, words("__text").alias("w")).filter(F.size("w") >= least)
    w = w.withColumn("h", w["w"] if text else F.transform("w", lambda x: F.xxhash64(x)))
    rows = w.select(*keep, F.size("w").alias("n"), "h", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))

    def at(length: int) -> Column:
        parts = [F.get("h", F.col("i") + k) for k in range(length)]
        return F.when(F.col("i") + length <= F.col("n"), F.concat_ws(" ", *parts) if text else _minhash(parts))

    name = "shingle" if text else "value"
    if len(lengths) == 1:
        return rows.select(*keep, "n", F.lit(lengths[0]).alias("length"), at(lengths[0]).alias(name)).filter(F.col(name).isNotNull())
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("length"), at(k).alias(name)) for k in lengths])).alias("s")
    return rows.select(*keep, "n", every).select(*keep, "n", "s.length", f"s.{name}").filter(F.col(name).isNotNull())


def contained(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, found, size, containment, _k1, _k2): every item that a document contains, one row a pair.

    _k1 and _k2 are the row key of (doc_id, text). Rows that repeat in docs give one row, rows that share an id but not the
    text one each. Null and blank texts contain nothing; a null doc_id is carried. Empty tables give an empty table.
    """
    shingles = scratch.cut(item_shingles(benchmark, item_id, item_text, width), "shingles")
    sketch = scratch.cut(sketches(shingles, threshold), "sketches")
    n_shingles, n_sketch = shingles.count(), sketch.count()
    lengths = sorted(r[0] for r in shingles.select("length").distinct().collect())  # 1 to width at most
    keys = ["_k1", "_k2"]
    rows = docs.select(*row_key(doc_id, text), F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    if not lengths:
        return rows.limit(0).select(F.col("__id").alias("doc_id"), F.lit(None).cast(benchmark.schema[item_id].dataType).alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in ("found", "size")], F.lit(0.0).alias("containment"), *keys)

    # Search: which documents hold a value of which item's sketch. A document needs as many words as the shingles that the least item asks for.
    least = sketch.agg(F.min(F.col("needed") + F.col("length") - 1)).first()[0]
    wanted = small(sketch.select("value", "length", F.col("item_id").alias("__item"), "needed"), n_sketch)
    held = _document_shingles(rows, lengths, keys, least, text=False)
    hits = held.join(wanted, ["value", "length"]).filter(F.col("n") - F.col("length") + 1 >= F.col("needed"))
    candidates = scratch.cut(hits.select(*keys, "__item").distinct(), "candidates")
    n_documents = candidates.select(*keys).distinct().count()

    # Verification: the distinct shingles of the item, as text, that the candidate documents hold.
    near = rows.join(small(candidates.select(*keys).distinct(), n_documents), keys)
    of_item = small(shingles.select("length", "shingle", F.col("item_id").alias("__item")), n_shingles)
    hit = _document_shingles(near, lengths, [*keys, "__id"], least, text=True).join(of_item, ["length", "shingle"])
    found = hit.select(*keys, "__id", "__item", "shingle").distinct()
    sizes = shingles.groupBy(F.col("item_id").alias("__item")).agg(F.count("*").alias("size"))
    counted = found.groupBy(*keys, "__id", "__item").agg(F.count("*").alias("found")).join(candidates, [*keys, "__item"]).join(sizes, "__item")
    kept = counted.filter(F.col("found") >= F.ceil(F.lit(threshold) * F.col("size") - 1e-9))
    return kept.select(F.col("__id").alias("doc_id"), F.col("__item").alias("item_id"), "found", "size", (F.col("found") / F.col("size")).alias("containment"), *keys)


def remove(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that contain a benchmark item; columns, values and repeats of the other rows are unchanged."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    leaks = scratch.cut(contained(docs, benchmark, scratch, doc_id, text, **options).select("_k1", "_k2").distinct(), "leaks")
    scratch.drop("candidates", "sketches", "shingles")
    k1, k2 = fresh(docs, "_k1", "_k2")
    keyed = docs.withColumns(dict(zip((k1, k2), row_key(doc_id, text, names=(k1, k2)), strict=True)))
    leaks = leaks.toDF(k1, k2)
    return keyed.join(small(leaks, leaks.count()), [k1, k2], "left_anti").drop(k1, k2)
