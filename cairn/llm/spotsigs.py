"""SpotSigs document fingerprints, in DataFrame functions only.

A signature is a spot: an anchor (a common word) and the chain of the next CHAIN content words behind it, other common words
skipped. A text's fingerprint is the set of its signatures. Boilerplate, which has few common words, adds little to it.
Every text with a word has at least the signature of its beginning. Where common words are rarer than one in
RARE words (another language, tables, junk), one word in HASHED, chosen by hash, is an anchor too.

Sets are compared by Jaccard similarity, pruned by size: sets are partitioned by their number of signatures, and a pair whose partitions lie
so far apart that it can't reach the least similarity asked for is not compared. Whether stated pairs (a text and its edited text, a document
and the next one) are alike is found so; their likeness itself is exact for every pair, as no size may change it. The search for all similar sets compares sets of the same or the next partition, where only
the rarest signatures of a set (its prefix) are index keys: two similar sets share one of them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, row_key, small

CHAIN = 2
RARE = 20
HASHED = 8
THRESHOLD = 0.8
#: Text bytes of one bucket of neighbours; buckets are more than partitions.
BUCKET_BYTES = 64 << 20

#: Common words of English, German, French and Spanish.
COMMON = tuple(
    """
    the of and to a in is that it for as was with be by on are this not or from at which have has had an they you were their there been do does did can will would
    der die das und von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über
    le la les un une et que qui dans en du pour pas par sur au avec plus ce sont ou mais il elle nous vous ont été cette ses aux leur
    el los las una y en por con para se del lo su al más pero sus ya o este sí porque cuando muy sin sobre también hasta hay donde como ser
    """.split()
)


def with_signatures(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with the array column `name`: the distinct signatures of the text as ints, sorted; empty for a null or wordless text."""
    w, anchors, content = f"__w_{name}", f"__a_{name}", f"__c_{name}"
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    common = lambda x: x.isin(*COMMON)
    chosen = lambda x: common(x) | (F.pmod(F.hash(x), F.lit(HASHED)) == 0)
    out = docs.withColumn(w, words)
    # The choice stands outside the lambda: inside it would be made anew for every word.
    few = F.size(F.filter(w, common)) * RARE < F.size(w)
    out = out.withColumn(f"{w}_f", F.when(few, F.transform(w, chosen)).otherwise(F.transform(w, common)))
    out = out.withColumn(anchors, F.filter(F.transform(f"{w}_f", lambda a, i: F.when(a, i)), lambda i: i.isNotNull()))
    out = out.withColumn(content, F.filter(w, lambda x, i: ~F.get(f"{w}_f", i)))
    # The j-th anchor, at word p, has p - j content words before it.
    chain = lambda at: [F.get(content, at + k) for k in range(CHAIN)]
    spots = F.transform(anchors, lambda p, j: F.hash(F.get(w, p), *chain(p - j)))
    first = F.when(F.size(w) > 0, F.array(F.hash(F.lit("^"), *chain(F.lit(0))))).otherwise(F.array().cast("array<int>"))
    return out.withColumn(name, F.sort_array(F.array_distinct(F.concat(first, spots)))).drop(w, f"{w}_f", anchors, content)


def fingerprint(signatures: str) -> Column:
    """A signature set as text: each signature as 8 hexadecimal digits."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s.cast("bigint").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two signature sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / F.greatest(total, F.lit(1))).cast("double")


def size_partition(n: Column, threshold: float = THRESHOLD) -> Column:
    """The partition of a set with n signatures; sets at the threshold lie in the same or in neighbouring ones. Null for the empty set."""
    return F.when(n > 0, F.floor(F.log(n) / F.lit(-math.log(threshold)) + 1e-9))


def pruned_likeness(a: str, b: str, least: float) -> Column:
    """likeness() where size partitions and sizes of the sets allow `least`, else null, without looking at the sets."""
    apart = math.ceil(math.log(least) / math.log(THRESHOLD) - 1e-9) if least < THRESHOLD else 1
    near = F.abs(size_partition(F.size(a)) - size_partition(F.size(b))) <= apart
    small_, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both_empty = large == 0
    return F.when(both_empty | (near & (small_ >= F.lit(least) * large)), likeness(a, b))


def _bucket() -> Column:
    """How many of the ascending `__bounds` are at or before `__key`; found by halving."""
    n = F.coalesce(F.size("__bounds"), F.lit(0))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        before = F.get(F.col("__bounds"), middle) <= F.col("__key")
        go = s["lo"] < s["hi"]
        return F.struct(F.when(go & before, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(go & ~before, middle).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve)["lo"]


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Window]:
    """docs with `__next`, the text of the next document by descending doc_id (the first one's after the last), and the window that has it.

    Ties of doc_id go by row key, null ids come last; ids must be integers. Rows marked `__copy` are no rows of docs: each bucket of
    neighbours ends in a copy of the row that follows it. Texts are shuffled once, by bucket. The bounds of buckets, which come from a sample of
    keys, are one row that joins all others; the rows at the beginnings of buckets are a small table.
    """
    spark = docs.sparkSession
    keyed = docs.withColumns(dict(zip(("_k1", "_k2"), row_key(doc_id, text), strict=True)))
    keyed = keyed.withColumns({"__null": F.col(doc_id).isNull(), "__down": F.coalesce(F.bitwise_not(F.col(doc_id).cast("bigint")), F.lit(0))})
    total, size = keyed.agg(F.count("*"), F.sum(F.coalesce(F.octet_length(text), F.lit(0)))).first()
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(size or 0) // BUCKET_BYTES)
    every = max(1, total // (16 * buckets))
    key = F.struct(F.col("__null").alias("n"), F.col("__down").alias("d"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"))
    keys = keyed.select("__null", "__down", "_k1", "_k2")
    sample = keys.filter(F.pmod(F.xxhash64(F.lit(3), "_k1", "_k2"), F.lit(every)) == 0).agg(F.array_sort(F.collect_list(key)).alias("s"))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(buckets)), lambda k: F.get("s", (F.size("s").cast("long") * k / (buckets + 1)).cast("int")))
    bounds = F.broadcast(sample.select(F.array_distinct(F.filter(cuts, lambda c: c.isNotNull())).alias("__bounds")))  # one row

    def placed(df: DataFrame) -> DataFrame:
        return df.join(bounds).withColumn("__key", key).withColumn("__bucket", _bucket()).drop("__bounds")

    firsts = placed(keys).groupBy("__bucket").agg(F.min("__key").alias("__key"))
    along = Window.orderBy("__bucket")  # a row a bucket
    before = F.coalesce(F.lag("__bucket").over(along), F.max("__bucket").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    extra = firsts.select(F.col("__key.k1").alias("_k1"), F.col("__key.k2").alias("_k2"), F.col("__key.d").alias("__down"), before.alias("__before"))
    rows = placed(keyed).join(small(extra, buckets + 1), ["_k1", "_k2", "__down"], "left")
    home = F.struct(F.lit(False).alias("copy"), F.col("__bucket").alias("bucket"))
    there = F.struct(F.lit(True).alias("copy"), F.col("__before").alias("bucket"))
    spread = rows.withColumn("__at", F.explode(F.when(F.col("__before").isNull(), F.array(home)).otherwise(F.array(home, there))))
    spread = spread.withColumns({"__copy": F.col("__at.copy"), "__bucket": F.col("__at.bucket")}).drop("__at", "__before")
    order = Window.partitionBy("__bucket").orderBy("__copy", "__null", "__down", "_k1", "_k2")
    return spread.drop("__key").withColumn("__next", F.lead(text).over(order)), order


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, alike_edited, alike_next) for every row of docs.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document by descending doc_id. Null texts count as empty; repeated rows stay; an empty table gives an empty table. near_edited and
    near_next are the likeness of the fingerprints' signature sets, of all pairs; alike_edited and alike_next, by the pruned comparison, say whether it is
    THRESHOLD or more. A doc_id that is no integer is an error.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, order = with_next(plain)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("__edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce(F.col("__next"), F.lit("")), F.lit(1), half))).drop("__next")
    rows = with_signatures(rows, "text", "__own").withColumn("n_chars", n.cast("long")).drop("text")
    rows = rows.withColumn("__following", F.lead("__own").over(order)).filter(~F.col("__copy"))
    rows = with_signatures(rows, "__edited", "__other").withColumn("edited_sha256", F.sha2(F.col("__edited").cast("binary"), 256))
    alike = lambda a, b: F.coalesce(pruned_likeness(a, b, THRESHOLD) >= THRESHOLD - 1e-12, F.lit(False))
    pairs = {"edited": ("__own", "__other"), "next": ("__own", "__following")}
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("__own").alias("fingerprint"), fingerprint("__other").alias("edited_fingerprint"),
        *[likeness(*p).alias(f"near_{k}") for k, p in pairs.items()], *[alike(*p).alias(f"alike_{k}") for k, p in pairs.items()],
    )


def similar_sets(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of different signature sets at the threshold or above, and (doc_id, set_id) for every row of docs.

    Documents with equal fingerprints are one set, so copies add a membership row and no pair. Texts without a word share the
    empty set, which pairs with none. A pair is met through the prefix of the smaller set, in its size partition and the next.
    """
    rows = with_signatures(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "sigs").drop("text")
    rows = scratch.cut(rows.withColumn("set_id", F.xxhash64("sigs")), "members")
    sets = scratch.cut(rows.filter(F.size("sigs") > 0).dropDuplicates(["set_id"]).select("set_id", "sigs", F.size("sigs").alias("n")), "sets")
    spots = sets.select("set_id", "n", F.explode("sigs").alias("sig"))
    rare = spots.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = F.row_number().over(Window.partitionBy("set_id").orderBy("df", "sig"))
    prefix = spots.join(rare, "sig").withColumn("r", ranked).filter(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    index = prefix.select("sig", "set_id", "n", size_partition(F.col("n"), threshold).alias("part"))
    probe = index.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    a, b = probe.alias("a"), index.alias("b")
    sizes = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.set_id") < F.col("b.set_id")))
    met = a.join(b, reduce(lambda x, y: x & y, [F.col("a.sig") == F.col("b.sig"), F.col("a.part") == F.col("b.part"), sizes, F.col("a.n") >= F.lit(threshold) * F.col("b.n") - 1e-9]))
    met = met.select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).distinct()
    one = sets.select(F.col("set_id").alias("a"), F.col("sigs").alias("sa"))
    two = sets.select(F.col("set_id").alias("b"), F.col("sigs").alias("sb"))
    pairs = met.join(one, "a").join(two, "b").select("a", "b", pruned_likeness("sa", "sb", threshold).alias("likeness")).filter(F.col("likeness") >= threshold - 1e-12)
    return pairs, rows.select("doc_id", "set_id")
