"""Samples of labelled rows that copies, common terms and class shares must not distort."""

import collections
import random

from pyspark.sql import functions as F

from cairn.llm import langid, toxicity
from cairn.llm.common import Scratch


def test_rare_toxic_terms_are_not_crowded_out(spark):
    rng = random.Random(1)
    common = " ".join("".join(rng.choice("bcdefghjkm") + rng.choice("aeou") for _ in range(4)) for _ in range(14_000))
    rows = [(i, common + (" zzqqxxvv" if i < 6 else ""), int(i < 10)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), Scratch(spark, "test"))
    assert any(t.startswith(" zzqq") for t in lexicon.terms)


def test_scores_do_not_depend_on_the_size_of_the_sample(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        bad = i % 10 == 0
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeou')}{rng.choice('mnrst')}" for _ in range(20)]
        rows.append((i, " ".join([*words, *(["grubbish"] if rng.random() < (0.6 if bad else 0.05) else [])]), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), Scratch(spark, "test"), per_class=250)
    assert abs(toxicity.score(docs, lexicon).agg(F.avg("score")).first()[0] - 0.1) < 0.04


def test_copies_leave_room_for_all_languages(spark):
    each = spark.range(100).select(F.concat(F.lit("some text "), "id").alias("t"))
    rate = F.pmod(F.xxhash64("t", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    drawn = spark.range(2000).select(F.concat(F.lit("copied "), "id").alias("t")).filter(rate < 0.01).first().t
    docs = each.crossJoin(spark.createDataFrame([("a",), ("b",), ("c",)], "lang string")).select(F.concat("lang", "t").alias("text"), "lang")
    docs = docs.union(spark.range(1500).select(F.lit(drawn).alias("text"), F.lit("a").alias("lang")))
    languages, rows, y = langid._sample(docs, "text", "lang", 20)
    have = collections.Counter(y.tolist())
    assert languages == ["a", "b", "c"] and all(8 <= have[k] <= 40 for k in range(3))
