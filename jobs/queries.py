"""The jobs as queries: each runs twice over the whole tables into a folder of its own and returns what stands there afterwards."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans import catalog
from cairn.plans.lineage import shared_folder

from . import object_inventory, switch_log
from .common import settings


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_object_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of the objects in the table of vectors, by status."""
    out, config = f"{_folder(spark, 'object_inventory')}/out", settings("object_inventory")
    for _ in range(2):
        object_inventory.run(spark, f"{sf_dir}/embeddings.parquet", out, config)
    return object_inventory.read(spark, out)


def job2_switch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of switches of tracks and text sources, their states, and rows that were no observations."""
    at, config = _folder(spark, "switch_log"), settings("switch_log")
    for _ in range(2):
        switch_log.run(spark, sf_dir, f"{at}/out", f"{at}/checkpoint", config)
    whole = {name: switch_log.read(spark, f"{at}/out", name) for name in switch_log.SCHEMAS}
    none = F.lit(None)
    return (
        whole["log"].select("stream", "key", "order", "event", "label", "shape", F.col("pending_count").cast("long"), "obs_count", none.cast("long").alias("switches"))
        .unionByName(whole["states"].select("stream", "key", F.col("last").alias("order"), F.lit("state").alias("event"), F.col("pending").alias("label"), "shape", F.col("pending_count").cast("long"), "obs_count", "switches"))
        .unionByName(whole["rejected"].select("stream", "key", "order", F.col("reason").alias("event"), "label", none.cast("string").alias("shape"), none.cast("long").alias("pending_count"), none.cast("long").alias("obs_count"), none.cast("long").alias("switches")))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_object_inventory": job1_object_inventory, "job2_switch_log": job2_switch_log}

_Q = ", ".join(f"quantile_cont({c}, {q}) AS {n}{c}" for c in "xyz" for n, q in (("m", 0.5), ("lo", 0.05), ("hi", 0.95)))
_SIDES = " * ".join(f"greatest(hi{c} - lo{c}, 1e-4)" for c in "xyz")

#: A state is the shape, what is pending and its count, the number of switches and of observations; a row is folded in after the other.
ORACLE_SQL: dict[str, str] = {
    "job1_object_inventory": f"""
WITH {catalog.fx.SQL.strip()},
plane AS ({catalog.ORACLE_SQL["segment_points"]}),
off AS (SELECT p.* FROM v_points p JOIN plane USING (pid)),
low AS (SELECT obj, min(x) - 0.05 AS lx, min(y) - 0.05 AS ly, min(z) - 0.05 AS lz FROM off GROUP BY obj),
thin AS (SELECT obj, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM off JOIN low USING (obj) GROUP BY obj, floor((x - lx) / 0.1), floor((y - ly) / 0.1), floor((z - lz) / 0.1)),
{catalog.PCA_SQL.replace("v_points", "thin").strip()},
m AS (SELECT obj, count(*) AS n, {_Q}, avg(r) AS mean_r, avg(g) AS mean_g, avg(b) AS mean_b FROM thin GROUP BY obj),
j AS (SELECT *, sqrt((hix - lox) * (hix - lox) + (hiy - loy) * (hiy - loy) + (hiz - loz) * (hiz - loz)) AS scale, CASE WHEN m.n < 10 THEN 0.0 ELSE m.n / ({_SIDES}) END AS density,
m.n < 20 OR (s1 / greatest(s2, 1e-6) > 8 AND s2 / greatest(s3, 1e-6) > 6) AS bad FROM m JOIN (SELECT obj, CASE WHEN n < 10 THEN 0.0 ELSE s1 END AS s1, CASE WHEN n < 10 THEN 0.0 ELSE s2 END AS s2, CASE WHEN n < 10 THEN 0.0 ELSE s3 END AS s3 FROM s) t USING (obj))
SELECT CAST(obj AS INTEGER) AS obj, raw, coalesce(kept, 0) AS kept, coalesce(j.n, 0) AS n, {", ".join(f"round(j.{a}, 6) + 0.0 AS {b}" for a, b in (*((f"m{c}", f"c{c}") for c in "xyz"), ("scale", "scale"), ("density", "density"), *((f"s{i}", f"s{i}") for i in (1, 2, 3)), *((f"mean_{c}", f"mean_{c}") for c in "rgb")))},
{", ".join(f"round(hi{c} - lo{c}, 6) + 0.0 AS e{c}" for c in "xyz")}, CASE WHEN coalesce(j.n, 0) < 20 THEN 'too_few_points' WHEN bad THEN 'bad_shape' ELSE 'ok' END AS status
FROM (SELECT obj, count(*) AS raw FROM v_points GROUP BY obj) r LEFT JOIN (SELECT obj, count(*) AS kept FROM off GROUP BY obj) k USING (obj) LEFT JOIN j USING (obj)""",
    "job2_switch_log": """
WITH RECURSIVE w AS (SELECT 'tracks' AS stream, CAST(user_id AS VARCHAR) AS key, event_id AS ord, event_type AS label, coalesce(value >= 20, FALSE) AS sure FROM events
UNION ALL SELECT 'sources', source, doc_id, lang, coalesce(n_chars >= 200, FALSE) FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY stream, key ORDER BY ord, label, sure) AS i FROM w WHERE key IS NOT NULL AND ord IS NOT NULL AND label IS NOT NULL),
f AS (SELECT stream, key, i, ord, label, label AS shape, CAST(NULL AS VARCHAR) AS pending, 0 AS n, 0 AS switches, FALSE AS waits, FALSE AS turns, 0 AS k FROM o WHERE i = 1
UNION ALL SELECT stream, key, i, ord, label, CASE WHEN turns THEN label ELSE shape END, CASE WHEN turns OR label = shape THEN NULL WHEN waits THEN label ELSE pending END, CASE WHEN turns OR label = shape THEN 0 WHEN waits THEN k ELSE n END, switches + CAST(turns AS INTEGER), waits, turns, k
FROM (SELECT *, waits AND k >= 3 AS turns FROM (SELECT o.stream, o.key, o.i, o.ord, o.label, f.shape, f.pending, f.n, f.switches, o.label <> f.shape AND o.sure AS waits, CASE WHEN f.pending = o.label THEN f.n + 1 ELSE 1 END AS k FROM f JOIN o ON o.stream = f.stream AND o.key = f.key AND o.i = f.i + 1))),
held AS (SELECT *, lag(shape) OVER (PARTITION BY stream, key ORDER BY i) AS was FROM f)
SELECT stream, key, ord AS "order", 'init' AS event, label, shape, CAST(0 AS BIGINT) AS pending_count, i AS obs_count, CAST(NULL AS BIGINT) AS switches FROM held WHERE i = 1
UNION ALL SELECT stream, key, ord, 'pending_update', label, was, k, i, NULL FROM held WHERE waits
UNION ALL SELECT stream, key, ord, 'switch_confirmed', label, label, 0, i, NULL FROM held WHERE turns
UNION ALL SELECT stream, key, max(ord), 'state', arg_max_null(pending, i), arg_max(shape, i), arg_max(n, i), max(i), arg_max(switches, i) FROM f GROUP BY stream, key
UNION ALL SELECT stream, key, ord, 'null', label, NULL, NULL, NULL, NULL FROM w WHERE key IS NULL OR ord IS NULL OR label IS NULL""",
}
