"""The jobs: results against SQL, reruns, and growing input."""

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import object_inventory, switch_log
from jobs.common import settings
from jobs.queries import ORACLE_SQL, QUERIES

from .test_catalog import rows_of, same
from .test_switches import plain

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLE_SQL[name])
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got_names == want_names and len(got) == len(want) > 0
    assert all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


CONFIG = {"times": 3, "streams": [{"name": "tracks", "table": "events", "key": "user_id", "order": "event_id", "label": "event_type", "sure": "value >= 20"}]}


def _log(spark, out):
    return sorted((r.key, r.order, r.event, r.label, r.shape, r.pending_count, r.obs_count) for r in switch_log.read(spark, out, "log").collect())


def _standing(spark, out):
    return {r.key: ((r.shape, r.pending, r.pending_count), r.switches, r.obs_count, r.last) for r in switch_log.latest(spark, out).collect()}


def test_switch_log_over_growing_input(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    tables, out, checkpoint = f"file://{tmp_path}/tables", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"

    def land(df):
        df.coalesce(1).write.mode("append").parquet(f"{tables}/events.parquet")

    def run():
        return switch_log.run(spark, tables, out, checkpoint, CONFIG)["tracks"]

    land(events.filter("event_id < 600"))
    first = run()
    assert first["batches"] == 1 and first["read"] == 600 and first["rejected"] == 0
    before = _log(spark, out)
    assert run() == {"batches": 0, "read": 0, "log": 0, "states": 0, "rejected": 0} and _log(spark, out) == before
    land(events.filter("event_id >= 600"))
    land(events.filter("event_id BETWEEN 10 AND 12").withColumn("value", F.lit(99.0)))  # these come too late
    land(events.limit(1).withColumn("event_type", F.lit(None).cast("string")).withColumn("event_id", F.lit(10**6).cast("long")))
    second = run()
    assert second["batches"] == 1 and second["read"] == events.count() - 600 + 4 and second["rejected"] == 4
    states, told = plain([(str(r.user_id), r.event_id, r.event_type, r.value >= 20) for r in events.collect()])
    assert _log(spark, out) == [e for e in told if e[2] != "infer"]
    assert _standing(spark, out) == states
    assert sorted(r.reason for r in switch_log.read(spark, out, "rejected").collect()) == ["late"] * 3 + ["null"]


def test_a_batch_that_is_tried_again_writes_the_same(spark, tmp_path):
    events, out = spark.read.parquet(f"{SF}/events.parquet"), f"file://{tmp_path}/out"
    stream = CONFIG["streams"][0]
    switch_log.take(events.filter("event_id < 500"), 0, out, stream, 3)
    switch_log.take(events.filter("event_id >= 500"), 1, out, stream, 3)
    log, states = _log(spark, out), _standing(spark, out)
    assert states == plain([(str(r.user_id), r.event_id, r.event_type, r.value >= 20) for r in events.collect()])[0]
    switch_log.take(events.filter("event_id >= 500"), 1, out, stream, 3)
    assert _log(spark, out) == log and _standing(spark, out) == states
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_inventory_reruns_and_odd_rows(spark, tmp_path):
    out, at = f"file://{tmp_path}/out", f"file://{tmp_path}/points"
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    size = len(table.first().embedding)
    odd = [(10**6 + i, [float(i % 3), 0.1 * i, 0.0] + [0.5] * (size - 3), 77) for i in range(5)] + [(None, [0.0] * size, 3), (10**7, [float("nan")] * size, 3), (10**7 + 1, None, 3), (10**7 + 2, [0.0] * size, None)]
    table.unionByName(spark.createDataFrame(odd, table.select("vec_id", "embedding", "label").schema)).write.parquet(at)
    config = settings("object_inventory")
    first = object_inventory.run(spark, at, out, config)
    rows = sorted(map(tuple, object_inventory.read(spark, out).collect()))
    assert first["points"] == table.count() + 5
    assert object_inventory.run(spark, at, out, config) == first and sorted(map(tuple, object_inventory.read(spark, out).collect())) == rows
    few = object_inventory.read(spark, out).filter("obj = 77").first()
    assert few.status == "too_few_points" and few.raw == 5
    assert spark.read.parquet(out).filter("status = 'ok'").inputFiles()[0].split("/")[-2] == "status=ok"


def test_inventory_of_nothing(spark, tmp_path):
    out, at = f"file://{tmp_path}/out", f"file://{tmp_path}/points"
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(at)
    assert object_inventory.run(spark, at, out, settings("object_inventory")) == {"points": 0, "objects": {}}


def test_command_line(tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps(CONFIG))
    call = [sys.executable, "-m", "jobs.switch_log", "--tables", SF, "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "checkpoint"), "--config", str(config)]
    for batches in (1, 0):
        done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
        assert json.loads(done.stdout.strip().splitlines()[-1])["tracks"]["batches"] == batches
        assert ("wrote" if batches else "nothing new") in done.stderr
