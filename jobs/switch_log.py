"""Log of confirmed switches, kept up as new rows land: what a track is taken for changes only when another label was surely seen several times.

The rule is that of the tracker, which takes an object for another shape only after `times` sure sightings. The settings name the tables that are
watched by it: the observations of tracked objects, and the text documents, whose sources are tracks, their languages the label, and a long text
a sure sighting: a source that turns from one language to another is to be noticed, one stray document is not.

Each table is a file stream with a checkpoint: a run takes the files that have landed since the last one, all of them in one micro-batch, and ends.
Within a batch rows are put in order by the stream's order column; a row that is not newer than what its track has seen already is not folded but
kept in `rejected`, as are rows without a key, an order or a label. Three Parquet datasets are written below `out`, all partitioned by stream and batch:

    log       what happened: init, pending_update, switch_confirmed
    states    every track that the batch saw, as it is after it; the latest batch of a track counts
    rejected  rows that were no observations, with the reason

A batch reads the states of earlier batches and overwrites its own partitions, so a batch that is tried again, after whatever failure, writes the same.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.streaming import switches

from .common import main

log = logging.getLogger("jobs.switch_log")

TOLD = ("init", "pending_update", "switch_confirmed")
SCHEMAS = {
    "log": f"key string, {switches.EVENT}, stream string, batch long",
    "states": f"key string, {switches.STATE}, stream string, batch long",
    "rejected": "key string, order long, label string, sure boolean, reason string, stream string, batch long",
}


def observations(rows: DataFrame, stream: dict) -> DataFrame:
    """(key, order, label, sure) of a table's rows."""
    return rows.select(F.expr(stream["key"]).cast("string").alias("key"), F.expr(stream["order"]).cast("long").alias("order"), F.expr(stream["label"]).cast("string").alias("label"), F.expr(stream["sure"]).alias("sure"))


def read(spark: SparkSession, out: str, dataset: str) -> DataFrame:
    """One of the datasets that run() wrote."""
    return spark.read.schema(SCHEMAS[dataset]).parquet(f"{out}/{dataset}")


def latest(spark: SparkSession, out: str) -> DataFrame:
    """(stream, key, STATE): every track as it stands."""
    return switches.latest(read(spark, out, "states"), ["stream", "key"], "batch")


def take(rows: DataFrame, batch: int, out: str, stream: dict, times: int) -> dict[str, int]:
    """Folds the rows of a batch into the tracks of its stream and writes what came of it."""
    spark, name = rows.sparkSession, stream["name"]
    before = None
    if batch:
        known = read(spark, out, "states").filter((F.col("stream") == name) & (F.col("batch") < batch))
        before = switches.latest(known, ["key"], "batch")
    got = switches.advance(observations(rows, stream), ["key"], times, before, TOLD)
    written = {}
    for dataset, df in (("log", got.events), ("states", got.states), ("rejected", got.rejected)):
        to = df.withColumns({"stream": F.lit(name), "batch": F.lit(batch).cast("long")}).select(*[c.split()[0] for c in SCHEMAS[dataset].split(", ")])
        to.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch").parquet(f"{out}/{dataset}")
        written[dataset] = read(spark, out, dataset).filter((F.col("stream") == name) & (F.col("batch") == batch)).count()
    return written


def run(spark: SparkSession, tables: str, out: str, checkpoint: str, config: dict) -> dict:
    """Takes what has landed in the watched tables since the last run and brings the log of switches up to date."""
    done: dict[str, dict] = {}
    for stream in config["streams"]:
        name, path = stream["name"], f"{tables}/{stream['table']}.parquet"
        told = done[name] = {"batches": 0, "read": 0, "log": 0, "states": 0, "rejected": 0}

        def batch(rows: DataFrame, number: int, stream=stream, told=told, path=path) -> None:
            written = take(rows, number, out, stream, config["times"])
            n = rows.count()
            log.info("stream %s, batch %d: read %d rows of %s, wrote %s to %s", stream["name"], number, n, path, written, out)
            for k, v in ({"batches": 1, "read": n} | written).items():
                told[k] += v

        source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern it may be a file as well as a folder
        query = source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        if not told["batches"]:
            log.info("stream %s: nothing new in %s", name, path)
    return done


if __name__ == "__main__":
    main("switch_log", run, {"tables": "folder of the watched tables, <table>.parquet each", "out": "folder of the three datasets", "checkpoint": "folder that remembers which files were taken"})
