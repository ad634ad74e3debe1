"""Sources of recordings: frames with poses, landed pixels, and point files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES = "rec_id string, frame_idx int, ts timestamp, depth_scale double, k array<double>, tcw array<double>, is_kf boolean, has_depth boolean, has_colour boolean, h int, w int"
POINTS = "path string, pid long, x double, y double, z double, r double, g double, b double"


def number_frames(raw: DataFrame, order: str = "ts") -> DataFrame:
    """Frames that have depth and colour, numbered from 0 by recording; others don't advance the number."""
    ok = raw.filter("has_depth AND has_colour")
    return ok.withColumn("frame_idx", F.row_number().over(Window.partitionBy("rec_id").orderBy(order)) - 1)


def first_valid_frame(frames: DataFrame, warmup: int = 10) -> DataFrame:
    """The first valid frame after the warm-up of every recording."""
    return number_frames(frames).filter(F.col("frame_idx") == warmup)


def keyframes(frames: DataFrame, warmup: int = 10, most: int = 300) -> DataFrame:
    """Tracked keyframes after the warm-up, at most `most` a recording, with `keyframe_index` and the pose camera to world `t_wc`.

    A frame without a pose is lost and left out. The pose is an input: it comes from a localisation outside of this library.
    """
    from ..functions.exprs import inverse_rigid

    kf = number_frames(frames).filter((F.col("frame_idx") >= warmup) & F.col("tcw").isNotNull() & F.col("is_kf"))
    kf = kf.withColumn("keyframe_index", F.row_number().over(Window.partitionBy("rec_id").orderBy("frame_idx")))
    return kf.filter(F.col("keyframe_index") <= most).withColumn("t_wc", inverse_rigid("tcw"))


def frame_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, schema: str = FRAMES) -> DataFrame:
    """A landing folder of Parquet files as a stream, for a finite trigger or an endless one."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parse_ply(content: bytes) -> pd.DataFrame:
    """Vertices of a PLY file, ASCII or binary little-endian; colours in 0 to 1, 0 where there are none."""
    head, _, body = content.partition(b"end_header")
    body = body.lstrip(b"\r")[1:]
    lines = head.decode("ascii", "replace").split("\n")
    kind = next((x.split()[1] for x in lines if x.startswith("format")), "ascii")
    n, names, types, inside = 0, [], [], False
    sizes = {"char": "i1", "uchar": "u1", "int8": "i1", "uint8": "u1", "short": "<i2", "ushort": "<u2", "int16": "<i2", "uint16": "<u2", "int": "<i4", "uint": "<u4", "int32": "<i4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
    for x in (line.split() for line in lines):
        if x[:1] == ["element"]:
            inside = x[1] == "vertex"
            n = int(x[2]) if inside else n
        elif x[:1] == ["property"] and inside:
            names.append(x[2])
            types.append(sizes[x[1]])
    if kind == "ascii":
        rows = [line.split() for line in body.decode("ascii", "replace").split("\n")[:n]]
        table = {c: np.array([float(r[i]) for r in rows]) for i, c in enumerate(names)}
    else:
        data = np.frombuffer(body, np.dtype(list(zip(names, types, strict=True))), n)
        table = {c: data[c].astype(float) for c in names}
    out = pd.DataFrame({c: table[c] for c in "xyz"})
    whole = all(c in table for c in ("red", "green", "blue"))
    for c, name in (("r", "red"), ("g", "green"), ("b", "blue")):
        out[c] = table[name] / (255.0 if types[names.index(name)] == "u1" else 1.0) if whole else 0.0
    return out


def read_ply(spark: SparkSession, path: str, pattern: str = "*.ply") -> DataFrame:
    """Points of PLY files, in folders below too, with their path and number in the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, content in zip(pdf["path"], pdf["content"], strict=True):
                p = parse_ply(bytes(content))
                yield p.assign(path=at, pid=range(len(p)))[[c.split()[0] for c in POINTS.split(", ")]]

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, POINTS)
