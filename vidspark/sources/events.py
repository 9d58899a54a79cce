"""Moving objects from a table of events, and cameras from nations: the tables that queries and tests run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import CAMERAS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a box of the object (type, user) at its time."""
    k = F.get_json_object("props", "$.k").cast("int").cast("double")
    return read(spark, sf_dir, "events").select(
        "event_id", F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("item_id"), F.col("event_type").alias("object_type"), F.col("ts").cast("timestamp_ntz").alias("t"),
        F.col("value").alias("x1"), k.alias("y1"), (F.col("value") + 1 + F.col("event_id") % 7).alias("x2"), (k + 1 + F.col("event_id") % 5).alias("y2"),
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera per nation, in the world of its region."""
    none = F.lit(None).cast("double")
    nation = read(spark, sf_dir, "nation")
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    out = nation.select(F.col("n_name").alias("camera_id"), F.col("n_regionkey").cast("string").alias("world_id"), F.lit(0.5).cast("float").alias("ratio"), origin.alias("origin"), F.struct(none.alias("x"), none.alias("y")).alias("focal"), (60 + 2 * F.col("n_nationkey")).cast("int").alias("fov"), F.lit(0.0).cast("float").alias("skew_factor"))
    return out.select(*CAMERAS.fieldNames())
