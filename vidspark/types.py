"""Types and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

DIMENSIONS = ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")

#: A spatio-temporal box; any dimension may be null, which means the box does not have it.
STBOX = T.StructType([*(T.StructField(d, T.DoubleType()) for d in DIMENSIONS), T.StructField("tmin", T.TimestampNTZType()), T.StructField("tmax", T.TimestampNTZType())])
#: A moving point: instants in ascending order of time.
INSTANT = T.StructType([T.StructField("t", T.TimestampNTZType()), *(T.StructField(d, T.DoubleType()) for d in "xyz")])
TPOINT = T.ArrayType(INSTANT)

WORLDS = T.StructType([T.StructField("world_id", T.StringType()), T.StructField("units", T.StringType())])
CAMERAS = T.StructType(
    [
        T.StructField("camera_id", T.StringType()), T.StructField("world_id", T.StringType()), T.StructField("ratio", T.FloatType()),
        T.StructField("origin", T.StructType([T.StructField(d, T.DoubleType()) for d in "xyz"])), T.StructField("focal", T.StructType([T.StructField(d, T.DoubleType()) for d in "xy"])),
        T.StructField("fov", T.IntegerType()), T.StructField("skew_factor", T.FloatType()),
    ]
)
DETECTIONS = T.StructType(
    [T.StructField("camera_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("object_type", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("frame", "x1", "y1", "x2", "y2"))]
)
BBOXES = T.StructType([T.StructField("camera_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("bbox", STBOX)])
TRAJECTORIES = T.StructType(
    [T.StructField("camera_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("object_type", T.StringType()), T.StructField("color", T.StringType()), T.StructField("traj", TPOINT), T.StructField("largest_bbox", STBOX)]
)
