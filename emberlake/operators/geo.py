"""Building geometries: decode, text forms, bounds, validity."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.functions.geometry import decode_all, to_geojson, to_wkt

GEOMETRY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("wkt", "geojson")]
    + [T.StructField(n, T.DoubleType()) for n in ("min_x", "min_y", "max_x", "max_y")]
)
# The box that holds the United Kingdom, in degrees.
UK_WEST, UK_EAST, UK_SOUTH, UK_NORTH = -10.0, 10.0, 49.0, 61.0


@F.pandas_udf(GEOMETRY)
def _decoded(column: pd.Series) -> pd.DataFrame:
    rows = []
    for found in decode_all(bytes(data) if data is not None else None for data in column):
        if found is None:
            rows.append((None, None, None, None, None, None))
            continue
        points = np.concatenate([r for part in found[1] for r in part])
        low, high = points.min(axis=0), points.max(axis=0)
        rows.append((to_wkt(*found), json.dumps(to_geojson(*found)), low[0], low[1], high[0], high[1]))
    return pd.DataFrame(rows, columns=["wkt", "geojson", "min_x", "min_y", "max_x", "max_y"])


def with_geometry(df: DataFrame, column: str = "geom") -> DataFrame:
    """Replace the binary column by ``wkt``, ``geojson`` and bounds; what cannot be read is null.

    Hex text that starts with ``0x`` is accepted too.
    """
    decoded = df.withColumn("__g", _decoded(F.col(column).cast("binary")))
    return decoded.select(*[c for c in df.columns if c != column], "__g.*")


def valid_bounds(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """True inside the UK box; elsewhere false only for a box without extent. Null bounds are invalid."""
    inside = (min_x >= UK_WEST) & (max_x <= UK_EAST) & (min_y >= UK_SOUTH) & (max_y <= UK_NORTH)
    degenerate = (min_x == max_x) & (min_y == max_y)
    return F.when(min_x.isNull(), False).when(inside, True).when(degenerate, False).otherwise(True)


def with_validity(df: DataFrame) -> DataFrame:
    return df.withColumn("is_valid", valid_bounds(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]))


def geometry_counts(df: DataFrame) -> DataFrame:
    """Rows in all, decoded, not decoded, and decoded but invalid."""
    read = F.col("min_x").isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(read).alias("decoded"), F.count_if(~read).alias("undecoded"),
        F.count_if(read & ~F.col("is_valid")).alias("invalid"),
    )
