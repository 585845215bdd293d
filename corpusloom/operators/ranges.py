"""Line ranges: their union, and the innermost range that holds a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_union(rows: DataFrame, by: str = "document_id") -> DataFrame:
    """(by, start_line, end_line): maximal ranges; those that touch are merged."""
    order = Window.partitionBy(by).orderBy("start_line", "end_line")
    before = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start_line") > before + 1), 1).otherwise(0)
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = rows.select(by, "start_line", "end_line").withColumn("_new", new).withColumn("_island", island)
    return found.groupBy(by, "_island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("_island")


def fragments(requests: DataFrame) -> DataFrame:
    """(document_id, address, start_line, end_line): each request's delivered fragment."""
    whole = range_union(requests).withColumnsRenamed({"start_line": "low", "end_line": "high"})
    found = requests.join(whole, "document_id").where("start_line >= low AND end_line <= high")
    return found.select("document_id", "address", F.col("low").alias("start_line"), F.col("high").alias("end_line"))


def innermost(points: DataFrame, ranges: DataFrame, by: str = "document_id") -> DataFrame:
    """(by, line, start_line): of the ranges that hold a line the one that begins last."""
    r = ranges.select(F.col(by).alias("_k"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    inside = (F.col(by) == F.col("_k")) & (F.col("line") >= F.col("_a")) & (F.col("line") <= F.col("_b"))
    return points.join(r, inside, "left").groupBy(by, "line").agg(F.max("_a").alias("start_line"))
