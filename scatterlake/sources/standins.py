"""Driver tables read as measurements. The mapping is a stand-in; results have no physical meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.session import table

SIDE = 8


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return rows.withColumn("v", F.col("v").cast("double"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pattern(vec_id, r, seg, i, n): 8 radii x 8 segments for each point; -1 is missing."""
    missing = (F.col("vec_id") * 7 + F.col("k")) % 23 == 0
    return _values(spark, sf_dir).select(
        "vec_id",
        F.expr(f"CAST(k div {SIDE} AS INT)").alias("r"),
        (F.col("k") % SIDE).cast("int").alias("seg"),
        F.when(missing, -1.0).otherwise(F.abs("v") * 100 + 1).alias("i"),
        (1 + F.col("k") % 3).cast("int").alias("n"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame(vec_id, row, col, counts): 8 x 8 pixels."""
    return _values(spark, sf_dir).select(
        "vec_id",
        F.expr(f"CAST(k div {SIDE} AS INT)").alias("row"),
        (F.col("k") % SIDE).cast("int").alias("col"),
        F.floor(F.abs("v") * 1000).cast("double").alias("counts"),
    )


PATTERN_SQL = """SELECT vec_id, CAST(k // 8 AS INTEGER) AS r, CAST(k % 8 AS INTEGER) AS seg,
  CASE WHEN (vec_id * 7 + k) % 23 = 0 THEN -1e0 ELSE abs(CAST(v AS DOUBLE)) * 100 + 1 END AS i, CAST(1 + k % 3 AS INTEGER) AS n
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings)"""
FRAME_SQL = """SELECT vec_id, CAST(k // 8 AS INTEGER) AS row, CAST(k % 8 AS INTEGER) AS col, floor(abs(CAST(v AS DOUBLE)) * 1000) AS counts
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings)"""
