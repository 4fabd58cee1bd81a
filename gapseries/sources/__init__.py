"""Typed table scans and validated sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapseries.operators.panel import BANDS, MONTHS

from .stored import fingerprint  # noqa: F401


def wide_schema(label: str | None = None, id_col: str = "ID", bands: tuple[str, ...] = BANDS) -> T.StructType:
    """ID as string, the label if there is one, then a double for each month and band, month by month."""
    fields = [T.StructField(id_col, T.StringType())] + ([T.StructField(label, T.IntegerType())] if label else [])
    return T.StructType(fields + [T.StructField(f"{b}_{m:02d}", T.DoubleType()) for m in MONTHS for b in bands])


def read_wide_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A wide table; the header must name the schema's columns in order, and bad cells fail the read."""
    header = spark.read.option("header", True).csv(path).columns
    if header != schema.fieldNames():
        raise ValueError(f"columns differ: {[x for x in zip(header, schema.fieldNames(), strict=False) if x[0] != x[1]][:3]}")
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def check_submission(result: DataFrame, sample: DataFrame) -> dict[str, int]:
    """Counts of what is wrong with a submission; all must be 0."""
    bad = result.agg(
        F.count(F.when(F.col("ID").isNull() | F.col("TargetF1").isNull() | F.col("TargetRAUC").isNull(), 1)).alias("nulls"), (F.count("ID") - F.count_distinct("ID")).alias("repeated"),
        F.count(F.when(~F.col("TargetRAUC").between(0, 1), 1)).alias("out_of_range"), F.count(F.when(F.col("TargetF1") != (F.col("TargetRAUC") >= 0.5).cast("int"), 1)).alias("inconsistent"),
    ).first().asDict()
    ids = sample.select("ID")
    return bad | {"missing": ids.join(result, "ID", "left_anti").count(), "extra": result.join(ids, "ID", "left_anti").count()}


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Never overwrites: an existing target is an error."""
    df.write.mode("errorifexists").format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)
