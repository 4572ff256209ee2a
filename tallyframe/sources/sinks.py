"""Outputs: exact JSON lines, Parquet datasets, long and wide CSV views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import period_label, period_rank

BUCKETS = 256


def with_bucket(df: DataFrame) -> DataFrame:
    """Companies hashed into a fixed number of folders: partitions stay large however many companies there are."""
    return df.withColumn("company_bucket", F.pmod(F.xxhash64("company_id"), F.lit(BUCKETS)).cast("int"))


def write_facts_json(facts: DataFrame, path: str) -> None:
    ordered = facts.sortWithinPartitions("company_id", "metric_id", "period_end", "fact_id")
    ordered.withColumn("value", F.col("value").cast("string")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def fixed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema (see schemas), in its order and types. A column that is missing or would not fit is an
    error; one the schema does not know is refused as well, as a dataset's columns are a contract."""
    want = df.sparkSession.createDataFrame([], schema).schema
    extra, lacking = sorted(set(df.columns) - set(want.names)), sorted(set(want.names) - set(df.columns))
    if extra or lacking:
        raise ValueError(f"columns do not match the schema: unknown {extra}, missing {lacking}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields])


def write_parquet(df: DataFrame, path: str) -> None:
    """value (double) plus value_exact (text), partitioned by company bucket."""
    exact = F.col("value").cast("string")
    columns = [c for c in df.columns if c != "value_f"]
    out = df.select(*[F.col("value_f").alias("value") if c == "value" and "value_f" in df.columns else F.col(c) for c in columns], exact.alias("value_exact"))
    with_bucket(out).hint("rebalance", "company_bucket").write.mode("overwrite").partitionBy("company_bucket").parquet(path)


def read_analytics(spark, path: str) -> DataFrame:
    """Analytics back from Parquet; the number comes from its exact text."""
    return spark.read.parquet(path).withColumn("value", F.col("value_exact").cast("double")).drop("value_exact", "company_bucket")


def display_value(value: Column, unit: Column, provenance: Column) -> Column:
    """Ten places for a derived ratio, the exact number otherwise, without trailing zeros."""
    text = F.when((unit == "pure") & (provenance == "derived"), value.cast("decimal(38,10)").cast("string")).otherwise(value.cast("string"))
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def long_view(facts: DataFrame) -> DataFrame:
    """Facts as flat rows for CSV: periods as labels, arrays joined."""
    return facts.select(
        "company_id", "metric_id", period_label(F.col("fiscal_year"), F.col("fiscal_period")).alias("period"), "period_type", "period_start", "period_end",
        display_value(F.col("value"), F.col("unit"), F.col("provenance")).alias("value"), "unit", "provenance", "concept", "accession", "form", "filed",
        "fact_id", F.array_join("inputs", " ").alias("inputs"), "formula", "notes",
    )


def wide_view(facts: DataFrame, labels: list[str], codes: tuple[str, ...] = ("FY",)) -> DataFrame:
    """Metric by period. The labels are passed in (see period_labels), so the pivot needs no extra pass over the data."""
    shown = facts.filter(F.col("fiscal_period").isin(*codes)).select(
        "company_id", "metric_id", "unit", period_label(F.col("fiscal_year"), F.col("fiscal_period")).alias("label"),
        display_value(F.col("value"), F.col("unit"), F.col("provenance")).alias("shown"), F.struct(F.col("provenance") == "derived", "period_end").alias("at"),
    )
    return shown.groupBy("company_id", "metric_id").agg(
        F.max_by("unit", "at").alias("unit"), *[F.max_by(F.when(F.col("label") == name, F.col("shown")), F.when(F.col("label") == name, F.col("at"))).alias(name) for name in labels]
    )


def period_labels(facts: DataFrame, codes: tuple[str, ...] = ("FY",)) -> list[str]:
    """The distinct period labels in chronological order: one for each period of the calendar that occurs."""
    found = facts.filter(F.col("fiscal_period").isin(*codes)).select("fiscal_year", "fiscal_period").distinct()
    ordered = found.orderBy("fiscal_year", period_rank(F.col("fiscal_period"))).select(period_label(F.col("fiscal_year"), F.col("fiscal_period")).alias("label"))
    return [r.label for r in ordered.collect()]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
