"""Structured filing snapshots as DataFrames: tagged values, company profiles, filing lists, the company index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import fye_month_from_mmdd
from ..functions.text import cik10
from ..operators.extract import normalize_unit
from ..schemas import FACTS, MONEY

# A number as JSON writes it: sign and digits, decimals, exponent.
NUMBER = r"^(-?\d+)(?:\.(\d*))?(?:[eE]([+-]?\d+))?$"
# The usual ones: no exponent and no more places than MONEY has, so that nothing else has to be taken from the text.
PLAIN = r"^-?\d+(?:\.\d{0,8})?$"
PLACES = 8  # of MONEY

# Values stay text until they are cast, so no digit is lost on the way.
_ROW = "struct<start:string,end:string,val:string,accn:string,form:string,filed:string,frame:string>"
COMPANYFACTS = f"cik string, entityName string, facts map<string,map<string,struct<units:map<string,array<{_ROW}>>>>>"
SUBMISSIONS = (
    "cik string, name string, sic string, sicDescription string, tickers array<string>, exchanges array<string>, fiscalYearEnd string, "
    "filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>>>"
)


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file; a file is the unit of parallelism, as snapshots are published per company."""
    return spark.read.schema(schema).option("multiLine", "true").option("primitivesAsString", "true").json(path)


def parse_snapshots(raw: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """The same from a text column (a bulk archive landed as rows)."""
    keep = [c for c in raw.columns if c != column]
    return raw.select(*keep, F.from_json(column, schema, {"primitivesAsString": "true"}).alias("s")).select(*keep, "s.*")


def flatten_companyfacts(snapshots: DataFrame, company: Column | None = None) -> DataFrame:
    """Tagged rows, each with `malformed` set when a required field is missing or invalid.

    `printed` is the number as published. `refused` is set where it is a number that MONEY cannot hold exactly; its
    value is then null, as values are never rounded. A concept without units yields one malformed row. Nothing is dropped here, so both the good rows and the count of
    bad ones come from one pass.
    """
    who = F.col("cik") if company is None else company
    # The outer form: for the inner one Spark puts a test of `facts` in front of the parser, which then parses once more for each of its terms.
    concepts = (
        snapshots.withColumn("company_id", who).select("company_id", F.explode_outer("facts").alias("taxonomy", "concepts")).filter("taxonomy IS NOT NULL")
        .select("company_id", "taxonomy", F.explode("concepts").alias("concept", "body"))
    )
    units = concepts.select("company_id", "taxonomy", "concept", F.col("body.units").isNull().alias("no_units"), F.explode_outer("body.units").alias("unit", "rows"))
    rows = units.select("*", F.explode_outer("rows").alias("r")).filter("no_units OR r IS NOT NULL")
    return checked(rows.select("company_id", "taxonomy", "concept", "unit", "r.*"))


def checked(tagged: DataFrame) -> DataFrame:
    """Tagged rows as published (company_id, taxonomy, concept, unit, start, end, val, accn, form, filed, frame: text) with
    their values, dates and units, and the flags `malformed` and `refused`. A row without a unit is malformed.

    Rows of `adapters` that have a `problem` are malformed, too.
    """
    written = lambda group: F.regexp_extract("val", NUMBER, group)
    plain = F.coalesce(F.col("val").rlike(PLAIN), F.lit(False))
    is_number = plain | F.coalesce(F.col("val").rlike(NUMBER), F.lit(False))
    places = F.length(F.rtrim(written(2), F.lit("0"))) - F.coalesce(written(3).try_cast("int"), F.lit(0))
    number = F.when(plain | (is_number & (places <= PLACES)), F.col("val").try_cast(MONEY))
    end, filed = F.col("end").try_cast("date"), F.col("filed").try_cast("date")
    has_start = F.coalesce(F.col("start"), F.lit("")) != ""
    start = F.when(has_start, F.col("start").try_cast("date"))
    bad = (
        F.col("unit").isNull() | ~is_number | end.isNull() | filed.isNull() | F.col("form").isNull() | (has_start & start.isNull())
        | ~F.coalesce(F.col("accn").rlike(r"^\d{10}-\d{2}-\d{6}$"), F.lit(False))
    )
    if "problem" in tagged.columns:
        bad = bad | F.col("problem").isNotNull()
    return tagged.select(
        "company_id", "taxonomy", "concept", normalize_unit(F.col("unit")).alias("unit"), number.alias("value"), F.col("val").alias("printed"), start.alias("period_start"),
        end.alias("period_end"), F.col("accn").alias("accession"), "form", filed.alias("filed"), "frame", bad.alias("malformed"), (~bad & number.isNull()).alias("refused"),
    )


def observations_of(flat: DataFrame) -> DataFrame:
    return flat.filter("NOT malformed AND NOT refused").drop("malformed", "refused", "printed")


def malformed_counts(flat: DataFrame) -> DataFrame:
    return flat.groupBy("company_id").agg(F.count_if("malformed").alias("malformed"), F.count_if("refused").alias("refused"), F.count_if(~F.col("malformed") & ~F.col("refused")).alias("observations"))


def invalid_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter(F.col("cik").isNull() | F.col("facts").isNull() | cik10(F.col("cik")).isNull())


def entities_of(submissions: DataFrame) -> DataFrame:
    return submissions.select(
        cik10(F.col("cik")).alias("cik"), "name", F.transform(F.coalesce("tickers", F.array().cast("array<string>")), lambda t: F.upper(t)).alias("tickers"),
        F.filter(F.coalesce("exchanges", F.array().cast("array<string>")), lambda e: e.isNotNull() & (e != "")).alias("exchanges"),
        F.trim("sic").try_cast("int").alias("sic"), F.nullif("sicDescription", F.lit("")).alias("sic_description"),
        fye_month_from_mmdd(F.trim("fiscalYearEnd")).alias("fye_month"),
    )


def filing_index(submissions: DataFrame) -> DataFrame:
    """Parallel arrays to one row per filing."""
    recent = F.arrays_zip("filings.recent.accessionNumber", "filings.recent.form", "filings.recent.filingDate")
    return submissions.select(cik10(F.col("cik")).alias("cik"), F.explode(recent).alias("f")).select(
        "cik", F.col("f.accessionNumber").alias("accession"), "f.form", F.col("f.filingDate").try_cast("date").alias("filed")
    )


def index_rows(raw: DataFrame, fields: tuple[str, ...] = ("cik", "name", "ticker", "exchange")) -> DataFrame:
    """A columnar {fields, data} document (parsed as fields array<string>, data array<array<string>>) to rows."""
    at = {name: F.array_position("fields", name).cast("int") for name in fields}
    rows = raw.select("fields", F.posexplode("data").alias("position", "row"))
    return rows.select("position", *[F.try_element_at("row", p).alias(name) for name, p in at.items()])


def company_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(primary row per company: its first ticker; ticker to company: the first claim wins) from (position, cik, ...)."""
    usable = rows.filter("cik IS NOT NULL AND coalesce(name, '') <> '' AND coalesce(ticker, '') <> ''").select(
        "position", cik10(F.col("cik")).alias("cik"), F.trim("name").alias("name"), F.upper(F.trim("ticker")).alias("ticker"), F.nullif("exchange", F.lit("")).alias("exchange")
    )
    first = usable.groupBy("cik").agg(F.min_by(F.struct("position", "name", "ticker", "exchange"), "position").alias("f")).select("cik", "f.*")
    claims = usable.groupBy("ticker").agg(F.min_by("cik", "position").alias("cik"))
    return first, claims


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Stored facts, read strictly: a malformed line fails the read instead of becoming nulls."""
    return spark.read.schema(FACTS).option("mode", "FAILFAST").json(path)
