"""Companies, registry, filings, documents, views and refresh, over the tables and what Spark derives from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, display
from ..operators import analytics, checks, derive, documents, entities, extract, registry, summary
from ..plans import views
from ..session import shared_folder, stage
from ..sources import adapters, filings, sinks, specs, tables
from ..streaming import refresh
from .common import annual, annual_current, current, dbl, disclosed, frameworks, sql
from .facts_set import _CUM, _FYREV, _SWING, _events


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- companies --------------------------------------------------------------------------------------------------


def sic_classify(spark, sf):
    part = _read(spark, sf, "part")
    rows = part.select(F.col("p_partkey"), F.when(F.col("p_partkey") % 13 != 0, (F.lit(6000) + F.col("p_size")).cast("int")).alias("sic"), F.when(F.col("p_partkey") % 20 == 0, "software").alias("override"))
    return entities.classify(rows, specs.shipped()).select("p_partkey", "selected", "method", "evidence")


SIC = """
SELECT p_partkey, CASE WHEN p_partkey % 20 = 0 THEN 'software' WHEN bank THEN 'banks' ELSE 'generic' END AS selected,
  CASE WHEN p_partkey % 20 = 0 THEN 'config_override' WHEN bank THEN 'sic_match' ELSE 'fallback' END AS method,
  CASE WHEN p_partkey % 20 = 0 THEN 'industry_framework: software in config' || CASE WHEN bank THEN ' (note: SIC ' || sic || ' suggests banks)' ELSE '' END
    WHEN sic IS NULL THEN 'no SIC code available' WHEN bank THEN 'SIC ' || sic ELSE 'SIC ' || sic || ' matches no specific framework' END AS evidence
FROM (SELECT *, coalesce(sic BETWEEN 6020 AND 6029 OR sic BETWEEN 6035 AND 6036, false) AS bank FROM (SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN 6000 + p_size END AS sic FROM part))
"""

_QUERIES = ("P12", "small", "widget", "red  ring", "Ring", "zzz")


def entity_search(spark, sf):
    part = _read(spark, sf, "part")
    index = part.select(F.col("p_partkey").alias("position"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("name"))
    return entities.search(index, list(_QUERIES))


SEARCH = """
SELECT query, CAST(place AS INTEGER) AS place, ticker, name, tier FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, p_partkey) AS place FROM (
  SELECT q.q AS query, p_partkey, 'P' || p_partkey AS ticker, p_name AS name, CASE WHEN 'P' || p_partkey = upper(q.q) THEN 0 WHEN starts_with(lower(p_name), lower(q.q)) OR starts_with(lower('P' || p_partkey), lower(q.q)) THEN 1
    WHEN contains(lower(p_name), lower(q.q)) THEN 2 END AS tier FROM part CROSS JOIN (VALUES ('P12'), ('small'), ('widget'), ('red ring'), ('Ring'), ('zzz')) q(q)) WHERE tier IS NOT NULL) WHERE place <= 8
"""


def entity_search_index(spark, sf):
    """Pieces of every twentieth name, short and long, and some fixed queries, answered from an index of grams."""
    part = _read(spark, sf, "part")
    index = part.select(F.col("p_partkey").alias("position"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("name"))
    k = F.col("p_partkey")
    asked = part.filter(k % 20 == 0).select(F.substr(F.upper("p_name"), (k % 7 + 1).cast("int"), (k % 9 + 1).cast("int")).alias("query"))
    asked = asked.unionByName(index.filter("position % 50 = 0").select(F.concat(F.lit("  p"), F.col("position").cast("string"), F.lit(" ")).alias("query"))).unionByName(spark.createDataFrame([(q,) for q in _QUERIES], "query string"))
    return entities.search_index(asked, index, stage(entities.gram_index(index), "grams"))


SEARCH_INDEX = """
WITH q AS (SELECT DISTINCT trim(regexp_replace(q, '\\s+', ' ', 'g')) AS q FROM (SELECT substr(upper(p_name), CAST(p_partkey % 7 + 1 AS INTEGER), CAST(p_partkey % 9 + 1 AS INTEGER)) AS q FROM part WHERE p_partkey % 20 = 0
   UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT * FROM (VALUES ('P12'), ('small'), ('widget'), ('red ring'), ('Ring'), ('zzz')) f(q)))
SELECT query, CAST(place AS INTEGER) AS place, ticker, name, tier FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, p_partkey) AS place FROM (
  SELECT q.q AS query, p_partkey, 'P' || p_partkey AS ticker, p_name AS name, CASE WHEN 'P' || p_partkey = upper(q.q) THEN 0 WHEN starts_with(lower(p_name), lower(q.q)) OR starts_with(lower('P' || p_partkey), lower(q.q)) THEN 1
    WHEN contains(lower(p_name), lower(q.q)) THEN 2 END AS tier FROM part CROSS JOIN q WHERE q.q <> '') WHERE tier IS NOT NULL) WHERE place <= 8
"""


def company_index(spark, sf):
    part = _read(spark, sf, "part")
    rows = part.select(F.col("p_partkey").alias("position"), (F.col("p_partkey") % 300).cast("string").alias("cik"), F.col("p_name").alias("name"),
                       F.when(F.col("p_partkey") % 17 != 0, F.col("p_brand")).alias("ticker"), F.col("p_type").alias("exchange"))
    primary, claims = filings.company_index(rows)
    return primary.select("cik", "name", "ticker", "exchange").join(claims.groupBy("cik").agg(F.count("*").alias("tickers")), "cik", "left").fillna(0, ["tickers"])


COMPANY_INDEX = """
WITH r AS (SELECT p_partkey AS pos, lpad(CAST(p_partkey % 300 AS VARCHAR), 10, '0') AS cik, p_name AS name, upper(p_brand) AS ticker, p_type AS exchange FROM part WHERE p_partkey % 17 <> 0),
c AS (SELECT cik, count(*) AS n FROM (SELECT ticker, arg_min(cik, pos) AS cik FROM r GROUP BY 1) GROUP BY 1)
SELECT cik, arg_min(name, pos) AS name, arg_min(ticker, pos) AS ticker, arg_min(exchange, pos) AS exchange, coalesce(any_value(n), 0) AS tickers FROM r LEFT JOIN c USING (cik) GROUP BY cik
"""


def framework_overlay(spark, sf):
    part = _read(spark, sf, "part")
    depth = (F.col("p_partkey") % 3).cast("int").alias("depth")
    items = part.groupBy(F.col("p_type").alias("group_id"), F.col("p_name").alias("item_id"), depth).agg(F.min("p_partkey").alias("payload"))
    removals = part.filter("p_partkey % 7 = 0 AND p_partkey % 3 > 0").select(F.col("p_type").alias("group_id"), F.col("p_name").alias("item_id"), depth).distinct()
    return specs.overlay(items, removals).select("group_id", "item_id", "depth", "payload")


OVERLAY = """
WITH items AS (SELECT p_type AS group_id, p_name AS item_id, CAST(p_partkey % 3 AS INTEGER) AS depth, min(p_partkey) AS payload FROM part GROUP BY 1, 2, 3),
cut AS (SELECT p_type AS group_id, p_name AS item_id, max(p_partkey % 3) AS cut_at FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 3 > 0 GROUP BY 1, 2)
SELECT group_id, item_id, depth, payload FROM items LEFT JOIN cut USING (group_id, item_id) WHERE cut_at IS NULL OR depth >= cut_at
QUALIFY row_number() OVER (PARTITION BY group_id, item_id ORDER BY depth DESC) = 1
"""


# ---- registry ---------------------------------------------------------------------------------------------------


def doc_versions(spark, sf):
    """Documents of a source in order: a new version wherever the text changes. One source may hold most documents, so
    the order is cut into ranges of ids."""
    docs = _read(spark, sf, "documents").select("source", "doc_id", F.sha2("text", 256).alias("hash"))
    found = registry.source_versions(docs, ["source"], ["doc_id"], F.floor(F.col("doc_id") / 4096))
    return found.select("source", "doc_id", "version", "is_current")


DOC_VERSIONS = """
SELECT source, doc_id, row_number() OVER w AS version, row_number() OVER w = count(*) OVER (PARTITION BY source) AS is_current FROM (
  SELECT source, doc_id, sha256(text) AS h, lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents) WHERE p IS NULL OR p <> h WINDOW w AS (PARTITION BY source ORDER BY doc_id)
"""


def status_audit(spark, sf):
    events = _read(spark, sf, "events")
    names = F.array(*[F.lit(s) for s in ("registered", "retrieved", "parsed", "extracted", "failed", "superseded")])
    history = events.select(F.col("user_id").alias("document_id"), "event_id", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("status"))
    found = registry.forbidden_transitions(history, F.floor(F.col("event_id") / 4096), ["event_id"])
    return found.select("document_id", "event_id", "before", "after")


STATUS_AUDIT = """
SELECT document_id, event_id, before, after FROM (SELECT user_id AS document_id, event_id, s AS after, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (
  SELECT *, ['registered', 'retrieved', 'parsed', 'extracted', 'failed', 'superseded'][event_id % 6 + 1] AS s FROM events))
WHERE before IS NOT NULL AND before || '>' || after NOT IN ('registered>retrieved', 'registered>failed', 'retrieved>parsed', 'retrieved>failed', 'retrieved>superseded', 'parsed>extracted', 'parsed>failed',
  'parsed>superseded', 'extracted>parsed', 'extracted>failed', 'extracted>superseded', 'failed>registered')
"""


def stale_stages(spark, sf):
    """What a stage recorded against what is there now: some suppliers' lines changed, some vanished, some are new."""
    lines = _read(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "company_id")
    recorded = registry.fingerprint(lines.filter("company_id % 7 <> 0"), ["company_id"])
    now = lines.filter("company_id % 11 <> 0").withColumn("l_tax", F.when((F.col("company_id") % 10 == 0) & (F.col("l_linenumber") == 1), F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    return registry.stale(recorded, registry.fingerprint(now, ["company_id"]), ["company_id"])


STALE = """
SELECT DISTINCT l_suppkey AS company_id, CASE WHEN l_suppkey % 7 = 0 THEN 'not_recorded' WHEN l_suppkey % 11 = 0 THEN 'data_missing' ELSE 'changed' END AS why FROM lineitem
WHERE (l_suppkey % 7 = 0 AND l_suppkey % 11 <> 0) OR (l_suppkey % 11 = 0 AND l_suppkey % 7 <> 0) OR (l_suppkey % 10 = 0 AND l_suppkey % 7 <> 0 AND l_suppkey % 11 <> 0 AND l_linenumber = 1)
"""


# ---- filings ----------------------------------------------------------------------------------------------------


def _snapshots(spark, sf) -> DataFrame:
    """Company snapshots in the published JSON shape, made from quarter sums. Some rows are deliberately malformed."""
    q = tables.quarters(spark, sf)
    start, end = F.make_date(F.col("y"), F.col("q") * 3 - 2, F.lit(1)), F.last_day(F.make_date(F.col("y"), F.col("q") * 3, F.lit(1)))
    row = lambda measure: F.struct(
        start.cast("string").alias("start"), F.when((F.col("y") == 1997) & (F.col("q") == 2), F.lit("not a date")).otherwise(end.cast("string")).alias("end"),
        # One quarter is no number, one has ten places and one has 22 digits: the last two are exact numbers that do not fit.
        F.when((F.col("y") == 1998) & (F.col("q") == 3), F.lit("NaN")).when((F.col("y") == 1996) & (F.col("q") == 1), F.lit("0.1234567891"))
        .when((F.col("y") == 1996) & (F.col("q") == 2), F.lit("1E21")).otherwise(F.col(measure).cast("string")).alias("val"),
        F.when((F.col("y") == 1999) & (F.col("q") == 1), F.lit("bad")).otherwise(tables.accession(F.col("co"), F.col("y"), F.col("q"))).alias("accn"),
        F.lit("10-Q").alias("form"), F.date_add(end, 40).cast("string").alias("filed"), F.lit(None).cast("string").alias("frame"))
    per_company = q.groupBy("co").agg(F.collect_list(row("net")).alias("net"), F.collect_list(row("qty")).alias("qty"))  # at most a few years of quarters
    units = lambda unit, rows: F.named_struct(F.lit("units"), F.create_map(F.lit(unit), rows))
    facts = F.create_map(F.lit("us-gaap"), F.create_map(
        F.lit("Revenues"), units("USD", F.col("net")), F.lit("SharesIssued"), units("USD-per-shares", F.col("qty")),
        F.lit("Empty"), F.lit(None).cast("struct<units:map<string,array<struct<start:string,end:string,val:string,accn:string,form:string,filed:string,frame:string>>>>")))
    return per_company.select(F.to_json(F.struct(F.col("co").alias("cik"), F.concat(F.lit("Supplier "), F.col("co").cast("string")).alias("entityName"), facts.alias("facts"))).alias("json"))


def companyfacts_flatten(spark, sf):
    flat = filings.flatten_companyfacts(filings.parse_snapshots(_snapshots(spark, sf), filings.COMPANYFACTS))
    return filings.observations_of(flat).select("company_id", "concept", "unit", dbl("value"), "period_start", "period_end", "accession", "filed")


COMPANYFACTS = sql(
    """
SELECT CAST(co AS VARCHAR) AS company_id, c.c AS concept, c.u AS unit, round(CASE c.c WHEN 'Revenues' THEN CAST(net AS DOUBLE) ELSE CAST(qty AS DOUBLE) END, 4) AS value, make_date(y, 3*q - 2, 1) AS period_start,
  last_day(make_date(y, 3*q, 1)) AS period_end, printf('%010d-%02d-%06d', co, y % 100, q) AS accession, last_day(make_date(y, 3*q, 1)) + 40 AS filed
FROM qs CROSS JOIN (VALUES ('Revenues', 'USD'), ('SharesIssued', 'USD/shares')) c(c, u) WHERE NOT (y = 1997 AND q = 2) AND NOT (y = 1998 AND q = 3) AND NOT (y = 1999 AND q = 1) AND NOT (y = 1996 AND q <= 2)
"""
)


def _landed(spark, sf) -> str:
    """The snapshots as files, one company each, written by tasks. Some are there once more cut off, or under another
    company's name, and there are files that no adapter reads."""
    folder = f"{shared_folder(spark)}/adapters-{uuid.uuid4().hex}"
    co = F.get_json_object("json", "$.cik").cast("long")
    file = lambda prefix, number: F.concat(F.lit(f"{prefix}CIK"), F.lpad(number.cast("string"), 10, "0"), F.lit(".json"))
    kinds = F.array(
        F.struct(file("", co).alias("name"), F.col("json").alias("json")), F.when(co % 10 == 0, F.struct(file("cut-", co).alias("name"), F.left("json", F.lit(60)).alias("json"))),
        F.when(co % 7 == 0, F.struct(file("moved-", co + 1_000_000).alias("name"), F.col("json").alias("json"))), F.when(co % 15 == 0, F.struct(F.concat(F.lit("notes-"), co.cast("string"), F.lit(".txt")).alias("name"), F.lit("a note").alias("json"))))
    named = _snapshots(spark, sf).select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("k.name", "k.json")

    def write(rows):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(base, recursive=True)
        for batch in rows:
            for name, text in zip(batch["name"], batch["json"]):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(text.encode())
            yield batch[["name"]]

    named.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    return folder


def adapter_observations(spark, sf):
    """The same snapshots as files, read by an adapter: the observations of companyfacts_flatten."""
    adapters.register(spark)
    flat = filings.checked(spark.read.format("tagged_values").option("minPartitions", 2 * spark.sparkContext.defaultParallelism).load(_landed(spark, sf)))
    return filings.observations_of(flat).select("company_id", "concept", "unit", dbl("value"), "period_start", "period_end", "accession", "filed")


def adapter_stream(spark, sf):
    """The files as a stream into the table of distinct observations; its own batches, not the files, are what is restarted."""
    adapters.register(spark)
    landing = _landed(spark, sf)
    stream = spark.readStream.format("tagged_values").load(landing)
    table = f"{landing}-observations"
    query = refresh.append_new_observations(stream, table, f"{landing}-ckpt", lambda df: filings.observations_of(filings.checked(df)), available_now=False)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return refresh.read_observations(spark, table).groupBy("company_id", "concept").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))


def adapter_problems(spark, sf):
    """Files whose rows are not used, with the reason."""
    adapters.register(spark)
    raw = spark.read.format("tagged_values").load(_landed(spark, sf))
    return raw.filter("problem is not null").select(F.element_at(F.split("url", "/"), -1).alias("file"), "adapter", F.substring_index("problem", ":", 1).alias("problem")).distinct()


ADAPTER_PROBLEMS = sql(
    """
SELECT DISTINCT printf('cut-CIK%010d.json', co) AS file, 'companyfacts' AS adapter, 'unreadable' AS problem FROM qs WHERE co % 10 = 0
UNION ALL SELECT DISTINCT printf('moved-CIK%010d.json', co + 1000000), 'companyfacts', 'other company' FROM qs WHERE co % 7 = 0
UNION ALL SELECT DISTINCT printf('notes-%d.txt', co), NULL, 'no adapter' FROM qs WHERE co % 15 = 0
"""
)


def malformed_counts(spark, sf):
    return filings.malformed_counts(filings.flatten_companyfacts(filings.parse_snapshots(_snapshots(spark, sf), filings.COMPANYFACTS)))


MALFORMED = sql(
    """
SELECT CAST(co AS VARCHAR) AS company_id, 1 + 2 * count(*) FILTER (bad) AS malformed, 2 * count(*) FILTER (wide) AS refused, 2 * count(*) FILTER (NOT bad AND NOT wide) AS observations
FROM (SELECT co, y = 1996 AND q <= 2 AS wide, (y = 1997 AND q = 2) OR (y = 1998 AND q = 3) OR (y = 1999 AND q = 1) AS bad FROM qs) GROUP BY co
"""
)


def submissions_profile(spark, sf):
    """Profiles from JSON: upper-case tickers, numeric SIC or none, the fiscal year end with its seven-day spillover."""
    c = _read(spark, sf, "customer")
    k = F.col("c_custkey")
    mmdd = F.concat(F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    raw = c.select(F.to_json(F.struct(
        k.cast("string").alias("cik"), F.col("c_name").alias("name"), F.when(k % 3 == 0, "n/a").otherwise((k % 9000 + 100).cast("string")).alias("sic"),
        F.array(F.lower("c_mktsegment")).alias("tickers"), F.array(F.lit("X"), F.lit("")).alias("exchanges"), F.when(k % 50 == 0, "9999").otherwise(mmdd).alias("fiscalYearEnd"),
        F.struct(F.struct(F.array(tables.accession(k, F.lit(20), F.lit(1)), tables.accession(k, F.lit(21), F.lit(2))).alias("accessionNumber"), F.array(F.lit("10-K"), F.lit("10-Q")).alias("form"),
                          F.array(F.lit("2020-02-20"), F.lit("2021-05-10")).alias("filingDate")).alias("recent")).alias("filings"))).alias("json"))
    parsed = filings.parse_snapshots(raw, filings.SUBMISSIONS)
    index = filings.filing_index(parsed).groupBy("cik").agg(F.max_by("form", "filed").alias("latest_form"), F.max("filed").alias("latest_filed"))
    return filings.entities_of(parsed).join(index, "cik").select(
        "cik", "name", F.array_join("tickers", ",").alias("tickers"), F.size("exchanges").alias("n_exchanges"), "sic", "fye_month", "latest_form", "latest_filed")


SUBMISSIONS = """
SELECT lpad(CAST(k AS VARCHAR), 10, '0') AS cik, c_name AS name, c_mktsegment AS tickers, 1 AS n_exchanges, CAST(CASE WHEN k % 3 <> 0 THEN k % 9000 + 100 END AS INTEGER) AS sic,
  CAST(CASE WHEN k % 50 <> 0 THEN CASE WHEN k % 28 + 1 <= 7 THEN CASE WHEN k % 12 = 0 THEN 12 ELSE k % 12 END ELSE k % 12 + 1 END END AS INTEGER) AS fye_month, '10-Q' AS latest_form, DATE '2021-05-10' AS latest_filed
FROM (SELECT *, c_custkey AS k FROM customer)
"""


# ---- documents --------------------------------------------------------------------------------------------------


def _findings(spark, sf):
    """Reports of suppliers with printed figures in thousands; every fourth is tampered with, every thirteenth supplier's
    were filed by someone else."""
    facts = stage(annual_current(spark, sf, ["revenue", "cost_of_revenue"]), "known")
    co = F.substring("company_id", 4, 20).cast("long")
    copies = facts.select("*", co.alias("co"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("k"))
    shown = copies.filter("k < 2 OR fiscal_year >= 2000")
    printed = (F.round(F.col("value") / 1000, 0) * 1000).cast("decimal(28,8)")
    tampered = ((F.col("co") + F.col("k")) % 4 == 0) & (F.col("fiscal_year") < 1998)
    doc_id = F.col("co") * 10 + F.col("k")
    found = shown.select(
        doc_id.alias("doc_id"), "company_id", "framework", "metric_id", F.lit(False).alias("check_only"), F.lit("currency").alias("unit_kind"), F.lit("USD").alias("reporting_currency"), "period_type", "fiscal_year",
        "fiscal_period", F.when(tampered, (F.col("value") * 2 + 5000).cast("decimal(28,8)")).otherwise(printed).alias("value"), F.lit(500).cast("decimal(28,8)").alias("tolerance"), F.lit("html_table").alias("method"),
        F.lit("Table 1").alias("place"), F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end"))
    docs = copies.select(doc_id.alias("doc_id"), "co", "k").distinct().select(
        "doc_id", F.when(F.col("co") % 13 == 0, "mismatch").when((F.col("co") % 3 == 0) & (F.col("k") == 1), "match").otherwise("not_stated").alias("identity"),
        F.when(F.col("k") == 1, tables.accession(F.col("co"), F.lit(20), F.lit(1))).alias("accession"), F.make_date(F.lit(2002), F.col("k") + 1, F.lit(1)).alias("filed"),
        F.lit("2020-01-01").cast("timestamp").alias("added_at"))
    return facts, docs, found


def doc_verdict(spark, sf):
    facts, docs, found = _findings(spark, sf)
    return documents.verdicts(docs, found, documents.compare(found, facts)).select("doc_id", "status", "found", "checked", "agreed", "reason")


_VERDICT = f"""known AS (SELECT co, y, 'revenue' AS m, CAST({_FYREV} AS DOUBLE) AS v FROM ann UNION ALL SELECT co, y, 'cost_of_revenue', CAST(disc AS DOUBLE) FROM ann),
f AS (SELECT co, k.k, co * 10 + k.k AS doc_id, y, m, CASE WHEN (co + k.k) % 4 = 0 AND y < 1998 THEN abs(v + 5000) <= greatest(abs(v) * 0.005, 500) ELSE abs(v - round(v / 1000, 0) * 1000) <= greatest(abs(v) * 0.005, 500) END AS ok
  FROM known CROSS JOIN (VALUES (0), (1), (2)) k(k) WHERE k.k < 2 OR y >= 2000),
d AS (SELECT doc_id, any_value(co) AS co, any_value(k) AS k, count(*) AS checked, count(*) FILTER (ok) AS agreed FROM f GROUP BY 1),
v AS (SELECT *, CASE WHEN co % 13 = 0 THEN 'rejected' WHEN checked >= 3 THEN CASE WHEN agreed / checked >= 0.9 THEN 'verified' ELSE 'rejected' END WHEN co % 3 = 0 AND k = 1 THEN 'verified' ELSE 'unverified' END AS status FROM d)"""
DOC_VERDICT = sql(
    """
SELECT doc_id, status, checked AS found, checked, agreed, CASE WHEN co % 13 = 0 THEN 'It was filed by another company.' WHEN checked >= 3 AND status = 'verified' THEN 'Agrees on ' || agreed || ' of ' || checked || ' shared figures.'
  WHEN checked >= 3 THEN 'Disagrees on ' || (checked - agreed) || ' of ' || checked || ' shared figures.' WHEN status = 'verified' THEN 'Filed by this company.' ELSE 'Too few shared figures to check it, so its numbers are not used.' END AS reason FROM v
""",
    _VERDICT,
)


def gap_fill(spark, sf):
    """Structured data lacks FY1999 revenue; verified documents supply it, the best one per company."""
    facts, docs, found = _findings(spark, sf)
    known = facts.filter("NOT (metric_id = 'revenue' AND fiscal_year = 1999)")
    judged = documents.verdicts(docs, found, documents.compare(found, known))
    filled = documents.gap_fill(found, judged, known, docs)
    made = documents.filled_facts(filled, tables.entities(spark, sf), known)
    return made.select("company_id", "metric_id", "fiscal_year", dbl("value"), F.col("document_id").cast("long").alias("doc_id"), "period_start", "period_end", "unit")


GAP_FILL = sql(
    """
SELECT 'co-' || v.co AS company_id, 'revenue' AS metric_id, 1999 AS fiscal_year, round(round(r.v / 1000, 0) * 1000, 4) AS value, v.doc_id, DATE '1999-01-01' AS period_start, DATE '1999-12-31' AS period_end, 'USD' AS unit
FROM (SELECT * FROM w WHERE k < 2 QUALIFY row_number() OVER (PARTITION BY co ORDER BY k DESC) = 1) v JOIN rev r ON r.co = v.co AND r.y = 1999
""",
    _VERDICT,
    """w AS (SELECT * FROM (SELECT doc_id, any_value(co) AS co, any_value(k) AS k, count(*) AS checked, count(*) FILTER (ok) AS agreed FROM f WHERE NOT (m = 'revenue' AND y = 1999) GROUP BY 1)
  WHERE co % 13 <> 0 AND ((checked >= 3 AND agreed / checked >= 0.9) OR (checked < 3 AND co % 3 = 0 AND k = 1)))""",
)


def _pages(spark, sf) -> DataFrame:
    """An annual report per supplier and year: a printed table with spanning headings, and inline tags."""
    years = tables._year_to_date(spark, sf, False).filter("i = 4")
    from pyspark.sql import Window

    before = F.lag(F.struct("y", "net", "disc")).over(Window.partitionBy("co").orderBy("y"))
    rows = years.withColumn("b", before).filter(F.col("b.y") == F.col("y") - 1)
    # A page is a few numbers here and long to read, so rows are spread by what readers can do at once and not by their bytes.
    rows = rows.repartition(2 * spark.sparkContext.defaultParallelism, "co", "y")
    thousand = lambda c: F.format_number(F.round(F.col(c) / 1000, 0).cast("long"), 0)
    html = F.format_string(
        "<!DOCTYPE html><html><body><xbrli:context id=\"d\"><xbrli:period><xbrli:startDate>%1$s-01-01</xbrli:startDate><xbrli:endDate>%1$s-12-31</xbrli:endDate></xbrli:period></xbrli:context>"
        "<xbrli:unit id=\"u\"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><ix:nonNumeric name=\"dei:EntityCentralIndexKey\" contextRef=\"d\">%2$s</ix:nonNumeric>"
        "<ix:nonFraction name=\"us-gaap:IncomeTaxExpenseBenefit\" contextRef=\"d\" unitRef=\"u\" scale=\"3\" format=\"ixt:num-dot-decimal\">%3$s</ix:nonFraction>"
        "<ix:nonFraction name=\"us-gaap:IncomeTaxExpenseBenefit\" contextRef=\"none\" unitRef=\"u\">1</ix:nonFraction>"
        "<p>Consolidated results (in thousands)</p><table><tr><td rowspan=\"2\"></td><td colspan=\"4\">Year ended December 31,</td></tr><tr><td colspan=\"2\">%1$s</td><td colspan=\"2\">%4$s</td></tr>"
        "<tr><td>Revenue (a)</td><td>$</td><td>%5$s</td><td>$</td><td>%6$s</td></tr><tr><td>Cost&nbsp;of revenue:</td><td></td><td>(%7$s)</td><td></td><td>%8$s</td></tr></table></body></html>",
        F.col("y").cast("string"), F.when(F.col("co") % 13 == 0, "0000099999").otherwise(F.lpad(F.col("co").cast("string"), 10, "0")), thousand("tax"), F.col("b.y").cast("string"),
        thousand("net"), thousand("b.net"), thousand("disc"), thousand("b.disc"))
    return rows.select((F.col("co") * 10000 + F.col("y")).alias("doc_id"), F.concat(F.lit("co-"), F.col("co").cast("string")).alias("company_id"), F.lpad(F.col("co").cast("string"), 10, "0").alias("expected_cik"), html.alias("html"))


def table_cells(spark, sf):
    found = documents.table_cells(_pages(spark, sf).drop("expected_cik"))
    return found.select("doc_id", "table_no", "row_key", F.col("year"), F.col("value").cast("double").alias("value"), F.col("scale").cast("double").alias("scale"), "heading", "percent")


_PAGES = """p AS (SELECT co * 10000 + y AS doc_id, * FROM (SELECT co, y, lag(y) OVER w AS py, net, disc, tax, lag(net) OVER w AS pn, lag(disc) OVER w AS pd FROM ann WINDOW w AS (PARTITION BY co ORDER BY y)) WHERE py = y - 1),
cells AS (SELECT doc_id, co, c.r AS row_key, CAST(y - c.o AS INTEGER) AS year, CASE c.r WHEN 'revenue' THEN round(CASE c.o WHEN 0 THEN net ELSE pn END / 1000, 0) ELSE CASE c.o WHEN 0 THEN -1 ELSE 1 END * round(CASE c.o WHEN 0 THEN disc ELSE pd END / 1000, 0) END AS value
  FROM p CROSS JOIN (VALUES ('revenue', 0), ('revenue', 1), ('cost of revenue', 0), ('cost of revenue', 1)) c(r, o))"""
TABLE_CELLS = sql(
    "SELECT doc_id, 1 AS table_no, row_key, year, CAST(value AS DOUBLE) AS value, 1000.0::DOUBLE AS scale, 'Year ended December 31, ' || year AS heading, false AS percent FROM cells", _PAGES
)


def inline_tags(spark, sf):
    found = documents.inline_tags(_pages(spark, sf).drop("expected_cik"))
    return found.select("doc_id", "concept", F.col("value").cast("double").alias("value"), "unit", "period_start", "period_end", "skipped")


INLINE_TAGS = sql(
    """
SELECT doc_id, 'us-gaap:IncomeTaxExpenseBenefit' AS concept, CAST(round(tax / 1000, 0) * 1000 AS DOUBLE) AS value, 'USD' AS unit, make_date(y, 1, 1) AS period_start, make_date(y, 12, 31) AS period_end, false AS skipped FROM p
UNION ALL SELECT doc_id, 'us-gaap:IncomeTaxExpenseBenefit', 1.0, 'USD', NULL, NULL, true FROM p
""",
    _PAGES,
)


def corpus_report(spark, sf):
    """Reports studied end to end: tags and tables, identity, agreement with the structured facts."""
    pages = stage(_pages(spark, sf), "pages")
    found = stage(documents.study(pages, tables.entities(spark, sf), frameworks()), "findings")
    facts = annual_current(spark, sf, ["revenue", "income_tax_expense"])
    who = documents.identities(pages)
    judged = documents.verdicts(who, found, documents.compare(found, facts))
    return documents.corpus_report(who, judged, documents.gap_fill(found, judged, facts, who.select("doc_id", F.lit(None).cast("string").alias("accession"), F.lit(None).cast("date").alias("filed"), F.lit(None).cast("timestamp").alias("added_at")))).select(
        "doc_id", "identity", "status", "found", "checked", "agreed", "contributed")


CORPUS = sql(
    """
SELECT doc_id, CASE WHEN co % 13 = 0 THEN 'mismatch' ELSE 'match' END AS identity, CASE WHEN co % 13 = 0 OR agreed / 3 < 0.9 THEN 'rejected' ELSE 'verified' END AS status, 5 AS found, 3 AS checked, agreed, 0 AS contributed
FROM (SELECT p.doc_id, p.co, (abs(CAST(p.tax AS DOUBLE) - round(p.tax / 1000, 0) * 1000) <= abs(CAST(p.tax AS DOUBLE)) * 0.005)::INT
   + (abs(a.v - round(p.net / 1000, 0) * 1000) <= greatest(abs(a.v) * 0.005, 500))::INT + (abs(b.v - round(p.pn / 1000, 0) * 1000) <= greatest(abs(b.v) * 0.005, 500))::INT AS agreed
  FROM p JOIN rev a ON a.co = p.co AND a.y = p.y JOIN rev b ON b.co = p.co AND b.y = p.y - 1)
""",
    _PAGES,
)


# ---- views ------------------------------------------------------------------------------------------------------


def statement_view(spark, sf):
    facts = annual(spark, sf, ["revenue", "cost_of_revenue", "total_assets"])
    lines = views.statement_view(facts, frameworks())
    return lines.select("company_id", "statement_label", "name", "currency", F.array_join(F.transform("years", lambda y: F.concat_ws(":", y["fiscal_year"].cast("string"), F.when(y["derived"], "D").otherwise("R"))), " ").alias("years"),
                        F.round(F.element_at("years", -1)["value"], 2).alias("latest"))


STATEMENT = sql(
    """
SELECT company_id, CASE WHEN m = 'Total assets' THEN 'Balance sheet' ELSE 'Income statement' END AS statement_label, m AS name, CASE WHEN any_value(co) % 10 = 3 THEN 'EUR' ELSE 'USD' END AS currency,
  string_agg(y || ':' || CASE WHEN m = 'Gross profit' THEN 'D' ELSE 'R' END, ' ' ORDER BY y) AS years, round(arg_max(v, y), 2) AS latest
FROM (SELECT company_id, co, y, 'Revenue' AS m, v FROM rev UNION ALL SELECT company_id, co, y, 'Cost of revenue', CAST(disc AS DOUBLE) FROM ann
  UNION ALL SELECT r.company_id, r.co, r.y, 'Gross profit', v - CAST(disc AS DOUBLE) FROM rev r JOIN ann USING (co, y) UNION ALL SELECT company_id, co, y, 'Total assets', CAST(gross + CASE WHEN co % 9 = 0 THEN 5000 ELSE 0 END AS DOUBLE) FROM cum)
GROUP BY 1, 2, 3
""",
    _CUM,
)


def wide_annual(spark, sf):
    facts = annual(spark, sf, ["revenue", "cost_of_revenue"])
    years = sinks.period_labels(facts)  # a column for every year there is
    wide = sinks.wide_view(facts, years)
    return wide.select("company_id", "metric_id", "unit", *[F.round(F.col(y).cast("double"), 4).alias(y.lower()) for y in years])


WIDE_ANNUAL = sql(
    "SELECT company_id, m AS metric_id, CASE WHEN any_value(co) % 10 = 3 THEN 'EUR' ELSE 'USD' END AS unit, " + ", ".join(f"round(max(v) FILTER (y = {y}), 4) AS fy{y}" for y in range(1995, 2002))
    + f" FROM (SELECT company_id, co, y, 'revenue' AS m, CAST({_FYREV} AS DOUBLE) AS v FROM ann UNION ALL SELECT company_id, co, y, 'cost_of_revenue', CAST(disc AS DOUBLE) FROM ann UNION ALL SELECT company_id, co, y, 'gross_profit', CAST({_FYREV} - disc AS DOUBLE) FROM ann) GROUP BY 1, 2"
)


def overview_counts(spark, sf):
    found = stage(disclosed(spark, sf, ["revenue"]), "disclosed")
    facts = extract.to_facts(found)
    now = stage(extract.current_facts(facts), "current")
    derived = derive.interim_facts(derive.interim_events(now, frameworks()))
    return views.overview(tables.entities(spark, sf), facts=facts, current=now, derived=derived)


OVERVIEW = sql(
    "SELECT company_id, count(*) * 4 + count(*) FILTER (co % 5 = 0 AND net <> net_r) AS n_facts, count(*) * 4 AS n_current, count(*) * 4 AS n_derived FROM ann GROUP BY 1"
)


def chart_data(spark, sf):
    """Plotted ids joined back to their own fiscal years: shorter series do not slide."""
    events = _events(spark, sf, ["revenue", "total_assets"], ["revenue_growth", "asset_turnover"], ("gap",))
    values = stage(analytics.analytic_values(events), "values")
    plotted = values.groupBy("company_id", F.lit("growth").alias("chart_id"), F.col("analytic_id").alias("series_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fiscal_year", "value_id"))), lambda p: p["value_id"]).alias("lineage_ids"))
    facts = stage(annual_current(spark, sf, ["revenue"], ("gap",)), "facts")
    levels = facts.groupBy("company_id", F.lit("levels").alias("chart_id"), F.col("metric_id").alias("series_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fiscal_year", "fact_id"))), lambda p: p["fact_id"]).alias("lineage_ids"))
    points = views.chart_points(plotted.unionByName(levels), facts, values)
    return points.select("company_id", "series_id", "fiscal_year", F.round("value", 6).alias("value"))


CHART_DATA = sql(
    """SELECT company_id, series_id, CAST(y AS INTEGER) AS fiscal_year, x AS value FROM (
  SELECT company_id, 'revenue' AS series_id, y, round(v, 6) AS x FROM revgap
  UNION ALL SELECT company_id, 'revenue_growth' AS series_id, y, round(v / pv - 1, 6) AS x FROM (SELECT company_id, y, v, lag(v) OVER w AS pv, lag(y) OVER w AS py FROM revgap WINDOW w AS (PARTITION BY company_id ORDER BY y)) WHERE py = y - 1 AND pv > 0 AND v > 0
  UNION ALL SELECT a.company_id, 'asset_turnover', a.y, round(v / ((g + pg) / 2), 6) FROM (SELECT company_id, co, y, g, lag(g) OVER (PARTITION BY co ORDER BY y) AS pg FROM (SELECT *, CAST(gross + CASE WHEN co % 9 = 0 THEN 5000 ELSE 0 END AS DOUBLE) AS g FROM cum)) a
    JOIN revgap r ON r.co = a.co AND r.y = a.y WHERE pg IS NOT NULL)""",
    _CUM,
)


def chart_status(spark, sf):
    series = summary.metric_series(annual(spark, sf, ["revenue", "operating_cash_flow", "capital_expenditure"], ("gap",)))
    return summary.chart_status(series, views.charts(spark, frameworks()))


CHART_STATUS = sql(
    """
SELECT company_id, c.c AS chart_id, c.n AS series_drawn, CASE WHEN count(*) < 2 THEN 'fewer_than_two_points' END AS skipped
FROM ann CROSS JOIN (VALUES ('revenue', 1), ('cash_flow', 2)) c(c, n) WHERE NOT (c.c = 'revenue' AND co % 6 = 0 AND y = 1998) GROUP BY company_id, c.c, c.n
"""
)


def refusal_sentences(spark, sf):
    events = _events(spark, sf, ["revenue", "operating_income"], ["revenue_growth", "operating_income_growth"], ("gap",)).filter("reason IS NOT NULL")
    told = display.explain(events.select("framework", "company_id", "analytic_id", "fiscal_year", "reason"), display.name_table(spark, frameworks()))
    return told.groupBy("analytic_id", "text").agg(F.count("*").alias("n"))


REFUSALS = sql(
    """
SELECT analytic_id, text, count(*) AS n FROM (
 SELECT 'revenue_growth' AS analytic_id, CASE WHEN py IS NULL THEN 'It needs a prior year, and this is the first year on record.' WHEN py <> y - 1 THEN 'No prior-year figure for revenue.'
   WHEN pv <= 0 OR v <= 0 THEN 'Revenue was zero or negative in one of the years compared, so a growth rate would not be meaningful.' END AS text FROM (SELECT company_id, y, v, lag(v) OVER w AS pv, lag(y) OVER w AS py FROM revgap WINDOW w AS (PARTITION BY company_id ORDER BY y))
 UNION ALL SELECT 'operating_income_growth', CASE WHEN ps IS NULL THEN 'It needs a prior year, and this is the first year on record.' WHEN ps <= 0 OR s <= 0 THEN 'Operating income was zero or negative in one of the years compared, so a growth rate would not be meaningful.' END
   FROM (SELECT *, lag(s) OVER (PARTITION BY co ORDER BY y) AS ps FROM sw)) WHERE text IS NOT NULL GROUP BY 1, 2
""",
    _SWING,
)


def _money(v: str) -> str:
    return f"'$' || CASE WHEN {v} >= 1e9 THEN printf('%,.1f', ({v}) / 1e9) || 'bn' WHEN {v} >= 1e6 THEN printf('%,d', CAST(round_even(({v}) / 1e6, 0) AS BIGINT)) || 'm' ELSE printf('%,.2f', {v}) END"


def issue_sentences(spark, sf):
    facts = stage(current(spark, sf, ["revenue", "total_assets", "total_liabilities", "total_equity"], ("gap",)), "current")
    issues = checks.identity_issues(checks.identity_events(facts, frameworks())).unionByName(checks._issue(
        checks.missing_years(facts).filter("outcome = 'failed'"), "missing_years", "warning", details=[F.lit("missing"), F.array_join(F.col("missing").cast("array<string>"), ",")]))
    told = views.checks_view(issues, tables.entities(spark, sf), display.name_table(spark, frameworks()))
    return told.select("company_id", "check_label", "severity_label", display.period_words(F.col("period")).alias("period"), "text")


ISSUE_SENTENCES = sql(
    """
SELECT company_id, 'Balance sheet balances' AS check_label, 'Review' AS severity_label, 'FY' || y AS period,
  'Total assets (' || """ + _money("a + 5000") + """ || ') doesn''t equal total liabilities plus total equity (' || """ + _money("a") + """ || '); the difference is $5,000.00. Often legitimate: reported equity can exclude non-controlling interests and temporary equity, which some companies report on separate lines.' AS text
  FROM (SELECT company_id, co, y, CAST(gross AS DOUBLE) AS a FROM cum) WHERE co % 9 = 0
UNION ALL SELECT company_id, 'No missing years', 'Review', '', 'Revenue has no annual figure for FY1998.' FROM revgap WHERE co % 6 = 0 GROUP BY company_id HAVING min(y) < 1998 AND max(y) > 1998
""",
    _CUM,
)


def display_amounts(spark, sf):
    orders = _read(spark, sf, "orders")
    v = F.col("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 100000).when(F.col("o_orderkey") % 3 == 1, 50).otherwise(0.001)
    kind = F.when(F.col("o_orderkey") % 4 == 0, "count").otherwise("currency")
    return orders.select("o_orderkey", display.amount(F.round(v, 0), kind, F.when(F.col("o_orderkey") % 5 == 0, "EUR").otherwise("USD")).alias("text"), display.date_words(F.to_date("o_orderdate")).alias("on_day"))


_N = "CAST(CAST(v AS BIGINT) AS DECIMAL(38,6))"
DISPLAY = f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN v >= 1e6 THEN printf('%,.1f', v / 1e6) || 'm' ELSE printf('%,.2f', v) END
  ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'EUR ' ELSE '$' END || CASE WHEN v >= 1e9 THEN printf('%,.1f', v / 1e9) || 'bn' WHEN v >= 1e6 THEN printf('%,d', CAST(round_even(v / 1e6, 0) AS BIGINT)) || 'm' ELSE printf('%,.2f', v) END END AS text,
  strftime(o_orderdate, '%-d %b %Y') AS on_day
FROM (SELECT *, round(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 100000 WHEN o_orderkey % 3 = 1 THEN 50 ELSE 0.001 END, 0) AS v FROM orders)
"""


# ---- refresh ----------------------------------------------------------------------------------------------------


def stream_current_view(spark, sf):
    """Events as disclosures, arriving in any order: the newest per user and type stays."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(source).option("pathGlobFilter", "events.parquet").parquet(sf).select("user_id", "event_type", "event_id", "ts", "value")
    refresh.current_view_updates(stream, ["user_id", "event_type"], ["ts", "event_id"], f"{folder}/log", f"{folder}/ckpt").awaitTermination()
    return refresh.read_current_view(spark, f"{folder}/log", ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def stream_merged_runs(spark, sf):
    """The same events in a dozen batches, in no order: runs are merged in between, and what is read is the same view."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = _read(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    events.repartition(12, "event_id").write.parquet(f"{folder}/landing")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landing")
    refresh.current_view_updates(stream, ["user_id", "event_type"], ["ts", "event_id"], f"{folder}/log", f"{folder}/ckpt").awaitTermination()
    return refresh.read_current_view(spark, f"{folder}/log", ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


STREAM_CURRENT = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def stream_snapshots(spark, sf):
    """The same companies' snapshots arrive three times, at first without a good row, then with most quarters, then with all: every observation is stored once."""
    folder = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    snapshots = stage(_snapshots(spark, sf), "snapshots")
    broken = snapshots.withColumn("json", F.regexp_replace("json", r'"end":"', '"end":"x'))
    earlier = snapshots.withColumn("json", F.regexp_replace("json", r'"end":"2001-', '"end":"x'))
    files = max(4, spark.sparkContext.defaultParallelism)  # a batch is all files of one arrival, read by as many tasks as there are cores
    for batch in (broken, earlier, snapshots):
        batch.repartition(files).write.mode("append").parquet(f"{folder}/landing")
    stream = spark.readStream.schema("json string").option("maxFilesPerTrigger", files).parquet(f"{folder}/landing")
    flatten = lambda df: filings.observations_of(filings.flatten_companyfacts(filings.parse_snapshots(df, filings.COMPANYFACTS)))
    refresh.append_new_observations(stream, f"{folder}/observations", f"{folder}/ckpt", flatten).awaitTermination()
    return refresh.read_observations(spark, f"{folder}/observations").groupBy("company_id", "concept").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))


STREAM_SNAPSHOTS = sql(
    """
SELECT CAST(co AS VARCHAR) AS company_id, c.c AS concept, count(*) AS n, round(sum(CASE c.c WHEN 'Revenues' THEN CAST(net AS DOUBLE) ELSE CAST(qty AS DOUBLE) END), 2) AS total
FROM qs CROSS JOIN (VALUES ('Revenues'), ('SharesIssued')) c(c) WHERE NOT (y = 1997 AND q = 2) AND NOT (y = 1998 AND q = 3) AND NOT (y = 1999 AND q = 1) AND NOT (y = 1996 AND q <= 2) GROUP BY 1, 2
"""
)


def nominal_periods(spark, sf):
    """Nominal fiscal year ends for year-labelled values of companies on every calendar."""
    c = _read(spark, sf, "customer")
    fye, convention = (F.col("c_custkey") % 12 + 1).cast("int"), F.when(F.col("c_custkey") % 2 == 0, "start_year").otherwise("end_year")
    return c.select("c_custkey", calendar.nominal_year_end((F.lit(1990) + F.col("c_custkey") % 30).cast("int"), fye, convention).alias("period_end"))


NOMINAL = """
SELECT c_custkey, last_day(make_date(CAST(1990 + c_custkey % 30 + CASE WHEN c_custkey % 2 = 0 AND c_custkey % 12 <> 11 THEN 1 ELSE 0 END AS INTEGER), CAST(c_custkey % 12 + 1 AS INTEGER), 1)) AS period_end FROM customer
"""

QUERIES = {
    "sic_classify": (sic_classify, SIC),
    "entity_search": (entity_search, SEARCH),
    "entity_search_index": (entity_search_index, SEARCH_INDEX),
    "company_index": (company_index, COMPANY_INDEX),
    "framework_overlay": (framework_overlay, OVERLAY),
    "doc_versions": (doc_versions, DOC_VERSIONS),
    "status_audit": (status_audit, STATUS_AUDIT),
    "stale_stages": (stale_stages, STALE),
    "companyfacts_flatten": (companyfacts_flatten, COMPANYFACTS),
    "adapter_observations": (adapter_observations, COMPANYFACTS),
    "adapter_problems": (adapter_problems, ADAPTER_PROBLEMS),
    "adapter_stream": (adapter_stream, STREAM_SNAPSHOTS),
    "malformed_counts": (malformed_counts, MALFORMED),
    "submissions_profile": (submissions_profile, SUBMISSIONS),
    "doc_verdict": (doc_verdict, DOC_VERDICT),
    "gap_fill": (gap_fill, GAP_FILL),
    "table_cells": (table_cells, TABLE_CELLS),
    "inline_tags": (inline_tags, INLINE_TAGS),
    "corpus_report": (corpus_report, CORPUS),
    "statement_view": (statement_view, STATEMENT),
    "wide_annual": (wide_annual, WIDE_ANNUAL),
    "overview_counts": (overview_counts, OVERVIEW),
    "chart_data": (chart_data, CHART_DATA),
    "chart_status": (chart_status, CHART_STATUS),
    "refusal_sentences": (refusal_sentences, REFUSALS),
    "issue_sentences": (issue_sentences, ISSUE_SENTENCES),
    "display_amounts": (display_amounts, DISPLAY),
    "nominal_periods": (nominal_periods, NOMINAL),
    "stream_current_view": (stream_current_view, STREAM_CURRENT),
    "stream_merged_runs": (stream_merged_runs, STREAM_CURRENT),
    "stream_snapshots": (stream_snapshots, STREAM_SNAPSHOTS),
}
