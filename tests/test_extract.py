from decimal import Decimal

from helpers import day
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.operators import extract


def observe(spark, rows):
    full = [("co", "us-gaap", c, u, Decimal(str(v)), day(s), day(e), a, f, day(d), None) for c, u, v, s, e, a, f, d in rows]
    return spark.createDataFrame(full, schemas.OBSERVATIONS)


def entity(spark, framework="generic"):
    return spark.createDataFrame([("co", framework, 12, "end_year", "USD")], "company_id string, framework string, fye_month int, convention string, reporting_currency string")


A24, A25, A26 = "0000000001-24-000001", "0000000001-25-000001", "0000000001-26-000001"
ROWS = [
    ("Revenues", "USD", 50, "2023-01-01", "2023-12-31", A24, "10-K", "2024-02-18"),
    ("Revenues", "USD", 50, "2023-01-01", "2023-12-31", A25, "10-K", "2025-02-18"),
    ("Revenues", "USD", 55, "2024-01-01", "2024-12-31", A25, "10-K", "2025-02-18"),
    ("Revenues", "USD", 54.5, "2024-01-01", "2024-12-31", A26, "10-K", "2026-02-17"),
    ("Revenues", "USD", 60, "2025-01-01", "2025-12-31", A26, "8-K", "2026-02-17"),
    ("Revenues", "USD", 60, "2025-01-01", "2025-12-31", A26, "10-K", "2026-02-17"),
    ("RevenueFromContractWithCustomerExcludingAssessedTax", "USD", 59, "2025-01-01", "2025-12-31", A26, "10-K", "2026-02-17"),
    ("Assets", "USD", 10, None, "2025-02-14", A26, "10-K", "2026-02-17"),
    ("EarningsPerShareDiluted", "USD/shares", 5.25, "2025-01-01", "2025-12-31", A26, "10-K", "2026-02-17"),
    ("Liabilities", "shares", 5, None, "2025-12-31", A26, "10-K", "2026-02-17"),
    ("Unheard", "USD", 1, None, "2025-12-31", A26, "10-K", "2026-02-17"),
]


def test_facts_restatements_and_counters(spark, generic):
    mapped = extract.map_observations(observe(spark, ROWS), entity(spark), generic)
    found = extract.disclosures(mapped)
    facts = extract.to_facts(found)
    revenue = {(r.fiscal_year, float(r.value)): r for r in facts.filter("metric_id = 'revenue'").collect()}
    assert set(revenue) == {(2023, 50.0), (2024, 55.0), (2024, 54.5), (2025, 60.0)}
    assert revenue[(2023, 50.0)].accession == A24 and "repeated in 1 later" in revenue[(2023, 50.0)].notes
    eps = facts.filter("metric_id = 'diluted_eps'").first()
    assert (eps.unit, eps.currency) == ("USD/share", "USD")
    now = {r.fiscal_year: float(r.value) for r in extract.current_facts(facts).filter("metric_id = 'revenue'").collect()}
    assert now == {2023: 50.0, 2024: 54.5, 2025: 60.0}
    assert [(r.version, float(r.value)) for r in extract.restatements(found).orderBy("version").collect()] == [(1, 55.0), (2, 54.5)]
    skipped = {r.reason: r.n for r in extract.skip_counts(mapped).collect()}
    assert skipped == {"form_not_accepted:8-K": 1, "period_end_not_fiscal_quarter_end": 1, "unit_incompatible:total_liabilities:shares": 1, "unmapped_concept": 1}
    covered = {r.concept: (r.periods_used, r.periods_shadowed) for r in extract.coverage(found).filter("metric_id = 'revenue'").collect()}
    assert covered == {"us-gaap:Revenues": (3, 0), "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax": (0, 1)}
    total = extract.observation_totals(mapped).first()
    assert (total.observations_total, total.observations_mapped) == (11, 7)


def test_ids_are_stable_and_distinct(spark, generic):
    facts = extract.extract_facts(observe(spark, ROWS), entity(spark), generic)
    again = extract.extract_facts(observe(spark, list(reversed(ROWS))), entity(spark), generic)
    ids = sorted(r.fact_id for r in facts.select("fact_id").collect())
    assert ids == sorted(r.fact_id for r in again.select("fact_id").collect()) and len(set(ids)) == len(ids)
    import hashlib

    want = "fact_" + hashlib.sha256(f"co|revenue|duration|2024-01-01|2024-12-31|FY2024|reported|us-gaap:Revenues|USD|{A26}|54.5".encode()).hexdigest()[:16]
    assert want in ids


def test_loans_stitch_three_concepts(spark, banks):
    rows = [(c, "USD", v, None, f"{y}-12-31", A24, "10-K", "2024-02-18") for c, v, y in (
        ("LoansAndLeasesReceivableNetReportedAmount", 743, 2014), ("LoansReceivableNet", 881, 2016), ("FinancingReceivableExcludingAccruedInterestAfterAllowanceForCreditLoss", 1061, 2021))]
    found = extract.disclosures(extract.map_observations(observe(spark, rows), entity(spark, "banks"), banks))
    assert sorted(float(r.value) for r in extract.to_facts(found).filter("metric_id = 'loans'").collect()) == [743, 881, 1061]
    assert extract.concept_switches(extract.coverage(found)).first().n_concepts == 3


def test_hot_period_is_compacted_before_the_window(spark, generic):
    """Thousands of repeats of one value become one row per filing before anything is grouped by period."""
    one = observe(spark, ROWS[:1])
    many = one.crossJoin(spark.range(5000).select(F.format_string("%010d-20-000001", "id").alias("acc"))).withColumn("accession", F.col("acc")).drop("acc")
    found = extract.disclosures(extract.map_observations(many, entity(spark), generic)).collect()
    assert len(found) == 1 and found[0].repeats == 4999 and found[0].accession == "0000000000-20-000001"
