"""Snapshots are parsed once, and what counts as a number does not depend on how it is tested."""

import contextlib
import io
from decimal import Decimal

from tallyframe.sources import filings


def _flat(spark, *texts):
    raw = spark.createDataFrame([(t,) for t in texts], "json string")
    return filings.flatten_companyfacts(filings.parse_snapshots(raw, filings.COMPANYFACTS))


def test_snapshots_are_parsed_once(spark):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        filings.observations_of(_flat(spark, "{}")).explain()
    assert shown.getvalue().count("from_json") == 1


def test_snapshots_without_facts_give_no_rows(spark):
    assert _flat(spark, '{"cik": 1}', '{"cik": 2, "facts": {}}', '{"cik": 3, "facts": {"us-gaap": {}}}', '{"cik": 4, "facts": null}', "no json", None).count() == 0


def test_plain_and_other_numbers(spark):
    rows = [(v, "c", "USD", "", "2030-03-31", "0000000001-30-000001", "10-Q", "2030-04-30") for v in (
        "12", "-0.5", "1.", "1.12345678", "1.1234567800", "1.123456789", "1e3", "15E-1", "1E21", "123456789012345678901", "NaN", "1,000", "+1", ".5", " 1", None)]
    tagged = spark.createDataFrame(rows, "val string, concept string, unit string, start string, end string, accn string, form string, filed string").selectExpr("*", "'co' company_id", "'t' taxonomy", "'' frame")
    found = {r.printed: (r.value, r.malformed, r.refused) for r in filings.checked(tagged).collect()}
    good = {"12": "12", "-0.5": "-0.5", "1.": "1", "1.12345678": "1.12345678", "1.1234567800": "1.12345678", "1e3": "1000", "15E-1": "1.5"}
    assert {k: v for k, v in found.items() if k in good} == {k: (Decimal(v), False, False) for k, v in good.items()}
    assert {k for k, v in found.items() if v[2]} == {"1.123456789", "1E21", "123456789012345678901"}
    assert {k for k, v in found.items() if v[1]} == {"NaN", "1,000", "+1", ".5", " 1", None}
