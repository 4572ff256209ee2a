from __future__ import annotations

import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from helpers import SPANS, day
from tallyframe import schemas
from tallyframe.session import build_session
from tallyframe.sources import specs

@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def frameworks():
    return specs.shipped()


@pytest.fixture(scope="session")
def generic(frameworks):
    return {"generic": frameworks["generic"]}


@pytest.fixture(scope="session")
def banks(frameworks):
    return {"banks": frameworks["banks"]}


@pytest.fixture(scope="session")
def make_facts(spark):
    """rows of (metric, period such as 'FY2024' or 'Q1-2024', value[, overrides]) to a facts DataFrame."""

    def build(rows, framework="generic", company="co", instants=(), currency="USD"):
        out = []
        for i, (metric, period, value, *rest) in enumerate(rows):
            over = rest[0] if rest else {}
            code, year = ("FY", int(period[2:])) if period.startswith("FY") else (period[:2], int(period[3:]))
            start, end = (day(f"{year}-{s}") for s in SPANS[code])
            instant = metric in instants
            row = {
                "fact_id": f"fact_{i:016x}", "company_id": company, "framework": framework, "metric_id": metric, "value": Decimal(str(value)), "value_f": float(value),
                "unit": currency, "currency": currency, "period_type": "instant" if instant else "duration", "period_start": None if instant else start, "period_end": end,
                "fiscal_year": year, "fiscal_period": code, "provenance": "reported", "method": "xbrl", "document_id": "doc_1", "concept": "us-gaap:X",
                "accession": "0000000001-20-000001", "form": "10-K", "filed": day("2020-01-01"), "inputs": [], "formula": None, "notes": None,
            } | over
            out.append(tuple(row[c] for c in schemas.FACT_COLUMNS))
        return spark.createDataFrame(out, schemas.FACTS)

    return build
