import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    from tallyframe.session import build_session

    session = build_session("llm-tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, uid string, block int, size string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text[, lang[, source]]) as documents, with extra columns whose names the operators use themselves."""

    def build(rows, partitions=3):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, *[None] * (4 - len(row)))
            full.append((doc_id, text, lang, source, None if text is None else len(text), "r", None, 7, "s"))
        return spark.createDataFrame(full, DOCS).repartition(partitions) if full else spark.createDataFrame([], DOCS)

    return build
