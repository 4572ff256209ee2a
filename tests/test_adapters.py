import json

import pytest

from tallyframe.sources import adapters, filings

ROW = {"start": "2030-01-01", "end": "2030-03-31", "val": 5.10, "accn": "0000000001-30-000001", "form": "10-Q", "filed": "2030-04-30"}


class Lines(adapters.Adapter):
    """A user's own provider: one value a line."""

    name = "lines"

    def handles(self, url):
        return url.endswith(".lines")

    def rows(self, content, url):
        for line in content.decode().splitlines():
            company, value = line.split()
            yield (company, "own", "Total", "USD", None, "2030-12-31", value, "0000000001-30-000001", "10-K", "2031-02-01", None)


def snapshot(company, *values):
    return json.dumps({"cik": company, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [ROW | {"val": v} for v in values]}}, "None": None}}})


def land(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)


def read(spark, folder, **options):
    adapters.register(spark)
    return spark.read.format("tagged_values").options(**options).load(str(folder))


def test_own_and_shipped_adapters_by_address(spark, tmp_path):
    spark.sparkContext.addPyFile(__file__)
    land(tmp_path / "in", CIK0000000007__json=snapshot(7, 1, 2.5), a__lines="9 1e2\n9 x", b__txt="?", _hidden__json="{")
    found = read(spark, tmp_path / "in", adapters="tallyframe.sources.adapters:CompanyFacts,test_adapters:Lines")
    good = {(r.company_id, float(r.value), r.unit) for r in filings.observations_of(filings.checked(found)).collect()}
    assert good == {("7", 1.0, "USD"), ("7", 2.5, "USD"), ("9", 100.0, "USD")}
    counts = {r.company_id: (r.malformed, r.observations) for r in filings.malformed_counts(filings.checked(found)).collect()}
    assert counts == {"7": (1, 2), "9": (1, 1), None: (1, 0)}
    assert {r.url.rsplit("/", 1)[-1]: r.problem for r in found.filter("problem is not null").collect()} == {"b.txt": "no adapter"}


def test_bad_files_do_not_stop_the_others(spark, tmp_path):
    land(tmp_path / "in", CIK1__json=snapshot(1, 3), CIK2__json=snapshot(1, 4), CIK3__json="{", CIK4__json="[]", CIK5__json="")
    found = read(spark, tmp_path / "in")
    assert [r.company_id for r in filings.observations_of(filings.checked(found)).collect()] == ["1"]
    assert sorted(r.problem.split(":")[0] for r in found.filter("problem is not null").collect()) == ["other company"] * 2 + ["unreadable"] * 3
    assert read(spark, tmp_path / "nowhere").collect() == []


def test_files_are_dealt_by_size():
    files = [adapters.Landed(0, f"f{i}", s) for i, s in enumerate([50, 10, 10, 10, 10, 10, 200])]
    shares = adapters.dealt(files, 100)
    assert sorted(len(s.urls) for s in shares) == [1, 1, 5] and sorted(u for s in shares for u in s.urls) == [f"f{i}" for i in range(7)]
    assert adapters.dealt([], 100) == []


def test_stream_takes_each_file_once(spark, tmp_path):
    adapters.register(spark)
    stream = spark.readStream.format("tagged_values").load(str(tmp_path / "in"))

    def run():
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ckpt").start(f"{tmp_path}/out")
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r.company_id for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").filter("concept = 'Revenues'").collect())

    land(tmp_path / "in", CIK1__json=snapshot(1, 3))
    assert run() == ["1"]
    land(tmp_path / "in", CIK2__json=snapshot(2, 3), CIK3__json=snapshot(3, 3))
    assert run() == ["1", "2", "3"] == run()


@pytest.mark.parametrize("url,want", [("s3://b/CIK0000000012.json", "12"), ("/x/34.json", "34"), ("/x/12345678901.json", None), ("/x/y.json", None)])
def test_identifier_from_the_address(url, want):
    adapter = adapters.find(url, adapters.load(adapters.SHIPPED))
    assert (adapter and adapter.identifier(url)) == want
