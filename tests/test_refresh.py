"""Streaming ingest: empty first batches, replays, and reads limited to the buckets a batch touches."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.schemas import OBSERVATIONS
from tallyframe.sources import filings
from tallyframe.streaming import refresh

ROW = ("us-gaap", "Revenues", "USD", Decimal("5.00000000"), dt.date(2030, 1, 1), dt.date(2030, 3, 31), "0000000001-30-000001", "10-Q", dt.date(2030, 4, 30), None)


def land(spark, path, companies):
    spark.createDataFrame([(c, *ROW) for c in companies], OBSERVATIONS).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, only=lambda df: df):
    stream = spark.readStream.schema(OBSERVATIONS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/landing")
    refresh.append_new_observations(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint", only).awaitTermination()
    return sorted(r.company_id for r in refresh.read_observations(spark, f"{tmp_path}/table").collect())


def test_batches_without_good_rows(spark, tmp_path):
    keep = lambda df: df.filter("company_id <> 'bad'")
    assert refresh.read_observations(spark, f"{tmp_path}/table").count() == 0
    land(spark, f"{tmp_path}/landing", ["bad"])
    assert run(spark, tmp_path, keep) == []
    land(spark, f"{tmp_path}/landing", ["a", "b", "a"])
    assert run(spark, tmp_path, keep) == ["a", "b"]
    land(spark, f"{tmp_path}/landing", ["bad"])
    land(spark, f"{tmp_path}/landing", ["b", "c"])
    assert run(spark, tmp_path, keep) == ["a", "b", "c"]
    compact = refresh.compact_observations(spark, f"{tmp_path}/table", f"{tmp_path}/compact")
    assert sorted(r.company_id for r in compact.collect()) == ["a", "b", "c"]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    import shutil

    land(spark, f"{tmp_path}/landing", ["a"])
    run(spark, tmp_path)
    land(spark, f"{tmp_path}/landing", ["a", "b"])
    assert run(spark, tmp_path) == ["a", "b"]
    shutil.rmtree(f"{tmp_path}/checkpoint/commits")  # as if it had ended before the commit
    assert run(spark, tmp_path) == ["a", "b"]


def test_only_touched_buckets_are_read(spark, tmp_path):
    land(spark, f"{tmp_path}/landing", [f"c{i}" for i in range(40)])
    run(spark, tmp_path)
    known = refresh._stored(spark, f"{tmp_path}/table", spark.createDataFrame([], OBSERVATIONS).schema.add("obs_hash", "string"))
    plan = known.filter(F.col("batch") < 3).filter(F.col("company_bucket").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "company_bucket" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_numbers_are_exact_or_refused(spark):
    values = ["1", "0.12345678", "0.1234567891", "1e21", "1E3", "-2.50", "12345678901234567890.12345678", "123456789012345678901", "1.5e-7", "1.5e-8", "NaN", "", "0x1", "1.", "100000000e-16", "0.1000000000000"]
    rows = [f'{{"end":"2030-03-31","val":"{v}","accn":"0000000001-30-000001","form":"10-Q","filed":"2030-04-30"}}' for v in values]
    df = spark.createDataFrame([(f'{{"cik":"1","facts":{{"t":{{"c":{{"units":{{"USD":[{",".join(rows)}]}}}}}}}}}}',)], "json string")
    got = {r.printed: (r.value, r.malformed, r.refused) for r in filings.flatten_companyfacts(filings.parse_snapshots(df, filings.COMPANYFACTS)).collect()}
    exact = {"1": "1", "0.12345678": "0.12345678", "1E3": "1000", "-2.50": "-2.5", "12345678901234567890.12345678": "12345678901234567890.12345678", "1.5e-7": "0.00000015", "1.": "1", "0.1000000000000": "0.1"}
    assert {k: v[0] for k, v in got.items() if v[0] is not None} == {k: Decimal(v) for k, v in exact.items()}
    assert {k for k, v in got.items() if v[2]} == {"0.1234567891", "1e21", "123456789012345678901", "1.5e-8", "100000000e-16"}
    assert {k for k, v in got.items() if v[1]} == {"NaN", "", "0x1"}


def test_runs_are_merged_and_replays_change_nothing(spark, tmp_path):
    """Twenty batches with three runs to a level; then the last batch is replayed."""
    log, keys = f"{tmp_path}/log", ["k"]
    best = {}

    def step(number):
        rows = [(f"k{(number * 7 + i) % 11}", (number * 13 + i * 5) % 97, number) for i in range(4)]
        for k, ts, n in rows:
            best[k] = max(best.get(k, (-1, -1)), (ts, n))
        spark.createDataFrame(rows, "k string, ts int, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/landing")

    def run():
        stream = spark.readStream.schema("k string, ts int, n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/landing")
        refresh.current_view_updates(stream, keys, ["ts", "n"], log, f"{tmp_path}/ckpt", fan=3).awaitTermination()
        return {r.k: (r.ts, r.n) for r in refresh.read_current_view(spark, log, keys, ["ts", "n"]).collect()}

    for number in range(20):
        step(number)
    assert run() == best
    assert [refresh._level(r) for r in refresh._runs(spark, log, None)] == [2, 2, 0, 0]  # 20 is 2 * 9 + 2
    folders = [p.name for p in (tmp_path / "log").glob("run-*")]
    assert len(folders) <= 10
    # As after a failure between the last batch and its commit.
    for p in (tmp_path / "ckpt" / "commits").glob("*19*"):
        p.unlink()
    (tmp_path / "ckpt" / "commits" / ".19.crc").unlink(missing_ok=True)
    assert run() == best and len(refresh._runs(spark, log, None)) == 4
    step(20)
    assert run() == best and [refresh._level(r) for r in refresh._runs(spark, log, None)] == [2, 2, 1]
