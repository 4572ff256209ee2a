"""The four stages over all companies: ingest, quality, analyze, forecast.

Each stage reads what the one before wrote and records a fingerprint of its inputs per company. A stage refuses to run
on outputs that no longer match their own inputs or the frameworks (StageStale); running the earlier stage again with
`only_stale` recomputes just the companies concerned. Finding that out takes one pass over the stored rows.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, checks, extract, lineage, registry, summary
from ..session import stage as stage_rows
from ..sources.sinks import with_bucket
from ..sources.specs import Framework
from . import forecast
from .views import StageNotRun


class StageStale(RuntimeError):
    """A stage's stored output was made from other inputs or frameworks than there are now."""


def framework_hash(frameworks: dict[str, Framework]) -> str:
    """Changes whenever any spec of any framework does."""
    return hashlib.sha256(json.dumps({n: asdict(f) for n, f in sorted(frameworks.items())}, sort_keys=True, default=list).encode()).hexdigest()


@dataclass
class Workspace:
    """Stage outputs under one folder, partitioned by company bucket."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out = with_bucket(df).hint("rebalance", "company_bucket") if "company_id" in df.columns else df
        writer = out.write.mode("overwrite")
        (writer.partitionBy("company_bucket") if "company_id" in df.columns else writer).parquet(self.path(name))
        return self.read(name)

    def replace(self, df: DataFrame, name: str, companies: DataFrame) -> DataFrame:
        """Writes the rows of some companies in place of those they had; only the buckets these fall into are rewritten."""
        old, buckets = self.spark.read.parquet(self.path(name)), with_bucket(companies).select("company_bucket").distinct()
        kept = old.join(companies, "company_id", "left_anti").join(F.broadcast(buckets), "company_bucket", "left_semi")  # at most BUCKETS rows
        whole = stage_rows(kept.unionByName(with_bucket(df).select(*old.columns)), "replaced")
        whole.hint("rebalance", "company_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("company_bucket").parquet(self.path(name))
        # A bucket that is left without rows is not in the rewritten ones and has to go.
        emptied = buckets.join(whole.select("company_bucket").distinct(), "company_bucket", "left_anti").collect()
        for b in emptied:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/company_bucket={b.company_bucket}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return self.read(name)

    def read(self, name: str, stage: str | None = None) -> DataFrame:
        location = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        if not location.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(location):
            raise StageNotRun(f"{name} is missing: run `{stage or name}` first")
        return self.spark.read.parquet(self.path(name)).drop("company_bucket")


def _record(ws: Workspace, stage: str, inputs: DataFrame, frameworks: dict[str, Framework]) -> None:
    marks = registry.fingerprint(inputs, ["company_id"]).withColumn("stage", F.lit(stage)).withColumn("framework_hash", F.lit(framework_hash(frameworks)))
    ws.write(marks, f"manifest_{stage}")


def stale_companies(ws: Workspace, stage: str, inputs: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    """(company_id, why) for companies whose stage output no longer matches its inputs or the frameworks."""
    manifest = ws.read(f"manifest_{stage}", stage)
    changed = registry.stale(manifest, registry.fingerprint(inputs, ["company_id"]), ["company_id"])
    reworked = manifest.filter(F.col("framework_hash") != framework_hash(frameworks)).select("company_id", F.lit("framework_changed").alias("why"))
    return changed.unionByName(reworked).dropDuplicates(["company_id"])


def require_current(ws: Workspace, stage: str, inputs: DataFrame, frameworks: dict[str, Framework]) -> None:
    """Raises StageStale, naming a company and why, unless the stage's output stands for these inputs and frameworks."""
    first = stale_companies(ws, stage, inputs, frameworks).orderBy("company_id").first()
    if first:
        raise StageStale(f"{stage} has to run again: {first.why} for {first.company_id}")


def _part(ws: Workspace, stage: str, inputs: DataFrame, frameworks: dict[str, Framework], only_stale: bool):
    """How a stage reads and writes: all companies, or those whose output is stale."""
    if not only_stale:
        return (lambda df: df), ws.write
    companies = stage_rows(stale_companies(ws, stage, inputs, frameworks).select("company_id"), "stale")
    return (lambda df: df.join(companies, "company_id", "left_semi")), (lambda df, name: ws.replace(df, name, companies))


def ingest(ws: Workspace, observations: DataFrame, entities: DataFrame, frameworks: dict[str, Framework], extra_facts: DataFrame | None = None) -> DataFrame:
    """Observations to facts (all versions) with the extraction report; `extra_facts` are verified document figures."""
    ws.write(entities, "entities")
    # Written once: the compacted rows feed the disclosures and the report of what was left out.
    mapped = stage_rows(extract.map_observations(observations, entities, frameworks), "mapped")
    disclosed = ws.write(extract.disclosures(mapped), "disclosures")
    facts = extract.to_facts(disclosed)
    facts = ws.write(facts if extra_facts is None else facts.unionByName(extra_facts), "facts")
    ws.write(extract.skip_counts(mapped, disclosed), "skipped")
    ws.write(extract.coverage(disclosed), "concepts")
    _record(ws, "ingest", facts, frameworks)
    return facts


def quality(ws: Workspace, frameworks: dict[str, Framework], historical_years: int = 10, only_stale: bool = False) -> checks.Quality:
    facts = ws.read("facts", "ingest")
    require_current(ws, "ingest", facts, frameworks)
    some, write = _part(ws, "quality", facts, frameworks, only_stale)
    mine, disclosed, entities = some(facts), some(ws.read("disclosures", "ingest")), some(ws.read("entities", "ingest"))
    found = checks.extraction_issues(extract.restatements(disclosed), extract.concept_switches(some(ws.read("concepts", "ingest"))), extract.currency_mismatches(mine, entities))
    run = checks.run_quality(mine, frameworks, historical_years=historical_years, extraction=found)
    for name, df in (("current", run.current), ("derived", run.derived), ("issues", run.issues), ("checks", checks.check_rollup(run.outcomes)), ("coverage", run.coverage), ("derivations", run.derivations)):
        write(df, name)
    _record(ws, "quality", facts, frameworks)
    return run


def analyze(ws: Workspace, frameworks: dict[str, Framework], only_stale: bool = False) -> DataFrame:
    facts = ws.read("current", "quality").unionByName(ws.read("derived", "quality"))
    require_current(ws, "quality", ws.read("facts", "ingest"), frameworks)
    some, write = _part(ws, "analyze", facts, frameworks, only_stale)
    events = write(analytics.run_analytics(some(facts), some(ws.read("issues", "quality")), frameworks), "analytic_events")
    values = write(analytics.analytic_values(some(events)), "analytics")
    write(analytics.not_computed(some(events)), "not_computed")
    write(summary.series_summary(some(values), frameworks), "summaries")
    _record(ws, "analyze", facts, frameworks)
    return values


def project(ws: Workspace, frameworks: dict[str, Framework], *, analyst: DataFrame | None = None, scenarios: DataFrame | None = None, years: int = 5) -> forecast.Forecast:
    facts = ws.read("current", "quality").unionByName(ws.read("derived", "quality"))
    values = ws.read("analytics", "analyze")
    require_current(ws, "quality", ws.read("facts", "ingest"), frameworks)
    require_current(ws, "analyze", facts, frameworks)
    run = forecast.run_forecast(facts, frameworks, rates=lineage.facts_under(values), analyst=analyst, scenarios=scenarios, years=years)
    events = ws.write(run.events, "forecast_events")
    ws.write(events.filter("reason IS NULL").drop("reason"), "forecast")
    ws.write(run.assumptions, "assumptions")
    ws.write(run.unseeded, "unseeded")
    _record(ws, "forecast", facts, frameworks)
    return run
