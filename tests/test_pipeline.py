import pytest
from helpers import SF
from pyspark.sql import functions as F

from tallyframe.plans import pipeline, views
from tallyframe.sources import tables


def test_four_stages(spark, generic, tmp_path):
    ws = pipeline.Workspace(spark, str(tmp_path / "ws"))
    with pytest.raises(views.StageNotRun):
        pipeline.analyze(ws, generic)
    entities = tables.entities(spark, SF)
    seen = tables.observations(spark, SF, ["revenue", "cost_of_revenue", "operating_income", "pre_tax_income", "income_tax_expense"])
    facts = pipeline.ingest(ws, seen, entities, generic)
    run = pipeline.quality(ws, generic)
    values = pipeline.analyze(ws, generic)
    plan = pipeline.project(ws, generic, years=2)
    companies = entities.count()
    assert facts.select("company_id").distinct().count() == companies and values.select("company_id").distinct().count() == companies
    assert ws.read("checks").filter("check_id = 'missing_years'").count() == companies
    projected = ws.read("forecast").filter("method <> 'actual' AND metric_id = 'revenue'")
    assert projected.count() == companies * 2 and plan.plans[0].demoted == {}
    assert run.issues.filter("check_id = 'concept_switch'").count() > 0
    assert pipeline.stale_companies(ws, "quality", facts, generic).count() == 0
    first = facts.agg(F.min("company_id")).first()[0]
    moved = facts.withColumn("value", F.when(F.col("company_id") == first, F.col("value") + 1).otherwise(F.col("value")))
    assert [(r.company_id, r.why) for r in pipeline.stale_companies(ws, "quality", moved, generic).collect()] == [(first, "changed")]


def test_stale_stages_are_refused_and_only_stale_companies_redone(spark, generic, frameworks, tmp_path):
    ws = pipeline.Workspace(spark, str(tmp_path / "ws"))
    entities = tables.entities(spark, SF)
    seen = tables.observations(spark, SF, ["revenue", "cost_of_revenue"])
    pipeline.ingest(ws, seen, entities, generic)
    pipeline.quality(ws, generic)
    before = pipeline.analyze(ws, generic).cache()
    before.count()
    first = seen.agg(F.min("company_id")).first()[0]
    doubled = seen.withColumn("value", F.when(F.col("company_id") == first, (F.col("value") * 2).cast("decimal(28,8)")).otherwise(F.col("value")))
    pipeline.ingest(ws, doubled, entities, generic)
    with pytest.raises(pipeline.StageStale, match=f"quality has to run again: changed for {first}"):
        pipeline.analyze(ws, generic)
    pipeline.quality(ws, generic, only_stale=True)
    with pytest.raises(pipeline.StageStale, match="analyze"):
        pipeline.project(ws, generic)
    pipeline.analyze(ws, generic, only_stale=True)
    part = {name: sorted(map(str, ws.read(name).collect())) for name in ("current", "issues", "coverage", "analytics", "summaries")}
    pipeline.quality(ws, generic)
    pipeline.analyze(ws, generic)
    assert part == {name: sorted(map(str, ws.read(name).collect())) for name in part}
    with pytest.raises(pipeline.StageStale, match="framework_changed"):
        pipeline.quality(ws, {"generic": frameworks["industrials"]})


def test_stage_tables_are_released(spark):
    from pathlib import Path

    from tallyframe.session import release, shared_folder, stage

    kept = stage(spark.range(5), "kept-for-now")
    path = next(Path(shared_folder(spark)).glob("kept-for-now-*"))
    assert kept.count() == 5 and path.exists()
    assert release(spark) >= 1 and not path.exists() and release(spark) == 0
