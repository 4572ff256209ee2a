import pytest

from tallyframe import schemas
from tallyframe.plans import forecast, projection


def assumptions(spark, rows):
    names = [c.split(" ")[0] for c in schemas.ASSUMPTIONS.split(", ")]
    full = [tuple({"company_id": "co", "unit": "ratio", "source_fact_ids": [], "rationale": "x"}.get(n) if n not in r else r[n] for n in names) for r in rows]
    return spark.createDataFrame(full, schemas.ASSUMPTIONS)


def values(run, scenario="base"):
    return {(r.metric_id, r.fiscal_year): round(r.value, 4) for r in run.values.filter(f"scenario = '{scenario}'").collect()}


HISTORY = [("revenue", f"FY{y}", v) for y, v in ((2021, 1000), (2022, 1100), (2023, 1200), (2024, 1300), (2025, 1400))]


def test_growth_seed_window(make_facts, generic):
    facts = make_facts([("revenue", f"FY{2020 + i}", v) for i, v in enumerate((100, 200, 220, 242, 266.2))])
    seed = forecast.seed_candidates(forecast.annual_points(facts)).filter("space = 'growth'").first()
    assert round(seed.value, 6) == 0.1 and len(seed.source_fact_ids) == 4 and seed.observations == 3
    assert seed.description == "Median year-on-year growth of revenue over FY2022-FY2024 (3 observations)"


def test_level_seed_is_anchored_at_the_base_year(make_facts, banks):
    rows = [("cet1_ratio", f"FY{y}", v, {"unit": "pure", "currency": None}) for y, v in ((2022, 0.02), (2023, 0.03), (2024, 0.04))]
    seeds = forecast.seed_candidates(forecast.annual_points(make_facts(rows, framework="banks")))
    assert seeds.filter("space = 'level'").first().value == 0.03
    stale = make_facts(rows + [("deposits", "FY2030", 1)], framework="banks")
    assert forecast.seed_candidates(forecast.annual_points(stale)).filter("space = 'level' AND name = 'cet1_ratio'").first().value is None


def test_base_case(make_facts, generic):
    got = values(forecast.run_forecast(make_facts(HISTORY), generic, years=2, only=("revenue",)))
    assert got[("revenue", 2026)] == round(1400 * (1 + 1 / 12), 4)
    assert got[("revenue", 2025)] == 1400


@pytest.mark.parametrize("rows,expected", [
    ([("growth.revenue", 0.2, "management_guidance")], 1680), ([("growth.revenue", 0.2, "management_guidance"), ("growth.revenue", 0.05, "analyst_assumption")], 1470),
])
def test_ladder(spark, make_facts, generic, rows, expected):
    authored = assumptions(spark, [{"key": k, "value": v, "type": t} for k, v, t in rows])
    assert values(forecast.run_forecast(make_facts(HISTORY), generic, analyst=authored, years=1, only=("revenue",)))[("revenue", 2026)] == expected


def test_scenarios_and_pinned_years(spark, make_facts, generic):
    authored = assumptions(spark, [{"key": "growth.revenue", "value": 0.2, "type": "scenario", "scenario": "bull"}, {"key": "growth.revenue", "value": -0.1, "type": "scenario", "scenario": "bear"},
                                   {"key": "growth.revenue", "value": 0.5, "type": "analyst_assumption", "period": "FY2027"}])
    names = spark.createDataFrame([("co", "bull"), ("co", "bear")], "company_id string, scenario string")
    run = forecast.run_forecast(make_facts(HISTORY), generic, analyst=authored, scenarios=names, years=2, only=("revenue",))
    assert values(run, "bull")[("revenue", 2026)] == 1680 and values(run, "bear")[("revenue", 2026)] == 1260
    assert values(run)[("revenue", 2027)] == round(1400 * (1 + 1 / 12) * 1.5, 4)


def test_unset_assumption_refuses_downstream(spark, make_facts, generic):
    authored = assumptions(spark, [{"key": "growth.revenue", "value": None, "type": "analyst_assumption"}])
    facts = make_facts(HISTORY + [("cost_of_revenue", f"FY{y}", 10) for y in range(2021, 2026)])
    run = forecast.run_forecast(facts, generic, analyst=authored, years=2, only=("gross_profit",))
    refused = {(r.metric_id, r.reason): r.n for r in run.not_projected.collect()}
    assert refused == {("revenue", "assumption_unset:growth.revenue"): 1, ("revenue", "prior_year_not_projected:revenue"): 1, ("gross_profit", "input_not_projected:revenue"): 2}


def test_refuses_to_grow_a_loss(make_facts, generic):
    run = forecast.run_forecast(make_facts([("operating_cash_flow", "FY2024", 5), ("operating_cash_flow", "FY2025", -5)]), generic, years=1, only=("operating_cash_flow",))
    assert [r.reason for r in run.not_projected.collect()] == ["growth_base_not_positive:operating_cash_flow"]


def test_fallback_marks_everything_built_on_it(make_facts, banks):
    rows = [(m, f"FY{y}", v) for y in range(2021, 2026) for m, v in (("net_interest_income", 100 + y), ("noninterest_income", 50 + y), ("noninterest_expense", 20))]
    facts = make_facts(rows, framework="banks")
    run = forecast.run_forecast(facts, banks, years=1, only=("revenue", "noninterest_expense"))
    marks = {r.metric_id: r.fallback_for for r in run.values.filter("fiscal_year = 2026").collect()}
    assert marks == {"net_interest_income": ["net_interest_income"], "revenue": ["net_interest_income"], "noninterest_income": [], "noninterest_expense": []}


def test_plan_demotes_the_margin_and_orders_layers(frameworks):
    plan = projection.build_plan(frameworks["banks"])
    assert list(plan.demoted) == ["net_interest_margin"] and plan.rules["net_interest_margin"].method == "level"
    placed = {m: i for i, layer in enumerate(plan.layers) for m in layer}
    assert all(placed[d] < placed[m] for m, r in plan.rules.items() for d in r.inputs)
    fallen = projection.build_plan(frameworks["banks"], frozenset({"net_interest_income_engine"}))
    assert fallen.fallbacks == ["net_interest_income"] and not fallen.demoted
    odd = projection.build_plan(frameworks["generic"], extra_targets=("nothing",))
    assert odd.unknown_targets == ("nothing",)
