from tallyframe.operators import derive


def test_outcomes_without_ids_are_the_same(make_facts, generic):
    facts = make_facts([("revenue", "FY2030", 100), ("cost_of_revenue", "FY2030", 40), ("gross_profit", "FY2031", 5), ("revenue", "FY2031", 9), ("cost_of_revenue", "FY2031", 3), ("net_income_to_common", "FY2031", 1)])
    told = lambda traced: sorted((r.fiscal_year, r.metric_id, r.outcome) for r in derive.formula_events(facts, generic, traced).collect())
    assert told(False) and told(False) == told(True)
    assert derive.formula_events(facts, generic, False).columns[-3:] == ["metric_id", "outcome", "cell"]
