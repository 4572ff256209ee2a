import itertools
import random

from pyspark.sql import functions as F

from tallyframe.operators import constraints, entities, lineage, ordered, registry
from tallyframe.sources import specs


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, k, i, {}) for i, k in nodes], "node_id string, kind string, label string, attributes map<string,string>")
    return n, spark.createDataFrame(edges, "child string, parent string")


NODES = [("src", "source"), ("doc", "document"), ("f1", "fact"), ("f2", "fact"), ("asm", "assumption"), ("v", "model_output"), ("lost", "document"), ("f3", "fact"), ("w", "model_output")]
EDGES = [("doc", "src"), ("f1", "doc"), ("f2", "f1"), ("v", "f1"), ("v", "f2"), ("v", "asm"), ("f3", "lost"), ("w", "f3"), ("w", "f1")]


def test_walks(spark):
    nodes, edges = graph(spark, NODES, EDGES)
    start = spark.createDataFrame([("v",)], "origin string")
    assert {(r.node, r.depth) for r in lineage.ancestors(start, edges).collect()} == {("f1", 1), ("f2", 1), ("asm", 1), ("doc", 2), ("src", 3)}
    assert {r.node_id for r in lineage.broken_nodes(nodes, edges).collect()} == {"lost", "f3", "w"}
    assert [r.url for r in lineage.source_urls(start, nodes, edges).collect()] == ["src"]
    assert {tuple(r.path) for r in lineage.root_paths(start, edges).collect()} == {("v", "f1", "doc", "src"), ("v", "f2", "f1", "doc", "src"), ("v", "asm")}
    assert lineage.cyclic_nodes(edges).count() == 0
    looped = edges.union(spark.createDataFrame([("src", "w")], "child string, parent string"))
    assert {r.node_id for r in lineage.cyclic_nodes(looped).collect()} == {"doc", "f1", "f2", "v", "w", "src"}
    assert lineage.ancestors(start, looped).count() == 9 - 1  # a cycle ends by itself
    whole = lineage.trace(start, nodes, edges)
    assert {r.node for r in whole.filter("is_root").collect()} == {"asm", "src"} and whole.count() == 5
    cut = lineage.trace_page(whole, 2).collect()
    assert len(cut) == 2 and all(r.truncated for r in cut)


def test_previous_row_and_running_sum_match_a_plain_order(spark):
    random.seed(5)
    rows = [("hot" if random.random() < 0.5 else f"k{random.randint(0, 3)}", i, random.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v string").repartition(7)
    found = ordered.with_running_sum(ordered.with_previous(df, ["k"], ["i"], F.floor(F.col("i") / 37), "v"), ["k"], ["i"], F.floor(F.col("i") / 37), F.lit(1), "n").collect()
    got = {(r.k, r.i): (r.previous, r.n) for r in found}
    want = {}
    for key, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        before = None
        for n, (_, i, v) in enumerate(group, 1):
            want[(key, i)] = (before, n)
            before = v
    assert got == want


def test_versions_flip_flop(spark):
    df = spark.createDataFrame([("u", i, h) for i, h in enumerate("AABBA")], "source string, at int, hash string")
    found = registry.source_versions(df, ["source"], ["at"], F.floor(F.col("at") / 2))
    chain = registry.with_document_ids(found, F.lit("co"), F.lit("annual_report"), F.col("source")).orderBy("version").collect()
    assert [(r.version, r.hash, r.is_current) for r in chain] == [(1, "A", False), (2, "B", False), (3, "A", True)]
    assert len({r.document_id for r in chain}) == 3


def test_status_audit(spark):
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate(("registered", "retrieved", "extracted", "parsed"))], "document_id string, at int, status string")
    assert [(r.before, r.after) for r in registry.forbidden_transitions(df, F.lit(0), ["at"]).collect()] == [("retrieved", "extracted")]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("c"), F.col("id").alias("v"))
    a, b = registry.fingerprint(df, ["c"]), registry.fingerprint(df.orderBy(F.desc("v")).repartition(5), ["c"])
    assert registry.stale(a, b, ["c"]).count() == 0
    changed = registry.fingerprint(df.withColumn("v", F.when(F.col("v") == 7, -1).otherwise(F.col("v"))), ["c"])
    assert [(r.c, r.why) for r in registry.stale(a, changed, ["c"]).collect()] == [(1, "changed")]


def test_config_violations(spark):
    config = spark.createDataFrame([("a", "0000000001", "AAA", 12), ("b", None, "BBB", 9)], "company_id string, cik string, ticker string, fye_month int")
    url = "https://data.sec.gov/api/xbrl/companyfacts/CIK000000000{}.json"
    sources = spark.createDataFrame([("a", "structured_filings", url.format(2), None), ("a", "annual_reports", "https://x.com/r.htm", None), ("a", "annual_reports", "https://x.com/r.htm", None),
                                     ("b", "investor_relations", "https://ir.x.com", None), ("b", "annual_reports", url.format(3), None)], "company_id string, kind string, url string, path string")
    profiles = spark.createDataFrame([("a", "0000000001", ["AAA"], 6)], "company_id string, cik string, tickers array<string>, fye_month int")
    rules = {(r.company_id, r.rule) for r in entities.config_violations(config, sources, profiles).collect()}
    assert rules == {("a", "cik_mismatch"), ("a", "source_listed_twice"), ("b", "structured_source_misplaced"), ("a", "fiscal_year_end_differs")}


def test_specs_are_sound_and_overlay_agrees(spark, frameworks):
    assert specs.spec_violations(spark, frameworks).count() == 0
    raw = {f.name: f for f in map(specs.from_mapping, specs.specdata.SHIPPED)}
    rows = [(c, d, m) for c in raw if c != "generic" for d, f in ((0, "generic"), (1, c)) for m in raw[f].metrics]
    gone = [(c, 1, m) for c in raw if c != "generic" for m in raw[c].removed.get("metrics", ())]
    items = spark.createDataFrame(rows, "group_id string, depth int, item_id string")
    removals = spark.createDataFrame(gone, "group_id string, depth int, item_id string")
    got = {(r.group_id, r.item_id) for r in specs.overlay(items, removals).collect()}
    assert got == {(n, m) for n, f in frameworks.items() if n != "generic" for m in f.metrics}
    assert specs.overlay_violations(items, removals).count() == 0
    assert [r.method for r in specs.valuation_methods(spark, {"banks": frameworks["banks"]}, ("relative",)).filter("excluded_reason IS NULL").collect()] == ["ptbv", "pb", "pe"]


def test_constraints(make_facts):
    facts = make_facts([("revenue", "FY2024", 1, {"unit": "EUR"}), ("revenue", "FY2023", 1, {"inputs": ["fact_1"]}), ("revenue", "FY2022", 1, {"accession": "x"})])
    assert {r.rule for r in constraints.fact_violations(facts).collect()} == {"unit_against_currency", "reported_with_inputs", "bad_accession"}
    assert constraints.duplicate_current(facts.unionByName(facts)).count() == 3


def test_index_search_by_distinct_names_gives_what_a_scan_gives(spark):
    """Companies of few names and many tickers: the index grows with the names, and answers are those of a scan."""
    names = ["Red ring", "RED RING", "small widget", "Widget red", None, "p2 holdings", "x"]
    rows = [(i, f"P{i}" if i % 11 else f"p{i}", names[i % 7]) for i in range(400)]
    index = spark.createDataFrame(rows, "position long, ticker string, name string")
    more = spark.createDataFrame([("RING", 399), ("P2", 398), ("P20", 3)], "ticker string, position long")
    asked = ["p2", "P20", "p", "ring", "RED", "d r", "e", "x", "widget", "Ring", " small  widget ", "p399", "zzz", "", "holdings", "p22"]
    grams = entities.gram_index(index)
    assert grams.count() == entities.gram_index(index.filter("position < 7")).count()
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    for aliases in (None, more):
        got = entities.search_index(queries, index, grams, aliases=aliases).collect()
        assert got and sorted(got) == sorted(entities.search(index, asked, aliases=aliases).collect())
