import pytest

from tallyframe.operators import documents

PERIOD = "<xbrli:period><xbrli:startDate>2031-01-01</xbrli:startDate><xbrli:endDate>2031-12-31</xbrli:endDate></xbrli:period>"
INSTANT = "<xbrli:period><xbrli:instant>2031-12-31</xbrli:instant></xbrli:period>"
UNITS = "<xbrli:unit id='money'><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id='rate'><xbrli:measure>xbrli:pure</xbrli:measure></xbrli:unit>"
SEGMENT = "<xbrli:segment><xbrldi:explicitMember dimension='us-gaap:RiskWeightedAssetsCalculationMethodologyAxis'>z:{}</xbrldi:explicitMember></xbrli:segment>"
HEAD = (
    f'<xbrli:context id="year">{PERIOD}</xbrli:context><xbrli:context id="one">{SEGMENT.format("BaselStandardizedMember")}{INSTANT}</xbrli:context>'
    f'<xbrli:context id="two">{SEGMENT.format("BaselAdvancedMember")}{INSTANT}</xbrli:context>{UNITS}<ix:nonNumeric name="dei:EntityCentralIndexKey" contextRef="year">9001</ix:nonNumeric>'
)
TAGS = """<ix:nonFraction name='us-gaap:NetIncomeLoss' contextRef='year' unitRef='money' scale='3'>6,250</ix:nonFraction>
<ix:nonFraction contextRef="one" unitRef="rate" scale="-2" name="z:CommonEquityTierOneCapitalRatio">11.25</ix:nonFraction>
<ix:nonFraction contextRef="two" unitRef="rate" scale="-2" name="z:CommonEquityTierOneCapitalRatio">10.75</ix:nonFraction>
<ix:nonFraction contextRef="absent" unitRef="money" name="us-gaap:Deposits">5</ix:nonFraction>"""
TABLE = """<p>Capital measures</p><p>(in thousands)</p><table class="a>b"><thead><tr><th rowspan=2></th><th colspan='2'>At December 31,</th><th colspan='2'>Average for the year</th></tr>
<tr><th>2031</th><th>2030</th><th>2031</th><th>2030</th></tr></thead><tr><td>Tangible common equity</td><td>71,500</td><td>69,125</td><td>70,250</td><td>68,000</td></tr></table>"""
LAYOUT = "<table><tr><td>Only words here</td></tr></table><table><tr><td>Left</td><td>Right</td></tr><tr><td>More</td><td>words</td></tr></table><table></table><table><tr></tr></table>"


def page(*parts):
    return f"<html><body>{HEAD}{''.join(parts)}</body></html>"


@pytest.fixture(scope="module")
def entity(spark):
    return spark.createDataFrame([("co", "banks", 12, "end_year", "USD")], "company_id string, framework string, fye_month int, convention string, reporting_currency string")


def corpus(spark, *html):
    return spark.createDataFrame([(i, "co", h, "0000009001") for i, h in enumerate(html, 1)], "doc_id long, company_id string, html string, expected_cik string")


def cells(spark, *html):
    rows = documents.table_cells(corpus(spark, *html)).orderBy("doc_id", "table_no", "row_no", "cell_no").collect()
    return [(r.table_no, r.row_key, float(r.value), r.heading, r.year) for r in rows]


def test_tags_in_either_quotes_and_identity(spark):
    df = corpus(spark, page(TAGS))
    tags = {(r.concept, tuple(m.member for m in r.dimensions)): r for r in documents.inline_tags(df).collect()}
    assert float(tags["us-gaap:NetIncomeLoss", ()].value) == 6_250_000 and str(tags["us-gaap:NetIncomeLoss", ()].period_start) == "2031-01-01"
    assert float(tags["z:CommonEquityTierOneCapitalRatio", ("BaselAdvancedMember",)].value) == 0.1075 and tags["us-gaap:Deposits", ()].skipped
    assert documents.identities(df).first().identity == "match"


def test_tags_inside_tags(spark):
    inner = '<ix:nonFraction name="a:Inner" contextRef="year" unitRef="money">45</ix:nonFraction>'
    deep = f'<ix:nonFraction name="a:Outer" contextRef="year" unitRef="money">1<b>,2</b>{inner}</ix:nonFraction>'
    nil = '<ix:nonFraction name="a:Nil" contextRef="year" xsi:nil="true"/>'
    around = f'<ix:nonFraction name="a:Third" contextRef="year" unitRef="money">9{deep}</ix:nonFraction>'
    got = {r.concept: r.value for r in documents.inline_tags(corpus(spark, page(nil, deep.replace("a:", "b:"), around))).collect()}
    assert {k: int(v) for k, v in got.items()} == {"b:Inner": 45, "b:Outer": 1245, "a:Inner": 45, "a:Outer": 1245, "a:Third": 91245}


def test_the_last_definition_of_an_id_counts(spark):
    again = f'<xbrli:context id="year">{INSTANT}</xbrli:context>'
    row = documents.inline_tags(corpus(spark, page(again, TAGS))).filter("concept = 'us-gaap:NetIncomeLoss'").first()
    assert row.period_start is None and str(row.period_end) == "2031-12-31"


def test_many_tags_and_contexts(spark):
    """Thousands of both in one filing are met by id, not one against all."""
    n = 3000
    many = "".join(f"<xbrli:context id='k{i}'>{PERIOD.replace('2031', str(1900 + i % 100))}</xbrli:context>" for i in range(n))
    tags = "".join(f"<ix:nonFraction name='a:T' contextRef='k{i}' unitRef='money'>{i}</ix:nonFraction>" for i in range(n))
    got = documents.inline_tags(corpus(spark, page(many, tags))).collect()
    assert sorted(int(r.value) for r in got) == list(range(n)) and all(r.period_end.year == 1900 + int(r.value) % 100 for r in got)


def test_spanned_headings(spark):
    got = cells(spark, page(TABLE))
    assert [(v, y) for _, _, v, _, y in got] == [(71500, 2031), (69125, 2030), (70250, 2031), (68000, 2030)]
    assert got[0][3] == "At December 31, 2031" and got[2][3] == "Average for the year 2031"
    assert float(documents.table_cells(corpus(spark, page(TABLE))).first().scale) == 1000


def test_layout_tables_are_passed_over(spark):
    assert cells(spark, page(LAYOUT), LAYOUT, "", "<table", "</table>", "<table><tr><td>1</td></tr>") == []
    assert [c[0] for c in cells(spark, page(LAYOUT, TABLE))] == [5] * 4
    assert documents.table_cells(spark.createDataFrame([(1, None)], "doc_id long, html string")).collect() == []


def test_tables_inside_tables(spark):
    nested = f"<table><tr><td>Outer</td><td>2031</td></tr><tr><td>Loans</td><td>17</td></tr><tr><td>{TABLE}</td><td>18</td></tr><tr><td>Deposits</td><td>19</td></tr></table>"
    got = [(n, k, v) for n, k, v, _, _ in cells(spark, page(nested))]
    assert got == [(1, "loans", 17), (1, "capital measures(in thousands)", 18), (1, "deposits", 19)] + [(2, "tangible common equity", v) for v in (71500, 69125, 70250, 68000)]


def test_wide_spans_and_open_rows(spark):
    wide = "<table><tr><td colspan=100000 rowspan=3>Title</td><td>x<tr><td>2031<tr><td>2030</table>"
    assert cells(spark, wide) == []
    left_open = "<table><tr><td>Year<td colspan=250>2031<td>2030<tr><td>Cash<td colspan=250>5<td>6"
    assert [(k, v, y) for _, k, v, _, y in cells(spark, left_open)] == [("cash", 5, 2031), ("cash", 6, 2030)]


def test_ordinary_pages_have_no_figures(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("page_id as doc_id", "html")
    assert documents.table_cells(pages).count() == 0 and documents.inline_tags(pages).count() == 0


def test_study_prefers_tags_and_drops_average_columns(spark, entity, banks):
    found = {(r.metric_id, r.fiscal_year): (float(r.value), r.method) for r in documents.study(corpus(spark, page(TAGS, LAYOUT, TABLE)), entity, banks).collect()}
    assert found == {("net_income", 2031): (6_250_000, "xbrl"), ("cet1_ratio", 2031): (0.1125, "xbrl"), ("tangible_common_equity", 2031): (71_500_000, "html_table"), ("tangible_common_equity", 2030): (69_125_000, "html_table")}


def test_later_table_that_disagrees_removes_the_figure(spark, entity, banks):
    other = TABLE.replace("71,500", "72,400")
    found = {(r.metric_id, r.fiscal_year) for r in documents.study(corpus(spark, page(TABLE, other)), entity, banks).collect()}
    assert found == {("tangible_common_equity", 2030)}
    assert documents.study(corpus(spark, page(TABLE.replace("(in thousands)", ""))), entity, banks).count() == 0


def test_verdicts_and_gap_fill(spark, entity, banks, make_facts):
    known = make_facts([("net_income", "FY2031", 6_250_000)], framework="banks")
    foreign = page(TAGS.replace("6,250", "4,000"), TABLE).replace(">9001<", ">17<")
    df = corpus(spark, page(TAGS, TABLE), foreign, page(TABLE).replace(">9001<", ">none<"), "<html><body>empty</body></html>")
    found = documents.study(df, entity, banks)
    judged = documents.verdicts(documents.identities(df), found, documents.compare(found, known))
    assert {r.doc_id: r.status for r in judged.collect()} == {1: "verified", 2: "rejected", 3: "unverified", 4: "unverified"}
    docs = df.selectExpr("doc_id", "cast(null as string) accession", "cast(null as date) filed", "cast(null as timestamp) added_at")
    made = documents.filled_facts(documents.gap_fill(found, judged, known, docs), entity, known)
    got = {(r.metric_id, r.fiscal_year): (float(r.value), str(r.period_end), r.unit) for r in made.collect()}
    assert got == {("cet1_ratio", 2031): (0.1125, "2031-12-31", "pure"), ("tangible_common_equity", 2031): (71_500_000, "2031-12-31", "USD"), ("tangible_common_equity", 2030): (69_125_000, "2030-12-31", "USD")}
