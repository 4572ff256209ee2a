"""Figures in filed HTML: inline tags, printed tables, and whether a document can be trusted.

A document is one row. Its markup is cut into tags, contexts and table cells with regular expressions and array
functions inside the row, so a corpus is read once and nothing is shuffled until findings are compared with facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, ids, text
from ..functions.arrays import named, once
from ..functions.numeric import clean_text, printed_number, tagged_number
from ..schemas import FACT_COLUMNS, MONEY
from ..sources.specs import Framework, Metric, metric_spec

# Agreement within half a percent (or the printed rounding); three shared figures, nine in ten agreeing.
AGREEMENT = 0.005
MIN_CHECKS = 3
MIN_AGREEMENT = 0.9
BARE_YEAR = r"^(?:19|20)\d{2}$"


def plain(markup: Column) -> Column:
    """Markup to text: tags dropped, the common entities decoded, blanks collapsed."""
    bare = F.regexp_replace(markup, r"<[^>]*>", "")
    for entity, char in (("&(?:nbsp|#160|#xA0);", " "), ("&(?:mdash|#8212);", "—"), ("&(?:ndash|#8211);", "–"), ("&(?:rsquo|#8217);", "’"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.regexp_replace(bare, entity, char)
    return clean_text(bare)


def _attr(attrs: Column, name: str) -> Column:
    """The value of an attribute in either kind of quotes, or bare; null where it is empty or absent."""
    own = rf"""(?i)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.nullif(F.concat(*[F.coalesce(F.regexp_extract(attrs, own, g), F.lit("")) for g in (1, 2, 3)]), F.lit(""))


def _local(name: Column) -> Column:
    return F.substring_index(name, ":", -1)


# ---- inline tags ------------------------------------------------------------------------------------------------

# The attributes of an opening tag: quoted values may hold any sign but the start of a tag, and a lone quote is a sign.
_ATTRS = r"""((?:[^>"'/]++|/(?!>)|"[^"<]*+"|'[^'<]*+'|["'])*+)"""
_CONTEXT = rf"(?s)<(?:\w+:)?context\b{_ATTRS}>(.*?)</(?:\w+:)?context>"
_UNIT = rf"(?s)<(?:\w+:)?unit\b{_ATTRS}>(.*?)</(?:\w+:)?unit>"
_MEMBER = r"""(?s)<(?:\w+:)?explicitMember\b[^>]*?\sdimension\s*=\s*["']([^"']*)["'][^>]*>\s*([^<\s]*)"""


def _innermost(name: str) -> str:
    """An element that holds no other of its kind: attributes and content."""
    return rf"(?i)<{name}\b{_ATTRS}>([^<]*+(?:<(?!/?{name}\b)[^<]*+)*+)</{name}\s*>"


def _elements(html: Column, name: str, content: str = "$2") -> Column:
    """All elements of a kind, nested ones too, as array<struct<a,b>> of attributes and content.

    As many passes as elements lie in each other, each over the document: a pass takes the innermost ones and leaves
    their content (or what `content` makes of it) in place for the ones around them.
    """
    closed = F.regexp_replace(html, rf"(?i)<{name}\b{_ATTRS}/>", "")
    marks = F.regexp_extract_all(closed, F.lit(rf"(?i)<(/?){name}\b"), F.lit(1))

    def nest(acc: Column, mark: Column) -> Column:
        now = F.when(mark == "/", F.greatest(acc["now"] - 1, F.lit(0))).otherwise(acc["now"] + 1)
        return named(now=now, most=F.greatest(acc["most"], now))

    depth = F.aggregate(marks, named(now=F.lit(0), most=F.lit(1)), nest, lambda acc: acc["most"])

    def peel(acc: Column, _: Column) -> Column:
        return named(left=F.regexp_replace(acc["left"], _innermost(name), content), found=F.concat(acc["found"], _pairs(acc["left"], _innermost(name))))

    start = named(left=closed, found=F.array().cast("array<struct<a:string,b:string>>"))
    return F.aggregate(F.sequence(F.lit(1), depth), start, peel, lambda acc: acc["found"])


def _pairs(source: Column, pattern: str) -> Column:
    """All matches of a two-group pattern as array<struct<a,b>>."""
    one = lambda g: F.regexp_extract_all(source, F.lit(pattern), F.lit(g))
    return F.zip_with(one(1), one(2), lambda a, b: named(a=a, b=b))


def inline_tags(documents: DataFrame) -> DataFrame:
    """documents (doc_id, html): one row per tag with value, unit, dates, dimensions; `skipped` marks unusable ones.

    Tags inside tags are tags of their own and part of the outer one's text. doc_id tells documents apart.
    """

    def day(body: Column, name: str) -> Column:
        return F.regexp_extract(body, rf"<(?:\w+:)?{name}>\s*(\d{{4}}-\d{{2}}-\d{{2}})", 1).try_cast("date")

    def context(p: Column) -> Column:
        instant = day(p["b"], "instant")
        members = F.transform(_pairs(p["b"], _MEMBER), lambda m: named(axis=_local(m["a"]), member=_local(m["b"])))
        return named(
            id=_attr(p["a"], "id"), start=F.when(instant.isNull(), day(p["b"], "startDate")),
            end=F.coalesce(day(p["b"], "endDate"), instant), dimensions=F.array_sort(members),
        )

    def unit(p: Column) -> Column:
        measures = F.transform(F.regexp_extract_all(p["b"], F.lit(r"<(?:\w+:)?measure>\s*([^<\s]+)"), F.lit(1)), lambda m: F.upper(_local(m)))
        first = F.try_element_at(measures, F.lit(1))
        ratio = p["b"].rlike(r"<(?:\w+:)?divide") & (F.size(measures) == 2)
        shown = F.when(ratio, F.concat(first, F.lit("/"), F.lower(F.try_element_at(measures, F.lit(2))))).when(first == "PURE", "pure").otherwise(first)
        return named(id=_attr(p["a"], "id"), unit=shown)

    def defined(pattern: str, read, name: str) -> DataFrame:
        """(doc_id, ref, value); the last definition of an id counts, as in a reader that overwrites."""
        all_ = documents.select("doc_id", F.posexplode(F.transform(_pairs(F.col("html"), pattern), read)).alias("at", "c"))
        return all_.filter("c.id IS NOT NULL").groupBy("doc_id", F.col("c.id").alias(f"{name}_ref")).agg(F.max_by("c", "at").alias(name))

    # Contexts and units meet their tags by id, so a filing with thousands of both costs no more than their number.
    a = F.col("t.a")
    kept = [c for c in documents.columns if c != "html"]
    parsed = documents.select(*kept, F.explode(_elements(F.col("html"), "ix:nonFraction")).alias("t"))
    refs = parsed.select("*", _attr(a, "contextRef").alias("ctx_ref"), _attr(a, "unitRef").alias("u_ref"))
    tags = refs.join(defined(_CONTEXT, context, "ctx"), ["doc_id", "ctx_ref"], "left").join(defined(_UNIT, unit, "u"), ["doc_id", "u_ref"], "left")
    value = tagged_number(plain(F.col("t.b")), _attr(a, "format"), _attr(a, "scale"), _attr(a, "sign"))
    return tags.filter(~F.coalesce(_attr(a, "xsi:nil") == "true", F.lit(False))).select(
        *[c for c in documents.columns if c != "html"], _attr(a, "name").alias("concept"), value.alias("value"), F.col("u.unit").alias("unit"),
        F.col("ctx.start").alias("period_start"), F.col("ctx.end").alias("period_end"), F.coalesce("ctx.dimensions", F.array().cast("array<struct<axis:string,member:string>>")).alias("dimensions"),
        (F.col("ctx.end").isNull() | value.isNull()).alias("skipped"),
    )


def identities(documents: DataFrame) -> DataFrame:
    """(doc_id, filer, form, identity): who filed the document by its own tags, against the expected company."""
    notes = F.transform(_elements(F.col("html"), "ix:nonNumeric"), lambda n: named(name=_attr(n["a"], "name"), text=plain(n["b"])))
    first = lambda name: F.get(F.transform(F.filter("notes", lambda n: n["name"] == f"dei:{name}"), lambda n: n["text"]), F.lit(0))
    read = documents.select("doc_id", "expected_cik", notes.alias("notes")).select("doc_id", "expected_cik", text.cik10(first("EntityCentralIndexKey")).alias("filer"), first("DocumentType").alias("form"))
    known = F.col("filer").isNotNull() & F.col("expected_cik").isNotNull()
    return read.select("doc_id", "filer", "form", F.when(known, F.when(F.col("filer") == F.col("expected_cik"), "match").otherwise("mismatch")).otherwise("not_stated").alias("identity"))


# ---- printed tables ---------------------------------------------------------------------------------------------

_CELLS = "array<struct<c0:bigint,c1:bigint,text:string>>"
_HELD = "array<struct<c0:bigint,c1:bigint,left:bigint>>"
# Rows and cells end where they are closed or where the next one begins, as their closing tags may be left out.
_ROW = r"(?i)<tr\b[^>]*>([^<]*+(?:<(?!/?tr\b)[^<]*+)*+)"
_CELL = r"(?i)<t[dh]\b([^>]*)>([^<]*+(?:<(?!/?t[dh]\b)[^<]*+)*+)"


def _table_grid(rows: Column) -> Column:
    """Cells of a table with their columns, row and column spans resolved: array of rows of (c0, c1, text).

    A fold over the rows carries the ranges of columns that an earlier row still occupies; inside a row, each cell
    starts in the next column that is free. Spans of any width are ranges, so they need no bound.
    """
    span = lambda attrs, name: F.greatest(F.coalesce(_attr(attrs, name).try_cast("int").cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))

    def place(acc: Column, row: Column) -> Column:
        def put(a: Column, cell: Column) -> Column:
            ends = F.transform(F.filter(acc["carried"], lambda x: x["c1"] > a["col"]), lambda x: x["c1"])
            free = F.array_min(F.filter(F.concat(F.array(a["col"]), ends), lambda k: ~F.exists(acc["carried"], lambda x: (x["c0"] <= k) & (k < x["c1"]))))
            end, down = free + span(cell["a"], "colspan"), span(cell["a"], "rowspan")
            held = F.when(down > 1, F.array(named(c0=free, c1=end, left=down))).otherwise(F.array().cast(_HELD))
            return named(col=end, cells=F.concat(a["cells"], F.array(named(c0=free, c1=end, text=plain(cell["b"])))), held=F.concat(a["held"], held))

        start = named(col=F.lit(0).cast("long"), cells=F.array().cast(_CELLS), held=F.array().cast(_HELD))
        done = F.aggregate(_pairs(row, _CELL), start, put)
        aged = F.transform(F.concat(acc["carried"], done["held"]), lambda x: named(c0=x["c0"], c1=x["c1"], left=x["left"] - 1))
        return named(carried=F.filter(aged, lambda x: x["left"] > 0), grid=F.concat(acc["grid"], F.array(done["cells"])))

    empty = named(carried=F.array().cast(_HELD), grid=F.array().cast(f"array<{_CELLS}>"))
    return F.aggregate(rows, empty, place, lambda acc: acc["grid"])


def _is_heading(row: Column) -> Column:
    """Whether a row prints no figure (a bare year is none), or only years and no label."""
    beside = F.filter(F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0))), lambda c: ~c["text"].isin("", "$", "%"))
    prints_figure = F.exists(beside, lambda c: printed_number(c["text"]).isNotNull() & ~c["text"].rlike(BARE_YEAR))
    unlabelled = F.coalesce(F.get(row, F.lit(0))["text"], F.lit("")) == ""
    return ~prints_figure | (unlabelled & F.forall(beside, lambda c: c["text"].rlike(text.YEAR_PATTERN)))


def table_cells(documents: DataFrame) -> DataFrame:
    """documents (doc_id, html): one row per printed number with its row label, full column heading, year and scale."""
    keep = [c for c in documents.columns if c != "html"]
    # Tables are numbered where they start. Splitting there also keeps the text in front of each next to it.
    pieces = F.split("html", r"(?i)<table\b")
    opened = F.size(pieces) - 1
    numbered = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("<table at="), i.cast("string"), F.lit(" "), p))), "")
    # A table that is never closed ends with the document.
    whole = F.concat(numbered, F.repeat(F.lit("</table>"), F.greatest(opened - F.regexp_count("html", F.lit(r"(?i)</table\b")), F.lit(0))))
    marked = documents.select(*keep, pieces.alias("p"), whole.alias("html"))
    # A table in a cell is a table of its own and no part of the cell.
    found = F.transform(_elements(F.col("html"), "table", " "), lambda t: named(no=_attr(t["a"], "at").cast("int"), body=t["b"]))
    tables = marked.select(*keep, F.explode(F.transform(found, lambda t: named(no=t["no"], body=t["body"], before=F.get(F.col("p"), t["no"] - 1)))).alias("t"))
    before = F.element_at(F.split("t.before", r"(?i)</table>"), -1)
    blocks = F.filter(F.transform(F.split(before, r"(?i)</(?:p|div|h\d|li|span)>|<br\s*/?>"), plain), lambda b: b != "")
    lead = F.array_join(F.slice(blocks, F.greatest(F.size(blocks) - 2, F.lit(1)), F.lit(3)), " ")
    rows = F.regexp_extract_all(F.col("t.body"), F.lit(_ROW), F.lit(1))
    grid = F.filter(_table_grid(rows), lambda r: F.exists(r, lambda c: c["text"] != ""))
    grids = tables.select(*keep, F.col("t.no").alias("table_no"), lead.alias("lead"), once(grid).alias("grid"))
    # Layout tables have no number row, or only one row; every slice is safe for them, as filters may run later.
    split = grids.select("*", once(F.coalesce(F.array_position(F.transform("grid", _is_heading), F.lit(False)).cast("int"), F.lit(0))).alias("first_body"))
    split = split.filter((F.size("grid") >= 2) & (F.col("first_body") > 0)).withColumn("first_body", F.greatest("first_body", F.lit(1)))
    heads = F.flatten(F.slice("grid", F.lit(1), F.col("first_body") - 1))
    split = split.withColumn("heads", F.filter(heads, lambda c: c["text"] != "")).withColumn("body", F.slice("grid", F.col("first_body"), F.size("grid")))
    head_text = F.array_join(F.transform("heads", lambda c: c["text"]), " ")
    scaled = split.withColumn("scale", F.coalesce(text.stated_scale(head_text), text.stated_scale(F.col("lead"))))
    row = scaled.select(*keep, "table_no", "scale", "heads", F.posexplode("body").alias("row_no", "row")).withColumn("label", F.get("row", F.lit(0))["text"]).filter("label <> ''")
    cells = row.select(*keep, "table_no", "scale", "heads", "row_no", "row", "label", F.posexplode("row").alias("cell_no", "cell")).filter("cell_no > 0")
    above = F.filter("heads", lambda h: (h["c0"] > 0) & (h["c0"] < F.col("cell.c1")) & (F.col("cell.c0") < h["c1"]))
    heading = F.array_join(F.array_distinct(F.transform(above, lambda h: h["text"])), " ")
    following = F.get("row", F.col("cell_no") + 1)["text"]
    return cells.select(
        *keep, "table_no", "row_no", "cell_no", "scale", text.without_footnotes(F.col("label")).alias("label"), text.normalize_label(F.col("label")).alias("row_key"),
        once(printed_number(F.col("cell.text"))).alias("value"), F.col("cell.text").alias("raw"), heading.alias("heading"), text.last_year_in(heading).alias("year"),
        (F.col("cell.text").contains("%") | (F.coalesce(following, F.lit("")) == "%")).alias("percent"),
    ).filter("value IS NOT NULL")


# ---- findings ---------------------------------------------------------------------------------------------------


def _full(column: Column, patterns: tuple[str, ...]) -> Column:
    return column.rlike("(?i)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$")


def _dimensions_allowed(metric: Metric) -> Column:
    def allowed(d: Column) -> Column:
        verdict = None
        for axis, member in metric.dimensions:
            hit = _full(d["axis"], (axis,))
            verdict = F.when(hit, _full(d["member"], (member,))) if verdict is None else verdict.when(hit, _full(d["member"], (member,)))
        return F.lit(False) if verdict is None else verdict.otherwise(False)

    return F.forall("dimensions", allowed)


def document_unit(unit_kind: Column, currency: Column) -> Column:
    money = F.coalesce(currency, F.lit("USD"))
    return F.when(unit_kind == "currency", money).when(unit_kind == "currency_per_share", F.concat(money, F.lit("/share"))).when(unit_kind == "ratio", "pure").otherwise("shares")


def document_unit_ok(unit_kind: Column, unit: Column, currency: Column) -> Column:
    return F.coalesce(
        F.when(unit_kind == "currency", unit.rlike("^[A-Z]{3}$") & (currency.isNull() | (unit == currency)))
        .when(unit_kind == "currency_per_share", F.lower(unit).rlike("^[^/]*/share")).when(unit_kind == "ratio", F.lower(unit) == "pure")
        .otherwise(F.upper(unit).isin("SHARES", "PURE")), F.lit(False))


def _specs(df: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    return metric_spec(df.sparkSession, frameworks).select("framework", "metric_id", "unit_kind", F.col("period_type").alias("metric_period_type"), F.col("name").alias("metric_name"))


def tag_findings(tags: DataFrame, entities: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    """Tags that state a framework metric. A standard undimensioned tag outranks a hint; among hints the one with most
    dimensions does; different values at the top make the figure ambiguous."""
    who = entities.select("company_id", "framework", "fye_month", "convention", "reporting_currency")
    rows = tags.filter("NOT skipped").join(who, "company_id")
    local = _local(F.col("concept"))
    matches = []
    for f in frameworks.values():
        mine = F.col("framework") == f.name
        for m in f.metrics.values():
            standard = F.col("concept").isin(*m.concepts) & (F.size("dimensions") == 0) if m.concepts else F.lit(False)
            hinted = _full(local, m.tag_names) & _dimensions_allowed(m) if m.tag_names else F.lit(False)
            if m.concepts or m.tag_names:
                how = F.when(standard, 0).when(hinted, 1)
                matches.append(F.when(mine & how.isNotNull(), F.struct(F.lit(m.id).alias("metric_id"), how.alias("how"))))
    told = rows.select("*", F.explode(F.array_compact(F.array(*matches))).alias("m")).select("*", "m.*").join(_specs(tags, frameworks), ["framework", "metric_id"])
    is_instant = F.col("period_start").isNull()
    fits = told.filter(document_unit_ok(F.col("unit_kind"), F.col("unit"), F.col("reporting_currency")) & (is_instant == (F.col("metric_period_type") == "instant")))
    dated = fits.withColumn("p", calendar.classify(F.col("period_start"), F.col("period_end"), F.col("fye_month"), F.col("convention"))).filter("p.fiscal_period IS NOT NULL")
    keys = ["doc_id", "company_id", "framework", "metric_id", "unit_kind", "reporting_currency", F.col("metric_period_type").alias("period_type"), F.col("p.fiscal_year").alias("fiscal_year"), F.col("p.fiscal_period").alias("fiscal_period")]
    per_rank = dated.groupBy(*keys, "how", F.size("dimensions").alias("dims")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.min(F.struct("concept", "period_start", "period_end")).alias("at"))
    names = ["doc_id", "company_id", "framework", "metric_id", "unit_kind", "reporting_currency", "period_type", "fiscal_year", "fiscal_period"]
    best = per_rank.groupBy(*names).agg(F.min(F.struct("how", (-F.col("dims")).alias("d"), "low", "high", "at")).alias("b"))
    return best.select(
        *names, F.col("b.low").alias("value"), F.lit(0).cast(MONEY).alias("tolerance"), F.lit("xbrl").alias("method"), F.col("b.at.concept").alias("place"),
        F.col("b.at.period_start").alias("period_start"), F.col("b.at.period_end").alias("period_end"), F.lit(False).alias("check_only"), (F.col("b.low") != F.col("b.high")).alias("ambiguous"),
    )


# Headings of columns that cover part of a year, and of averages over one.
_PART_OF_YEAR = r"(?i)(?<!\w)(?:(?:three|six|nine)\s+months|quarters?|q[1-4])(?!\w)"
_AVERAGED = r"(?i)(?<!\w)averages?(?!\w)"


def table_findings(cells: DataFrame, entities: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    """Printed figures that state a framework metric for a fiscal year.

    A row label either matches a metric's wording, or equals its name and then only serves to check. Sub-period,
    other-month and unwanted average columns are left out. The first table to state a figure supplies it; a later
    table that disagrees beyond rounding removes it.
    """
    who = entities.select("company_id", "framework", "fye_month", "reporting_currency")
    rows = cells.join(who, "company_id")
    key, rules = F.col("row_key"), []
    hint = None
    for f in frameworks.values():
        mine = F.col("framework") == f.name
        for m in f.metrics.values():
            entry = lambda only: F.struct(F.lit(m.id).alias("metric_id"), F.lit(only).alias("check_only"))  # noqa: B023, E731
            if m.labels:
                rules.append(F.when(mine & _full(key, m.labels), entry(False)))
            if m.concepts:
                rules.append(F.when(mine & (key == text.normalize_label(F.lit(m.name))), entry(True)))
            if m.column:
                hit = mine & (F.col("metric_id") == m.id)
                hint = F.when(hit, F.col("heading").rlike(f"(?i){m.column}")) if hint is None else hint.when(hit, F.col("heading").rlike(f"(?i){m.column}"))
    told = rows.select("*", F.explode(F.array_compact(F.array(*rules))).alias("r")).select("*", "r.*").join(_specs(cells, frameworks), ["framework", "metric_id"])
    money = F.col("unit_kind").isin("currency", "count")
    month = text.month_word(F.col("heading"))
    averaged = F.col("heading").rlike(_AVERAGED) & ((F.col("metric_period_type") == "instant") | ~F.lower("metric_name").contains("average"))
    usable = told.filter(
        F.col("year").isNotNull() & ~F.col("heading").rlike(_PART_OF_YEAR) & (month.isNull() | (month == F.col("fye_month"))) & ~averaged & (~money | F.col("scale").isNotNull()))
    same_row = ["doc_id", "company_id", "framework", "metric_id", "check_only", "unit_kind", "reporting_currency", "metric_period_type", "year", "table_no", "row_no"]
    hinted = F.coalesce(hint, F.lit(False)) if hint is not None else F.lit(False)
    group = Window.partitionBy(*same_row)
    narrowed = usable.withColumn("hinted", hinted).withColumn("any_hint", F.max("hinted").over(group)).filter("hinted OR NOT any_hint")
    per_row = narrowed.groupBy(*same_row).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("scale", "cell_no").alias("scale"), F.min_by(F.struct("label", "raw", "heading"), "cell_no").alias("at")).filter("low = high")
    per_value = F.when(money, (F.col("low") * F.col("scale")).cast(MONEY)).when(F.col("unit_kind") == "ratio", (F.col("low") / F.lit(100)).cast(MONEY)).otherwise(F.col("low"))
    rounding = F.when(money, (F.col("scale") / F.lit(2)).cast(MONEY)).when(F.col("unit_kind") == "ratio", F.lit("0.00005").cast(MONEY)).otherwise(F.lit(0).cast(MONEY))
    stated = per_row.withColumn("value", per_value).withColumn("tolerance", rounding)
    figure = ["doc_id", "company_id", "framework", "metric_id", "check_only", "unit_kind", "reporting_currency", F.col("metric_period_type").alias("period_type"), F.col("year").alias("fiscal_year")]
    names = ["doc_id", "company_id", "framework", "metric_id", "check_only", "unit_kind", "reporting_currency", "period_type", "fiscal_year"]
    readings = stated.select(*figure, "value", "tolerance", "table_no", "row_no")
    first = F.min(F.struct("table_no", "row_no", "value", "tolerance")).over(Window.partitionBy(*names))
    compared = readings.withColumn("first", first)
    apart = F.abs(F.col("value") - F.col("first.value")) > F.greatest("tolerance", "first.tolerance")
    tested = compared.groupBy(*names).agg(F.first("first").alias("first"), F.bool_or(apart).alias("ambiguous"))
    return tested.select(
        *names, F.lit("FY").alias("fiscal_period"), F.col("first.value").alias("value"), F.col("first.tolerance").alias("tolerance"), F.lit("html_table").alias("method"),
        F.concat(F.lit("Table "), F.col("first.table_no").cast("string")).alias("place"), F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end"), "ambiguous",
    )


def study(documents: DataFrame, entities: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    """All usable findings of HTML documents: a tagged figure makes a table reading of the same figure unnecessary."""
    pages = documents.filter(text.media_type(F.col("html")) == "html").select("doc_id", "company_id", "html")
    tagged = tag_findings(inline_tags(pages), entities, frameworks)
    printed = table_findings(table_cells(pages), entities, frameworks).filter("NOT ambiguous")
    usable = tagged.filter("NOT ambiguous")
    same = ["doc_id", "metric_id", "period_type", "fiscal_year", "fiscal_period"]
    return usable.unionByName(printed.join(usable.select(*same), same, "left_anti"))


# ---- trust ------------------------------------------------------------------------------------------------------


def compare(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings with the known fact of the same metric and period and whether they agree; unmatched ones drop out."""
    period = ["company_id", "metric_id", "period_type", "fiscal_year", "fiscal_period"]
    facts = known.groupBy(*period).agg(F.max_by("value", F.struct("period_end", F.coalesce("period_start", "period_end"))).alias("known"))
    allowed = F.greatest(F.abs("known").cast("double") * AGREEMENT, F.col("tolerance").cast("double"))
    return findings.join(facts, period).withColumn("agrees", F.abs(F.col("known") - F.col("value")).cast("double") <= allowed)


def verdicts(documents: DataFrame, findings: DataFrame, compared: DataFrame) -> DataFrame:
    """(doc_id, status, checked, agreed, reason). documents: (doc_id, identity). Identity outranks the counts."""
    counted = compared.groupBy("doc_id").agg(F.count("*").alias("checked"), F.count_if("agrees").alias("agreed"))
    found = findings.groupBy("doc_id").agg(F.count("*").alias("found"))
    rows = documents.select("doc_id", "identity").join(found, "doc_id", "left").join(counted, "doc_id", "left").fillna(0, ["found", "checked", "agreed"])
    enough, share = F.col("checked") >= MIN_CHECKS, F.col("agreed") / F.greatest("checked", F.lit(1))
    case = (
        F.when(F.col("found") == 0, "no_findings").when(F.col("identity") == "mismatch", "other_company")
        .when(enough & (share >= MIN_AGREEMENT), "agrees").when(enough, "disagrees").when(F.col("identity") == "match", "filed_by_company").otherwise("too_few")
    )
    status = F.when(F.col("case").isin("agrees", "filed_by_company"), "verified").when(F.col("case").isin("other_company", "disagrees"), "rejected").otherwise("unverified")
    count = lambda c: F.col(c).cast("string")
    reason = (
        F.when(F.col("case") == "no_findings", "None of the framework's figures were found in it.")
        .when(F.col("case") == "other_company", "It was filed by another company.")
        .when(F.col("case") == "agrees", F.concat(F.lit("Agrees on "), count("agreed"), F.lit(" of "), count("checked"), F.lit(" shared figures.")))
        .when(F.col("case") == "disagrees", F.concat(F.lit("Disagrees on "), (F.col("checked") - F.col("agreed")).cast("string"), F.lit(" of "), count("checked"), F.lit(" shared figures.")))
        .when(F.col("case") == "filed_by_company", "Filed by this company.").otherwise("Too few shared figures to check it, so its numbers are not used.")
    )
    return rows.withColumn("case", case).select("doc_id", status.alias("status"), "found", "checked", "agreed", reason.alias("reason"))


def gap_fill(findings: DataFrame, judged: DataFrame, reported: DataFrame, documents: DataFrame) -> DataFrame:
    """Figures of verified documents for periods the structured data lacks. Best document: one with an accession, then
    the latest filed, then the latest added, then the first entered. documents: (doc_id, accession, filed, added_at) and
    entry, their position in the library; without it the smallest doc_id is the first."""
    documents = documents if "entry" in documents.columns else documents.withColumn("entry", F.col("doc_id"))
    trusted = findings.filter("NOT check_only").join(judged.filter("status = 'verified'").select("doc_id"), "doc_id")
    period = ["company_id", "metric_id", "period_type", "fiscal_year", "fiscal_period"]
    lacking = trusted.join(reported.select(*period).distinct(), period, "left_anti").join(documents.select("doc_id", "accession", "filed", "added_at", "entry"), "doc_id")
    earliest = lambda c, unit: -F.coalesce(unit(c), F.lit(-(2**62)))
    rank = F.struct(F.col("accession").isNull(), earliest("filed", F.unix_date), earliest("added_at", F.unix_micros), "entry")
    payload = [c for c in lacking.columns if c not in period and c != "entry"]
    return lacking.groupBy(*period).agg(F.min_by(F.struct(*payload), rank).alias("f")).select(*period, "f.*")


def filled_facts(filled: DataFrame, entities: DataFrame, known: DataFrame) -> DataFrame:
    """Gap-filling figures as facts. A value labelled only by year takes the dates the company's own facts have for that
    fiscal year, else the nominal year end."""
    own = known.filter("fiscal_period = 'FY'").groupBy("company_id", "period_type", "fiscal_year").agg(F.min(F.struct("period_end", "period_start")).alias("own"))
    who = entities.select("company_id", "fye_month", "convention")
    rows = filled.join(who, "company_id").join(own, ["company_id", "period_type", "fiscal_year"], "left")
    nominal = calendar.nominal_year_end(F.col("fiscal_year"), F.col("fye_month"), F.col("convention"))
    end = F.coalesce("period_end", "own.period_end", nominal)
    start = F.when(F.col("period_type") == "duration", F.coalesce("period_start", "own.period_start", F.date_add(F.add_months(nominal, -12), 1)))
    unit = document_unit(F.col("unit_kind"), F.col("reporting_currency"))
    nothing = F.lit(None).cast("string")
    dated = rows.withColumn("p_end", end).withColumn("p_start", start).withColumn("unit", unit)
    label = calendar.period_label(F.col("fiscal_year"), F.col("fiscal_period"))
    return dated.select(
        ids.fact_id(F.col("company_id"), F.col("metric_id"), F.col("period_type"), F.col("p_start"), F.col("p_end"), label, "reported",
                    F.concat_ws("|", F.col("doc_id").cast("string"), "place", F.col("value").cast("string"))).alias("fact_id"),
        "company_id", "framework", "metric_id", "value", F.col("value").cast("double").alias("value_f"), "unit",
        F.when(F.col("unit_kind").isin("currency", "currency_per_share"), F.coalesce("reporting_currency", F.lit("USD"))).alias("currency"), "period_type",
        F.col("p_start").alias("period_start"), F.col("p_end").alias("period_end"), "fiscal_year", "fiscal_period", F.lit("reported").alias("provenance"), "method",
        F.col("doc_id").cast("string").alias("document_id"), F.when(F.col("method") == "xbrl", F.col("place")).alias("concept"), "accession", nothing.alias("form"), "filed",
        F.array().cast("array<string>").alias("inputs"), nothing.alias("formula"), F.col("place").alias("notes"),
    ).select(*FACT_COLUMNS)


def corpus_report(documents: DataFrame, judged: DataFrame, filled: DataFrame) -> DataFrame:
    """Per document: status, counts, and the periods it contributed."""
    gave = filled.groupBy("doc_id").agg(
        F.count("*").alias("contributed"),
        F.array_sort(F.collect_set(F.concat_ws(" ", "metric_id", calendar.period_label(F.col("fiscal_year"), F.col("fiscal_period"))))).alias("periods"))
    return documents.select("doc_id", "identity").join(judged, "doc_id").join(gave, "doc_id", "left").fillna(0, ["contributed"])
