"""Companies: classification, search and configuration checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import named
from ..functions.text import endpoint_of
from ..sources.specs import Framework

FALLBACK = "generic"


def classify(entities: DataFrame, frameworks: dict[str, Framework]) -> DataFrame:
    """Framework per company: configured override, else the one SIC match, else generic; several matches are an error.

    The few ranges of the frameworks are literals in one expression, so nothing is joined.
    """
    ranges = [F.when(F.col("sic").between(lo, hi), F.lit(f.name)) for f in frameworks.values() for lo, hi in f.sic]
    hits = F.array_sort(F.array_distinct(F.array_compact(F.array(*ranges)))) if ranges else F.array().cast("array<string>")
    label = F.concat(F.lit("SIC "), F.col("sic").cast("string"))
    found = entities.withColumn("candidates", hits)
    n = F.size("candidates")
    method = (
        F.when(F.col("override").isNotNull(), "config_override").when(n == 1, "sic_match").when(n > 1, "ambiguous").otherwise("fallback")
    )
    chosen = F.when(F.col("override").isNotNull(), F.col("override")).when(n == 1, F.element_at("candidates", 1)).when(n > 1, F.lit(None)).otherwise(FALLBACK)
    differs = F.col("sic").isNotNull() & (n > 0) & ~F.array_contains("candidates", F.col("override"))
    note = F.when(differs, F.concat(F.lit(" (note: "), label, F.lit(" suggests "), F.array_join("candidates", ", "), F.lit(")"))).otherwise("")
    evidence = (
        F.when(F.col("override").isNotNull(), F.concat(F.lit("industry_framework: "), F.col("override"), F.lit(" in config"), note))
        .when(F.col("sic").isNull(), "no SIC code available").when(n == 1, label)
        .when(n > 1, F.concat(label, F.lit(" matches several frameworks: "), F.array_join("candidates", ", ")))
        .otherwise(F.concat(label, F.lit(" matches no specific framework")))
    )
    return found.select(*entities.columns, chosen.alias("selected"), method.alias("method"), evidence.alias("evidence"))


def search(index: DataFrame, queries: list[str], limit: int = 8, aliases: DataFrame | None = None) -> DataFrame:
    """Best companies per query: exact ticker, then name or ticker prefix, then name contains; index order inside a tier.

    index: (position, ticker, name). The short list of queries is tested against each company where it lies. `aliases`
    (ticker, position) names further tickers of a company. Only the best `limit` rows per query and task leave a task
    (Spark limits the ranking before the shuffle), so a query that matches everything stays cheap.
    """
    asked = [q for q in dict.fromkeys(" ".join(text.split()) for text in queries) if q]
    other = _with_tickers(index, aliases)
    tried = F.array(*[named(query=F.lit(q), tier=_tier(F.lit(q))) for q in asked])
    hits = F.filter(tried, lambda h: h["tier"].isNotNull())
    matched = other.select("position", "ticker", "name", F.explode(hits).alias("h")).select("position", "ticker", "name", "h.*")
    best = Window.partitionBy("query").orderBy("tier", "position")
    return matched.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit).select("query", "place", "ticker", "name", "tier")


def _with_tickers(index: DataFrame, aliases: DataFrame | None) -> DataFrame:
    other = index.withColumn("tickers", F.array("ticker"))
    if aliases is None:
        return other
    extra = aliases.groupBy("position").agg(F.collect_set("ticker").alias("more"))
    return other.join(extra, "position", "left").withColumn("tickers", F.array_union("tickers", F.coalesce("more", F.array().cast("array<string>")))).drop("more")


def _tier(q: Column) -> Column:
    """0 for an exact ticker, 1 where name or ticker begins with the query, 2 where the name contains it, else null."""
    low, name = F.lower(q), F.lower("name")
    return F.when(F.array_contains("tickers", F.upper(q)), 0).when(F.startswith(name, low) | F.startswith(F.lower("ticker"), low), 1).when(F.contains(name, low), 2)


GRAM = 3


def _grams(texts: Column, lengths: range) -> Column:
    """All distinct parts of the given lengths of an array of texts, in lower case."""
    def parts(t: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substr(F.lower(t), i, F.lit(n)))

    each = F.transform(texts, lambda t: F.flatten(F.array(*[parts(t, n) for n in lengths])))
    return F.array_distinct(F.flatten(each))


def _names(index: DataFrame) -> DataFrame:
    """(low, first): every distinct name in lower case with the first position that has it."""
    return index.filter("name is not null").groupBy(F.lower("name").alias("low")).agg(F.min("position").alias("first"))


def _firsts(df: DataFrame, by: str, order: list, limit: int) -> DataFrame:
    """The first `limit` rows of each `by`; Spark limits them in each task before they meet."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")


def gram_index(index: DataFrame) -> DataFrame:
    """(gram, first): which distinct names, by the first position that has them, have a part of one to three letters.
    Written once, it answers any number of queries of `search_index`."""
    return _names(index).select("first", F.explode(_grams(F.array("low"), range(1, GRAM + 1))).alias("gram")).filter("gram <> ''")


def search_index(queries: DataFrame, index: DataFrame, grams: DataFrame, limit: int = 8, aliases: DataFrame | None = None) -> DataFrame:
    """What `search` gives, for a table of queries (query).

    A query meets tickers by their beginnings and names by its rarest gram, each distinct name once. Of what is alike for a
    query (tickers with one beginning, companies of one name, names of one tier) only the first `limit` can be among its
    best, so no more are kept. A query that is not longer than a gram is looked up whole.
    """
    said = F.regexp_replace(F.trim(F.regexp_replace("query", r"(?U)\s+", " ")), "^ | $", "")
    asked = queries.select(said.alias("query")).filter("query <> ''").distinct()
    low = F.lower("query")
    # Tickers: whole ones in capitals, and all beginnings of the first one in small letters.
    companies = _with_tickers(index, aliases)
    ticker = F.lower(F.coalesce("ticker", F.lit("")))
    begun = F.transform(F.sequence(F.lit(1), F.greatest(F.length(ticker), F.lit(1))), lambda i: F.concat(F.lit("b"), F.substr(ticker, F.lit(1), i)))
    whole = F.transform(F.array_compact("tickers"), lambda t: F.concat(F.lit("w"), t))
    keys = _firsts(companies.select("position", F.explode(F.array_distinct(F.concat(whole, begun))).alias("key")), "key", ["position"], limit)
    by_key = asked.select("query", F.explode(F.array(F.concat(F.lit("w"), F.upper("query")), F.concat(F.lit("b"), low))).alias("key"))
    by_ticker = by_key.join(keys, "key").select("query", "position")
    # Names: those with the rarest gram of the query are tested.
    parts = asked.select("query", F.explode(F.when(F.length(low) < GRAM, F.array(low)).otherwise(_grams(F.array("query"), range(GRAM, GRAM + 1)))).alias("gram"))
    sizes = grams.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = parts.join(sizes, "gram", "left").groupBy("query").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    tested = rarest.join(grams, "gram").join(_names(index), "first").filter(F.contains("low", low))
    named_best = _firsts(tested.select("query", "low", "first", F.startswith("low", low).alias("begins")), "query", [F.desc("begins"), "first"], limit)
    of_name = _firsts(index.filter("name is not null").select("position", F.lower("name").alias("low")), "low", ["position"], limit)
    by_name = named_best.join(of_name, "low").select("query", "position")
    found = by_ticker.unionByName(by_name).distinct().join(companies, "position")
    matched = found.select("query", "position", "ticker", "name", _tier(F.col("query")).alias("tier")).filter("tier is not null")
    best = Window.partitionBy("query").orderBy("tier", "position")
    return matched.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit).select("query", "place", "ticker", "name", "tier")


def config_violations(config: DataFrame, sources: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(company_id, rule, detail) for every configuration that would mix up companies.

    config: (company_id, cik, ticker, fye_month). sources: (company_id, kind, url, path) with blanks already dropped.
    profiles: what the regulator says (cik, tickers, fye_month, facts_cik).
    """
    located = sources.withColumn("location", F.coalesce("url", "path")).withColumn("e", endpoint_of(F.col("url")))
    report = lambda df, rule, detail: df.select("company_id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    twice = located.groupBy("company_id", "location").agg(F.count("*").alias("n")).filter("n > 1")
    both = located.filter("url IS NOT NULL AND path IS NOT NULL")
    optional = F.col("kind").isin("investor_relations", "optional_consensus", "optional_market_data")
    primary = located.filter(~optional).select("company_id").distinct()
    lacking = config.join(primary, "company_id", "left_anti")
    structured = located.filter("kind = 'structured_filings'")
    regulator = F.col("url").startswith("https://data.sec.gov/")
    unsupported = structured.filter(regulator & F.col("e.endpoint").isNull())
    misplaced = located.filter("kind <> 'structured_filings'").filter(F.col("e.endpoint").isNotNull())
    own = structured.filter(F.col("e.endpoint").isNotNull()).join(config.select("company_id", "cik"), "company_id")
    plain = located.filter(F.col("url").isNotNull() & ~F.col("url").startswith("https://"))
    found = [
        report(twice, "source_listed_twice", F.col("location")), report(both, "two_locations", F.col("url")), report(plain, "not_https", F.col("url")),
        report(lacking, "no_primary_source", F.col("company_id")), report(unsupported, "unsupported_endpoint", F.col("url")),
        report(misplaced, "structured_source_misplaced", F.col("url")), report(own.filter("cik IS NULL"), "cik_required", F.col("url")),
        report(own.filter("cik <> e.cik"), "cik_mismatch", F.col("url")),
    ]
    if profiles is not None:
        p = profiles.select("company_id", F.col("cik").alias("p_cik"), F.col("tickers").alias("p_tickers"), F.col("fye_month").alias("p_fye"))
        known = config.join(p, "company_id")
        found += [
            report(known.filter("cik <> p_cik"), "profile_cik_mismatch", F.col("p_cik")),
            report(known.filter(F.size("p_tickers") > 0).filter(~F.array_contains("p_tickers", F.col("ticker"))), "ticker_not_listed", F.col("ticker")),
            report(known.filter("fye_month <> p_fye"), "fiscal_year_end_differs", F.col("p_fye")),
        ]
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    return every
