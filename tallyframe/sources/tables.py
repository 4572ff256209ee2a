"""The star-schema tables read as disclosures.

A supplier is a company, the lines it shipped in a quarter are its revenue, discount is its cost, and so on. Quarter
sums are aggregated first (map-side combined), so a supplier that owns a third of all lines costs no more than any
other; everything after works on at most a few hundred rows per supplier.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import MONEY

# Metric -> (tag, measure column). A flow is reported year to date in every quarter.
FLOWS = {
    "revenue": ("Revenues", "net"),
    "cost_of_revenue": ("CostOfRevenue", "disc"),
    "income_tax_expense": ("IncomeTaxExpenseBenefit", "tax"),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities", "net"),
    "investing_cash_flow": ("NetCashProvidedByUsedInInvestingActivities", "neg_tax"),
    "financing_cash_flow": ("NetCashProvidedByUsedInFinancingActivities", "neg_disc"),
    "net_change_in_cash": ("CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect", "change"),
    "capital_expenditure": ("PaymentsToAcquirePropertyPlantAndEquipment", "tax"),
    "diluted_shares": ("WeightedAverageNumberOfDilutedSharesOutstanding", "qty"),
    "pre_tax_income": ("IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "pretax"),
    "operating_income": ("OperatingIncomeLoss", "swing"),
    "gross_profit": ("GrossProfit", "gross_profit"),
    "net_interest_income": ("InterestIncomeExpenseNet", "net"),
    "noninterest_income": ("NoninterestIncome", "disc"),
    "noninterest_expense": ("NoninterestExpense", "tax"),
    "provision_for_credit_losses": ("ProvisionForLoanLeaseAndOtherLosses", "half_tax"),
    "net_income_to_common": ("NetIncomeLossAvailableToCommonStockholdersBasic", "common"),
}
BALANCES = {
    "total_assets": ("Assets", "cum_gross"),
    "total_liabilities": ("Liabilities", "cum_disc"),
    "total_equity": ("StockholdersEquity", "cum_net"),
    "cash_and_restricted_cash": ("CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "cum_change"),
    "cash_and_equivalents": ("CashAndCashEquivalentsAtCarryingValue", "cum_tax"),
    "total_debt": ("LongTermDebt", "cum_disc"),
    "loans": ("LoansReceivableNet", "cum_net"),
    "deposits": ("Deposits", "cum_gross"),
}
# Reported once a year only.
ANNUAL_ONLY = {"diluted_shares", "operating_income"}


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact decimal sums per supplier and quarter."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # Products are formed in whole cents and whole percents, which is exact and stays in machine integers. Each sum is
    # kept in two parts (millions and the rest), so that no supplier is too large for it, and joined as a decimal.
    cents, pct, tax_pct = (F.round(F.col(c) * 100).cast("long") for c in ("l_extendedprice", "l_discount", "l_tax"))
    net = cents * (100 - pct)
    scaled = {
        "gross": (cents, 2), "disc": (cents * pct, 4), "net": (net, 4), "tax": (net * tax_pct, 6),
        "qty": (F.round(F.col("l_quantity") * 100).cast("long"), 2), "net_r": (F.when(F.col("l_returnflag") != "R", net).otherwise(0), 4),
    }
    parts = []
    for name, (amount, _) in scaled.items():
        rest = amount % F.lit(1_000_000)
        parts += [F.sum(((amount - rest) / 1_000_000).cast("long")).alias(f"{name}_high"), F.sum(rest).alias(f"{name}_low")]
    sums = lines.groupBy(F.col("l_suppkey").alias("co"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).agg(*parts)

    def joined(name: str, places: int) -> Column:
        whole = F.col(f"{name}_high").cast("decimal(19,0)") * F.lit(Decimal(1_000_000)) + F.col(f"{name}_low").cast("decimal(19,0)")
        return (whole.cast("decimal(28,0)") * F.lit(Decimal(1).scaleb(-places))).cast(MONEY).alias(name)

    return sums.select("co", "y", "q", *[joined(name, places) for name, (_, places) in scaled.items()])


def _money(column: Column) -> Column:
    return column.cast(MONEY)


MEASURES = ("gross", "disc", "net", "tax", "qty", "net_r")


def _year_to_date(spark: SparkSession, sf_dir: str, history: bool, upto_quarters: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """One row per supplier, year and quarter i of `upto_quarters` with year-to-date sums up to i; absent quarters are zero.

    Quarters become an array per supplier and year, so year-to-date sums need no further shuffle. With `history`,
    the row also carries running totals over years, the all-years net and the first year.
    """
    by_quarter = [
        F.array(*[F.coalesce(F.sum(F.when(F.col("q") == i, F.col(m))), F.lit(0)).cast(MONEY) for i in (1, 2, 3, 4)]).alias(m) for m in MEASURES
    ]
    years = quarters(spark, sf_dir).groupBy("co", "y").agg(*by_quarter)
    whole = lambda m: F.aggregate(m, F.lit(0).cast(MONEY), lambda a, v: _money(a + v))
    extra = []
    if history:
        company = Window.partitionBy("co")
        running = company.orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
        years = years.select("*", *[whole(m).alias(f"year_{m}") for m in ("gross", "disc", "net", "tax")])
        years = years.select(
            "*", *[_money(F.sum(f"year_{m}").over(running)).alias(f"run_{m}") for m in ("gross", "disc", "net", "tax")],
            _money(F.sum("year_net").over(company)).alias("all_net"), F.min("y").over(company).alias("y0"),
        )
        extra = ["run_gross", "run_disc", "run_net", "run_tax", "all_net", "y0"]
    upto = lambda m: F.aggregate(F.slice(m, F.lit(1), F.col("i")), F.lit(0).cast(MONEY), lambda a, v: _money(a + v)).alias(m)
    return years.withColumn("i", F.explode(F.array(*[F.lit(i) for i in upto_quarters]))).select("co", "y", "i", *[upto(m) for m in MEASURES], *extra)


def _measures() -> dict[str, Column]:
    co = F.col("co")
    net, disc, tax = F.col("net"), F.col("disc"), F.col("tax")
    return {
        "net": net, "disc": disc, "tax": tax, "qty": F.col("qty"), "neg_tax": -tax, "neg_disc": -disc, "change": net - tax - disc,
        "pretax": net - disc, "half_tax": tax / F.lit(2), "common": net - disc - tax - F.lit(100), "swing": F.lit(7) * net - F.col("all_net"),
        # Every third supplier also reports gross profit itself; every sixth disagrees with its own lines.
        "gross_profit": F.when(co % 3 == 0, net - disc + F.when(co % 6 == 0, 1000).otherwise(0)),
        "cum_gross": F.col("run_gross") + F.when(co % 9 == 0, 5000).otherwise(0), "cum_disc": F.col("run_disc"), "cum_net": F.col("run_net"),
        "cum_tax": F.col("run_tax"), "cum_change": F.col("run_net") - F.col("run_tax") - F.col("run_disc"),
    }


def accession(co: Column, year: Column, sequence: Column) -> Column:
    return F.concat_ws("-", F.lpad(co.cast("string"), 10, "0"), F.lpad((year % 100).cast("string"), 2, "0"), F.lpad(sequence.cast("string"), 6, "0"))


def observations(spark: SparkSession, sf_dir: str, metrics: list[str], faults: tuple[str, ...] = (), full_years: bool = False) -> DataFrame:
    """Observations of the chosen metrics, with the irregularities real filings have.

    Always: year-to-date flows, annual values refiled a year later (revenue restated for every fifth supplier), a
    second revenue tag before 1998 for every fourth supplier, euros for some, an 8-K row for some, shares tagged in
    money for some, opening cash dated three days early for some, and assets that do not tie for every ninth.
    faults: 'gap' drops FY1998 revenue of every sixth supplier; 'scale' multiplies FY1999 revenue of every
    eleventh by a thousand. full_years: only what covers a year or stands at its end, for readers of nothing else; all
    lines count, but the year-to-date rows of the other quarters are not made.
    """
    history = any(m in BALANCES or m == "operating_income" for m in metrics)
    rows = _year_to_date(spark, sf_dir, history, (4,) if full_years else (1, 2, 3, 4))
    measure = _measures()
    co, y, i = F.col("co"), F.col("y"), F.col("i")
    jan1 = F.make_date(y, F.lit(1), F.lit(1))
    quarter_end = F.last_day(F.make_date(y, i * 3, F.lit(1)))
    currency = F.when(co % 10 == 3, "EUR").otherwise("USD")
    no_start, annual = F.lit(None).cast("date"), i == 4

    def item(tag, unit: Column, value: Column, again: Column, start: Column, end: Column, kind: str, when: Column) -> Column:
        concept = F.lit(tag) if isinstance(tag, str) else tag
        return F.when(when & value.isNotNull(), F.struct(
            concept.alias("concept"), unit.alias("unit"), _money(value).alias("value"), _money(again).alias("again"),
            start.alias("period_start"), end.alias("period_end"), F.lit(kind).alias("kind"),
        ))

    items: list[Column] = []
    for m in metrics:
        if m in FLOWS:
            tag, name = FLOWS[m]
            value = again = measure[name]
            unit, when, kind = currency, annual if m in ANNUAL_ONLY else F.lit(True), "flow"
            if m == "diluted_shares":
                unit = F.when(co % 25 == 0, "USD").otherwise("shares")
            if m == "revenue":
                kind = "revenue"
                tag = F.when((co % 4 == 0) & (y < 1998), "RevenueFromContractWithCustomerExcludingAssessedTax").otherwise(tag)
                again = F.when(co % 5 == 0, F.col("net_r")).otherwise(value)
                if "gap" in faults:
                    when = ~(annual & (co % 6 == 0) & (y == 1998))
                if "scale" in faults:
                    wrong = annual & (co % 11 == 0) & (y == 1999)
                    again = F.when(wrong, value * 1000).otherwise(again)
                    value = F.when(wrong, value * 1000).otherwise(value)
            items.append(item(tag, unit, value, again, jan1, quarter_end, kind, when))
        else:
            tag, name = BALANCES[m]
            items.append(item(tag, currency, measure[name], measure[name], no_start, quarter_end, "balance", annual))
            if m == "cash_and_restricted_cash":
                # The balance the first year opens with, dated early for every seventh supplier.
                opening = F.make_date(y - 1, F.lit(12), F.when(co % 7 == 0, 28).otherwise(31))
                items.append(item(tag, currency, F.lit(0), F.lit(0), no_start, opening, "balance", annual & (y == F.col("y0"))))
    # Nulls are dropped after the arrays are taken apart, in compiled code; array_compact runs uncompiled with all inside it.
    tagged = rows.select("co", "y", "i", F.explode(F.array(*items)).alias("e")).filter("e IS NOT NULL")

    def filing(form: str, filed: Column, seq: Column | int, restated: bool, when: Column) -> Column:
        number = F.lit(seq) if isinstance(seq, int) else seq
        return F.when(when, F.struct(F.lit(form).alias("form"), filed.alias("filed"), number.cast("int").alias("seq"), F.lit(restated).alias("restated")))

    kind, filed_10k = F.col("e.kind"), F.make_date(y + 1, F.lit(2), F.lit(20))
    filings = F.array(
        filing("10-Q", F.date_add(F.col("e.period_end"), 40), i, False, ~annual),
        filing("10-K", filed_10k, 4, False, annual),
        filing("10-K", F.make_date(y + 2, F.lit(2), F.lit(20)), 5, True, annual & (kind != "balance")),
        filing("8-K", filed_10k, 9, False, annual & (kind == "revenue") & (co % 8 == 0)),
    )
    filed = tagged.select("co", "y", "e", F.explode(filings).alias("f")).filter("f IS NOT NULL")
    return filed.select(
        F.concat(F.lit("co-"), co.cast("string")).alias("company_id"), F.lit("us-gaap").alias("taxonomy"), "e.concept", "e.unit",
        F.when(F.col("f.restated"), F.col("e.again")).otherwise(F.col("e.value")).alias("value"), "e.period_start", "e.period_end",
        accession(co, F.year("f.filed"), y * 10 + F.col("f.seq")).alias("accession"), "f.form", "f.filed", F.lit(None).cast("string").alias("frame"),
    )


def entities(spark: SparkSession, sf_dir: str, framework: str = "generic") -> DataFrame:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return suppliers.select(
        F.concat(F.lit("co-"), F.col("s_suppkey").cast("string")).alias("company_id"),
        F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), F.col("s_name").alias("name"),
        F.array(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("tickers"), F.array(F.lit("X")).alias("exchanges"),
        F.lit(None).cast("int").alias("sic"), F.lit(12).alias("fye_month"), F.lit("end_year").alias("convention"),
        F.lit("USD").alias("reporting_currency"), F.lit(framework).alias("framework"),
    )
