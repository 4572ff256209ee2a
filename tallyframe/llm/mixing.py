"""Mixing sources to target weights as weighted fair queueing, with built-in functions only.

Every source gets a target of words from its weight. Its documents are put in a fixed random order, and each copy of a
document gets a virtual finish time: the words of its source up to its end, over the source's target. All copies of all
sources are sorted by finish time and taken until the budget is used, so sources fill up evenly and each ends near its
target, within about a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, carry, row_key, running, stage, text_of

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """sizes (source, source_size; one row a source) with position and target, whose sum is `share` of all sizes.

    Sources in code point order, null last, take the weights in turn. No target is above `most` times the source's
    size: what is over goes to the others by weight until none is above. With a = budget less the caps of the sources
    that fill first, and w = the weights of the rest, the level that a unit of weight reaches is the largest a / w.
    """
    at = running(sizes, [F.col("source").isNull(), F.col("source")], {"position": F.lit(1)})
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("position") - 1, F.lit(len(weights))).cast("int") + 1)
    caps = at.withColumn("weight", turn.cast("long")).withColumn("cap", F.col("source_size") * most)
    filled = running(caps, [F.col("cap") / F.col("weight"), F.col("position")], {"caps": F.col("cap"), "weights": F.col("weight")})
    filled = stage(filled, "targets")
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if whole.size is None:
        return filled.select("source", "source_size", "position", F.lit(0.0).alias("target"))
    budget, weight = whole.size * share, whole.weight
    level = filled.agg(F.max((F.lit(float(budget)) - (F.col("caps") - F.col("cap"))) / (F.lit(weight) - (F.col("weights") - F.col("weight"))))).first()[0]
    return filled.select("source", "source_size", "position", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def order_of() -> list[Column]:
    """A random order of documents that is the same in every run."""
    return [F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.col("doc_id")]


def mix(docs: DataFrame, *carried: Column, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """Per row of `docs`: doc_id, `carried`, source, size, source_size, target, copies and taken (copies times size).

    Null texts have no words; documents without words are never copied and count as taken once where their source has
    a target. Null is a source. Repeated rows are documents of their own. No rows give no rows.
    """
    thin = stage(docs.select("doc_id", "source", words(text_of()).alias("size"), *carried).withColumn("uid", F.monotonically_increasing_id()), "sizes")
    sources = stage(targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "sources")
    placed = thin.join(sources, thin.source.eqNullSafe(sources.source)).select(thin["*"], "source_size", "position", "target")
    queued = running(placed.filter("size > 0 and target > 0").select("uid", "doc_id", "size", "source_size", "position", "target"), order_of() + [F.col("uid")], {"cum": F.col("size")}, ("position",))
    rounds = F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")) + 1).cast("int")
    copies = queued.select("*", F.explode(F.sequence(F.lit(0), rounds - 1)).alias("round"))
    copies = copies.select("uid", "doc_id", "size", "position", "round", ((F.col("round") * F.col("source_size") + F.col("cum")) / F.col("target")).alias("finish"))
    sorted_ = running(copies, [F.col("finish"), F.col("position"), F.col("round"), F.col("uid")], {"total": F.col("size")})
    budget = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    taken = sorted_.filter(F.col("total") <= F.lit(float(budget))).groupBy("uid").agg(F.count("*").alias("copies"))
    copies_ = F.when((F.col("size") == 0), F.when(F.col("target") > 0, 1).otherwise(0)).otherwise(F.coalesce("copies", F.lit(0))).cast("long")
    return placed.join(taken, "uid", "left").withColumn("copies", copies_).withColumn("taken", F.col("copies") * F.col("size")).drop("uid", "position")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """The rows of `docs`, all their columns, each as often as the mix takes it."""
    k1, k2 = row_key(docs)
    mixed = mix(docs, k1.alias("_k1"), k2.alias("_k2"), weights=weights, share=share, most=most)
    actions = mixed.groupBy("_k1", "_k2").agg(F.sum("copies").alias("_copies"), F.count("*").alias("n")).filter("n > 1 or _copies != 1")
    return carry(docs, stage(actions.drop("n"), "copies"))
