"""SimHash near-duplicates found by meeting in the middle.

Two fingerprints that differ in at most two bits have a variant in common that differs from each in at most one. Every
distinct fingerprint emits itself and its 64 one-bit variants; those that share a variant are joined to the least of
them, verified, and the links' components are the groups. A variant meets at most 65 fingerprints whatever the data, and
all that meet at one are within two bits of each other, so a star of links holds them together as all pairs would.

`deduplicate`, the stage of the pipeline, links texts with a similarity of 0.8 on five words. It starts from the same
fingerprints and links, each verified on all shingles. Texts right at 0.8 differ in some ten bits, where no SimHash of 64
bits meets them, so what it leaves is completed by bands of minima, which the second half of this module holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import ascii_lower, carry, filter_positions, filter_rows, filter_size, give_back, row_key, ship, stage, text_of, with_maybe
from .components import components
from .fingerprints import likeness, with_sketch

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2  # half of it is the radius of the ball that is emitted
HASHES_AT_ONCE = 1 << 18


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The signed 64-bit SimHash over shingles of `words` words, repeats counted; 0 without words."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8").lower().split()  # both are ASCII only on bytes
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = iter([b" ".join(parts)])
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    n, ones = max(1, len(parts) - words + 1), np.zeros(64, np.int64)
    for start in range(0, n, HASHES_AT_ONCE):
        some = min(HASHES_AT_ONCE, n - start)
        hashes = np.fromiter((xxh64_intdigest(next(shingles), seed) for _ in range(some)), "<u8", some)
        # Bit counts by columns of bits: eight bytes a hash, each unpacked into its eight bits.
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *carried: Column, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, `carried` and fp per row of `docs`, which keeps its order and number of rows."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint_of(t.as_py(), words) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], [*batch.schema.names[:-1], "fp"])
        give_back()

    ship(docs.sparkSession)
    inner = docs.select("doc_id", *carried, "text")
    schema = inner.drop("text").schema.add("fp", "long")
    return stage(inner.mapInArrow(hashed, schema), "simhash")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints within two bits, enough of them to connect all that are. fps: one fp a row, distinct."""
    ball = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = fps.select("fp", F.explode(ball).alias("variant"))
    star = met.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("least")).filter("fp != least").distinct()
    return star.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= RADIUS).select(F.col("least").alias("a"), F.col("fp").alias("b"))


def near_groups(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp, ...) with component_id: the smallest doc_id reachable over links, the row's own included.

    Equal fingerprints are always linked, so null, empty and white texts (fingerprint 0) form one group with whatever
    lies within two bits of 0. Repeated rows share a group. A group without any doc_id has a null component_id.
    """
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    found = stage(components(links(classes.select("fp"))), "components")
    placed = classes.join(found, classes.fp == found.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return prints.join(placed.select("fp", "component").join(ids, "component").select("fp", "component_id"), "fp")


# ---- near-duplicates by similarity ---------------------------------------------------------------------------------

# Five words and a Jaccard similarity of 0.8. Texts that similar differ in some ten of 64 SimHash bits, so further
# candidates come from bands of minima: a minimum over all shingles is the same in two texts with a probability of their
# similarity, a band of BAND_ROWS minima with its power, whatever the number of texts.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
BAND_ROWS = 6
MISS = 1e-3  # the part of the pairs right at the similarity that meet in no band; of more similar ones it is less

_STEP, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # fixed values of the splitmix64 mixer


def bands_for(similarity: float = SIMILARITY, miss: float = MISS) -> int:
    """How many bands leave at most `miss` of the pairs at `similarity` without one in common."""
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log1p(-(similarity**BAND_ROWS)))


def band_keys(text: str | None, words: int = SIMILAR_WORDS, bands: int = bands_for()) -> np.ndarray:
    """A signed 64-bit key for each band: its number and BAND_ROWS minima over the distinct shingles; equal for all texts without words."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8").lower().split()
    joined = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) > words else [b" ".join(parts)]
    hashes = np.unique(np.fromiter(map(xxh64_intdigest, joined), "<u8"))
    seeds = _STEP * np.arange(1, bands * BAND_ROWS + 1, dtype="<u8")
    least = np.full(len(seeds), np.iinfo(np.uint64).max, "<u8")
    for start in range(0, len(hashes), 255):  # so many stay in a cache
        part = hashes[start : start + 255, None] + seeds
        part ^= part >> np.uint64(30)
        part *= _MIX_A
        part ^= part >> np.uint64(27)
        part *= _MIX_B
        np.minimum(least, part.min(axis=0), out=least)
    rows = least.reshape(bands, BAND_ROWS)
    return np.array([xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], "<u8").view("<i8")


def crowded(prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From prints (uid, _k1, _k2, keys), all of them written: (key, uid) of the texts that share a band with others, of
    repeated rows (one _k1 and _k2) the least uid for all; these uids with their _k1 and _k2; and (a, b) from them to the repeats."""
    keyed = stage(prints.select("uid", F.explode("keys").alias("key")), "keys")
    met = stage(keyed.groupBy("key").count().filter("count > 1").select("key"), "met")
    held = stage(keyed.join(met, "key"), "crowded")
    rows = stage(prints.select("uid", "_k1", "_k2").join(held.select("uid").distinct(), "uid"), "rows")
    classes = stage(rows.groupBy("_k1", "_k2").agg(F.min("uid").alias("least")), "classes")
    known = stage(rows.join(classes, ["_k1", "_k2"]).select("uid", "least"), "known")
    each = stage(held.join(known, "uid").select("key", F.col("least").alias("uid")).distinct(), "crowds")
    return each, classes.withColumnRenamed("least", "uid"), known.filter("uid != least").select(F.col("least").alias("a"), F.col("uid").alias("b"))


def simhash_pairs(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From prints (uid, _k1, _k2, fp, ...), written: the pairs (a, b) that SimHash meets, and uid, _k1, _k2 of the texts in
    them. Repeated rows stand under their least uid. Texts of one fingerprint are paired with the least of them, which
    stands for the fingerprint in the links to others."""
    each = stage(prints.groupBy("_k1", "_k2").agg(F.min("uid").alias("uid"), F.first("fp").alias("fp")), "distinct")
    least = stage(each.groupBy("fp").agg(F.min("uid").alias("least"), F.count("*").alias("n")), "fingerprints")
    same = each.join(least.filter("n > 1"), "fp").filter("uid != least").select(F.col("least").alias("a"), F.col("uid").alias("b"))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}"))
    linked = links(least.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    pairs = stage(same.unionByName(linked), "simhash-pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    return pairs, each.join(met, "uid").select("uid", "_k1", "_k2")


def crowds(held: DataFrame) -> DataFrame:
    """(key, uid, rep) of all texts that meet others in a band (key, uid); rep is the one of them that meets most in all
    its bands, so that a text which many were copied from stands for its copies."""
    counted = stage(held.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "counted")
    meets = stage(held.join(counted, "key").groupBy("uid").agg(F.sum("n").alias("meets")), "meets")
    ranked = stage(held.join(meets, "uid"), "ranked")
    reps = ranked.groupBy("key").agg(F.max_by("uid", F.struct("meets", -F.col("uid"))).alias("rep"))
    return stage(ranked.select("key", "uid").join(stage(reps, "representatives"), "key"), "crowds")


def first_pairs(met: DataFrame) -> DataFrame:
    """(a, b): every text of crowds (key, uid, rep) with the representative of each."""
    return met.filter("uid != rep").select(F.least("rep", "uid").alias("a"), F.greatest("rep", "uid").alias("b")).distinct()


def unsettled(met: DataFrame, found: DataFrame) -> DataFrame:
    """(uid, component, apart) of the texts in crowds that found (node, component) does not hold together; apart: whether
    the text is outside the component that most texts of one of its crowds are in. Of two texts that share a crowd and no
    component, one at least is apart."""
    placed = stage(met.join(found, met.uid == found.node, "left").select("key", "uid", F.coalesce("component", "uid").alias("component")), "placed")
    parts = placed.groupBy("key", "component").count()
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    split = placed.join(stage(main, "main"), "key")
    return stage(split.groupBy("uid", "component").agg(F.max(F.col("component") != F.col("main")).alias("apart")), "unsettled")


def other_pairs(open_: DataFrame, held: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of `unsettled` texts in different components that may be as similar as asked for; one at least is
    apart. held: (uid, s), the `shingle_sets`.

    Exact: of two such texts the shingles in common are so many that, with the shingles of each in one order, rarest
    first, both have one in common near their beginnings; and what each has before the first that is in common bounds how
    many can be. So what is copied from one text and changed here and there meets only where few changes lie between.
    """
    sets = open_.join(held, "uid").select("uid", "component", "apart", F.size("s").alias("size"), F.explode("s").alias("h"))
    # A shingle that one text alone has is in no pair, but comes before those that are.
    often = stage(sets.groupBy("h").count().filter("count > 1").withColumnRenamed("count", "often"), "often")
    known = stage(sets.join(often, "h"), "known")
    whole = Window.partitionBy("uid")
    place = F.col("size") - F.count("*").over(whole) + F.row_number().over(whole.orderBy("often", "h")) - 1
    least = F.ceil(F.col("size") * similarity - 1e-9)  # a text of no more shingles than this in common with any other has no partner
    first = stage(known.select("uid", "component", "apart", "size", "h", place.alias("place")).filter(F.col("size") - F.col("place") >= least).drop("often"), "beginnings")
    x = first.filter("apart").select(*[F.col(c).alias(f"{c}_a") for c in ("uid", "component", "size", "place")], "h")
    y = first.select(*[F.col(c).alias(f"{c}_b") for c in ("uid", "component", "size", "place", "apart")], "h")
    possible = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= F.ceil((F.col("size_a") + F.col("size_b")) * (similarity / (1 + similarity)) - 1e-9)
    once = ~F.col("apart_b") | (F.col("uid_a") < F.col("uid_b"))
    both = x.join(y, "h").filter((F.col("component_a") != F.col("component_b")) & once & possible)
    return both.select(F.least("uid_a", "uid_b").alias("a"), F.greatest("uid_a", "uid_b").alias("b")).distinct()


def shingle_sets(docs: DataFrame, asked: DataFrame, words: int = SIMILAR_WORDS) -> DataFrame:
    """uid and s, all its shingles, for the rows asked for, already written. docs: (_k1, _k2, _text); asked: (uid, _k1, _k2), one a key, written.

    Texts are tested against a Bloom filter of the keys asked for first, so that only those and a few others move.
    """
    size = filter_size(asked.count())
    found = stage(filter_rows(asked.select(F.explode(F.array(*filter_positions(size, "_k1", "_k2"))).alias("p"))), "filter")
    some = with_maybe(docs, found, size, "_k1", "_k2").filter("_maybe").groupBy("_k1", "_k2").agg(F.first("_text").alias("_text"))
    lowered = some.join(asked, ["_k1", "_k2"]).select("uid", ascii_lower(F.col("_text")).alias("_text"))
    return stage(with_sketch(lowered, "_text", "s", words, 1.0).select("uid", "s"), "shingles")


def similar(held: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts have at least `similarity` of their shingles in common. held: `shingle_sets` of all of them."""
    both = pairs.join(held.select(F.col("uid").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("uid").alias("b"), F.col("s").alias("sb")), "b")
    return both.filter(likeness("sa", "sb") >= similarity).select("a", "b")


def deduplicate(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, miss: float = MISS) -> DataFrame:
    """The rows of `docs`, all their columns, with one row for each group of texts that are linked by similarity: that
    of the smallest doc_id (null last; of several, any one).

    Null, empty and white texts have no words and are one group; a text with fewer words than a shingle is one shingle.
    Of repeated rows one stays. No rows give no rows. Texts whose SimHash is within two bits, and texts that have a band
    in common, are compared on all their shingles: first each with the one that stands for those it meets, then whatever
    is not held together yet with all that it can be similar to.
    """
    ship(docs.sparkSession)
    bands = bands_for(similarity, miss)
    k1, k2 = row_key(docs)
    rows = docs.select("doc_id", k1.alias("_k1"), k2.alias("_k2"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for t in batch.column("text"):
                text = t.as_py()
                fps.append(fingerprint_of(text)), keys.append(band_keys(text, words, bands))
            made = [pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "fp", "keys"])
        give_back()

    schema = rows.drop("text").schema.add("fp", "long").add("keys", ArrayType(LongType()))
    prints = stage(rows.mapInArrow(hashed, schema).withColumn("uid", F.monotonically_increasing_id()), "prints")
    near, printed = simhash_pairs(prints)
    crowd, classes, repeats = crowded(prints)
    met = crowds(crowd)
    asked = stage(classes.select("uid", "_k1", "_k2").unionByName(printed).distinct(), "asked")
    held = shingle_sets(docs.select(k1.alias("_k1"), k2.alias("_k2"), text_of().alias("_text")), asked, words)
    pairs = stage(near.unionByName(first_pairs(met)).distinct(), "pairs")
    links = stage(similar(held, pairs, similarity).unionByName(repeats), "links")
    found = stage(components(links), "components")
    rest = stage(other_pairs(unsettled(met, found), held, similarity), "rest")
    if not rest.isEmpty():
        found = stage(components(links.unionByName(similar(held, rest, similarity))), "components")
    members = prints.join(found, prints.uid == found.node).select("component", "doc_id", "_k1", "_k2", "uid")
    best = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("best"))
    judged = members.join(stage(best, "best"), "component").groupBy("_k1", "_k2").agg(F.max((F.col("uid") == F.col("best.uid")).cast("int")).alias("_copies"))
    return carry(docs, stage(judged, "actions"))
