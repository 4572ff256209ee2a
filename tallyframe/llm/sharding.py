"""Sharding by balanced label propagation, with built-in functions only.

Documents with the same text are linked. All start in a shard by a hash of their row; then, round by round, linked
documents move to the shard that holds most of their neighbours, as far as that shard has room for linked documents:
an even share of all bytes. Links are held as counts per text and shard, never as pairs, so a text with very many
copies is as cheap as any; what exceeds the room of its best shard goes on to its next best ones. Every move leaves more
neighbours together, so the rounds end by themselves, when nothing can move. Documents without links then even the
shards out: the large ones one by one into the emptiest shard, the others in two passes by size into the gaps that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, stage, text_of

SHARDS = 40
OVERHEAD = 16
# A free document above an even share / LARGE is placed on its own: fewer than SHARDS * LARGE of them exist.
LARGE = 64
FINE = 4096


def nodes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, group (texts that are equal; null and empty are), shard to start in and uid per row."""
    text = text_of()
    thin = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("group"))
    thin = thin.withColumn("uid", F.monotonically_increasing_id())
    return stage(thin.withColumn("shard", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(shards)).cast("int")), "nodes")


def _round(cells: DataFrame, share: float) -> DataFrame:
    """cells (group, unit, shard, n) with move: how many documents come into a cell (above 0) or leave it (below).

    A group would fill its shards in order of how much of it they can hold, then of how much they do, each up to its
    room. Wishes for one shard are granted in order of what the shard holds of the group, as far as its room goes; what is
    granted comes from the last shards in the group's order. A group that would not gain by it stays as it is.
    """
    # One row a shard.
    room = cells.groupBy("shard").agg((F.lit(float(share)) - F.sum(F.col("n") * F.col("unit"))).alias("room"))
    whole = Window.partitionBy("group")
    ranked = whole.orderBy(F.col("most").desc(), F.col("n").desc(), "shard")
    upto = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.col("n") + F.floor(F.greatest("room", F.lit(0.0)) / F.col("unit"))
    held = cells.join(F.broadcast(room), "shard").withColumn("fits", fits).withColumn("most", F.least("fits", F.sum("n").over(whole)))
    held = held.withColumn("before", F.sum("fits").over(upto) - F.col("fits"))
    held = held.withColumn("want", F.greatest(F.least(F.sum("n").over(whole) - F.col("before"), F.col("fits")) - F.col("n"), F.lit(0)).cast("long"))
    held = stage(held.drop("fits", "before"), "wishes")
    queued = running(held.filter("want > 0").select("group", "unit", "shard", "n", "want", "room"), [-F.col("n"), F.col("group")], {"upto": F.col("want") * F.col("unit")}, ("shard",))
    left = F.floor((F.col("room") - (F.col("upto") - F.col("want") * F.col("unit"))) / F.col("unit"))
    granted = stage(queued.select("group", "shard", F.greatest(F.least(left, F.col("want")), F.lit(0)).cast("long").alias("granted")).filter("granted > 0"), "granted")
    both = held.join(granted, ["group", "shard"], "left").withColumn("granted", F.coalesce("granted", F.lit(0)))
    # From the last cell on, as many leave as come in elsewhere.
    later = F.sum("n").over(whole) - F.sum("n").over(upto)
    leave = F.greatest(F.least(F.sum("granted").over(whole) - later, F.col("n")), F.lit(0))
    moved = both.select("group", "unit", "shard", "n", (F.col("granted") - leave).cast("long").alias("move"))
    square = lambda x: F.sum(x.cast("double") * x).over(whole)
    return moved.withColumn("move", F.when(square(F.col("n") + F.col("move")) > square(F.col("n")), F.col("move")).otherwise(F.lit(0).cast("long")))


def propagate(cells: DataFrame, share: float) -> DataFrame:
    """cells (group, unit: bytes of each of its documents, shard, n: how many are there) after all moves.

    No shard takes in more than brings its cells to `share` bytes. A group moves only where its sum of squares of n
    (the links that are not cut) grows, so there is a last round.
    """
    while True:
        moved = stage(_round(cells, share), "moved")
        cells = moved.filter("n + move > 0").select("group", "unit", "shard", (F.col("n") + F.col("move")).alias("n"))
        if moved.filter("move > 0").isEmpty():
            return cells


def _placed(linked: DataFrame, cells: DataFrame) -> DataFrame:
    """linked (group, uid, ...) with shard: documents of a group, in order of uid, fill its cells."""
    at = stage(running(linked.drop("shard"), [F.col("uid")], {"_at": F.lit(1)}, ("group",)), "numbered")
    ends = F.transform(F.col("_cells"), lambda c, i: F.struct(c["shard"].alias("shard"), F.aggregate(F.slice("_cells", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("end")))
    # At most one entry a shard.
    of = stage(cells.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("_cells")).select("group", ends.alias("_ends")), "ends")
    return at.join(of, "group").withColumn("shard", F.filter("_ends", lambda e: e["end"] >= F.col("_at"))[0]["shard"]).drop("_at", "_ends")


def _loads(*frames: DataFrame, shards: int) -> DataFrame:
    """shard, load for every shard, over the frames together."""
    out = frames[0].sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("size"))
    for f in frames:
        out = out.unionByName(f.groupBy("shard").agg(F.sum("size").alias("size")).select("shard", "size"))
    return out.groupBy("shard").agg(F.sum("size").alias("load"))


def _one_by_one(large: DataFrame, loads: DataFrame) -> DataFrame:
    """Large rows, largest first, each into the shard with the least load so far. Fewer than shards * LARGE rows meet in one fold."""
    items = large.agg(F.sort_array(F.collect_list(F.struct("size", "uid")), asc=False).alias("items"))
    start = loads.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "load"))), lambda x: x.load).alias("loads"))

    def place(state: Column, item: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        grown = F.transform(state["loads"], lambda x, i: F.when(i == at - 1, x + item["size"]).otherwise(x))
        return F.struct(grown.alias("loads"), F.concat(state["to"], F.array(at - 1)).alias("to"))

    begin = F.struct(F.col("loads"), F.array().cast("array<int>").alias("to"))
    folded = items.join(F.broadcast(start)).select("items", F.aggregate("items", begin, place, lambda s: s["to"]).alias("to"))
    return folded.select(F.explode(F.arrays_zip("items", "to")).alias("x")).select("x.items.uid", F.col("x.to").alias("shard"))


def _into_gaps(free: DataFrame, loads: DataFrame, share: float, shards: int) -> DataFrame:
    """free rows with shard: in order of size their bytes are cut into stretches in proportion to the gaps below `share`; a row goes where its middle lies."""
    gaps = loads.select("shard", F.greatest(F.lit(float(share)) - F.col("load"), F.lit(0.0)).alias("gap"))
    shard_gaps = gaps.agg(F.array_sort(F.collect_list(F.struct("shard", "gap"))).alias("g"))
    # cumulated gaps, one number a shard
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("g", 1, i), F.lit(0.0), lambda a, x: a + x["gap"]))
    total = free.agg(F.sum("size")).first()[0]
    if not total:
        return free.withColumn("shard", F.lit(0))
    cut = shard_gaps.select(ends.alias("ends")).first()["ends"]
    scale = cut[-1] / total if cut[-1] else 0
    marks = [e / scale if scale else total * (i + 1) / shards for i, e in enumerate(cut)][:-1]
    placed = running(free, [F.col("size").desc(), F.xxhash64("uid"), F.col("uid")], {"_cum": F.col("size")})
    middle = F.col("_cum") - F.col("size") / 2
    return placed.withColumn("shard", F.size(F.filter(F.lit([float(m) for m in marks]), lambda m: m <= middle))).drop("_cum")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and OVERHEAD), text_crc32, shard and slot (its number in the shard, from 0).

    Shards have nearly equal bytes. Null texts are empty ones and equal to them. Repeated rows are documents that are
    linked. A text whose copies are more than a shard's even share lies in as few shards as hold it. No rows give no rows.
    """
    thin = nodes(docs, shards)
    # Written, so that the join has two plain inputs and a text with very many copies can be split.
    copies = stage(thin.groupBy("group").count().filter("count > 1").select("group", F.lit(True).alias("_linked")), "copies")
    marked = stage(thin.join(copies, "group", "left"), "marked")
    linked, free = marked.filter("_linked").drop("_linked"), marked.filter("_linked is null").drop("_linked", "shard")
    total = thin.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    cells = stage(linked.groupBy("group", F.col("size").alias("unit"), "shard").agg(F.count("*").alias("n")), "cells")
    linked = stage(_placed(linked, propagate(cells, share)), "linked")
    large = free.filter(F.col("size") > share / LARGE)
    placed = stage(large.join(F.broadcast(_one_by_one(large, _loads(linked, shards=shards))), "uid"), "large")
    done = [linked, placed]
    for most, least in ((share / LARGE, share / FINE), (share / FINE, -1.0)):
        some = free.filter((F.col("size") <= most) & (F.col("size") > least))
        rest = (free.filter(F.col("size") <= least).agg(F.sum("size")).first()[0] or 0) / shards
        done.append(stage(_into_gaps(some, _loads(*done, shards=shards), share - rest, shards), "gaps"))
    columns = ["doc_id", "size", "text_crc32", "shard", "uid"]
    whole = done[0].select(columns)
    for d in done[1:]:
        whole = whole.unionByName(d.select(columns))
    numbered = running(whole, [F.col("doc_id"), F.col("uid")], {"slot": F.lit(1)}, ("shard",))
    return numbered.withColumn("slot", (F.col("slot") - 1).cast("long")).drop("uid")
