"""Phrase collocations mined from an FM-index per shard, over word ids.

A shard holds the pieces of texts of one language, as ids of its own words with a separator between pieces, in two
Burrows-Wheeler transforms: of the sequence and of its reverse. An interval of the one stands for a phrase, the interval
of the other for the same phrase read backwards; both are kept together, so a phrase can be extended by a word on either
side, with all its extensions and their counts from one look at a stretch of a transform (`Shard.right`, `Shard.left`).
Transforms are sorted by as many words as the longest phrase has, which is as deep as phrases are looked for.

Frequent phrases are found level by level over all shards. A phrase can be frequent only where both phrases of one word
less are, so a shard extends those of its phrases that were frequent at the level before and sends its new phrases'
hashes and counts, as one row for each range of hashes; ranges are summed, and each shard is told which of its own are
left. On the way some 32 bits within a range tell phrases apart, which may let one more pass and never loses one. At the
longest level all that are left are counted by two independent hashes, 64 bits within a range that the other one gives;
then one shard that has it spells each phrase.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ship, stage, text_of
from .files import new_folder, opened, write_files

MINIMUM = 30
LONGEST = 4
ABSORBED = (80, 100)  # a phrase is dropped where a longer one has at least this part of its occurrences
UNKNOWN = "und"
SHARD_WORDS = 4 << 20
RANGE_WORDS = 1 << 20  # a range of hashes gets phrases of about so many words of text

# Bytes of a text in UTF-8: A-Z in lower case, a tab as a blank, what ends a piece as a byte that UTF-8 never has.
_END = 0xFF
_AS_WORD = bytes(_END if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier, from the golden ratio
_MIX_RANGE = np.uint64(0xD6E8FEB86659FD93)  # another, fixed
_LOW = np.uint64(0xFFFFFFFF)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, in order, with b"\\xff" wherever a piece ends."""
    return text.translate(_AS_WORD).replace(b"\xff", b" \xff ").split()


def _transform(codes: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each position of a cyclic sequence, positions sorted by the `depth` symbols from there on."""
    rank, known = codes.astype(np.int64), 1
    while known < depth:
        step = min(known, depth - known)
        key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -step)
        known += step
        if known < depth:
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        else:
            rank = key
    return codes[np.argsort(rank) - 1]  # in any order among equals


@dataclass
class Phrases:
    """Phrases of one length: their words, and their intervals in the transform (start) and in that of the reverse (back)."""

    words: np.ndarray  # a row of codes each
    start: np.ndarray
    back: np.ndarray
    count: np.ndarray

    def only(self, which: np.ndarray) -> Phrases:
        return Phrases(self.words[which], self.start[which], self.back[which], self.count[which])


class _Side:
    """One transform: the symbols of stretches, and where a stretch goes when a symbol is put in front."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols

    @cached_property
    def keys(self) -> np.ndarray:
        """Symbol by symbol the places where it is, as symbol * length + place."""
        return np.sort(self.symbols.astype(np.int64) * len(self.symbols) + np.arange(len(self.symbols)))

    def extensions(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """For all stretches at once: which stretch, symbol, how often, how many lesser symbols are in the stretch, and the new start."""
        width = int(self.symbols.max(initial=0)) + 1
        of = np.repeat(np.arange(len(start)), count)
        places = np.arange(len(of)) + np.repeat(start - np.cumsum(count) + count, count)
        keys, times = np.unique(of * width + self.symbols[places], return_counts=True)
        of, symbol = keys // width, keys % width
        upto = np.cumsum(times)
        lesser = upto - times - (np.cumsum(count) - count)[of]
        return of, symbol, times, lesser, np.searchsorted(self.keys, symbol * len(self.symbols) + start[of])


class Shard:
    """A bidirectional FM-index of a sequence of codes; 0 is the separator, words[i] is the word of code i + 1."""

    def __init__(self, words: list[bytes], forward: np.ndarray, backward: np.ndarray, seed: int):
        from xxhash import xxh64_intdigest

        self.words, self.forward, self.backward = words, _Side(forward), _Side(backward)
        self.hashes = np.array([0, *(xxh64_intdigest(w, seed) for w in words)], np.uint64)

    def single(self) -> Phrases:
        count = np.bincount(self.forward.symbols, minlength=len(self.words) + 1)
        start = np.cumsum(count) - count
        return Phrases(np.arange(1, len(count))[:, None], start[1:], start[1:], count[1:])

    def right(self, phrases: Phrases) -> Phrases:
        """Every phrase followed by every word that follows it, with counts."""
        of, symbol, count, lesser, back = self.backward.extensions(phrases.back, phrases.count)
        found = Phrases(np.concatenate([phrases.words[of], symbol[:, None]], axis=1), phrases.start[of] + lesser, back, count)
        return found.only(symbol > 0)

    def left(self, phrases: Phrases) -> Phrases:
        """Every phrase after every word that comes before it, with counts."""
        of, symbol, count, lesser, start = self.forward.extensions(phrases.start, phrases.count)
        found = Phrases(np.concatenate([symbol[:, None], phrases.words[of]], axis=1), start, phrases.back[of] + lesser, count)
        return found.only(symbol > 0)

    def hashed(self, words: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase a range of hashes and 64 bits, by hashes that do not depend on each other."""
        h, g = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        for column in words.T:
            x = self.hashes[column]
            h = (h ^ x) * _MIX
            h ^= h >> np.uint64(29)
            g = (g + (x ^ (x >> np.uint64(31)))) * _MIX_RANGE
            g ^= g >> np.uint64(32)
        return g % np.uint64(ranges), h

    def numbers(self, words: np.ndarray, ranges: int) -> np.ndarray:
        """A number for each phrase: its range, then 32 bits."""
        of, h = self.hashed(words, ranges)
        return of << np.uint64(32) | (h & _LOW)

    def level(self, frequent: dict[int, Known], level: int, ranges: int) -> Iterator[Phrases]:
        """For each size up to `level` the phrases whose parts of one word less are all frequent, of sizes below it only
        the frequent ones. Phrases are extended on either side by turns."""
        found = self.single()
        for n in range(2, level + 1):
            found = found.only(frequent[n - 1].holds(self.numbers(found.words, ranges)))
            yield found
            found = self.right(found) if n % 2 == 0 else self.left(found)
            found = found.only(frequent[n - 1].holds(self.numbers(found.words[:, 1:] if n % 2 == 0 else found.words[:, :-1], ranges)))
        yield found


class Known:
    """A set of numbers, with a table of bits that most others fail at."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = np.unique(numbers)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self._at(self.numbers)] = True

    @staticmethod
    def _at(numbers: np.ndarray) -> np.ndarray:
        return (numbers ^ numbers >> np.uint64(22)) & np.uint64((1 << 22) - 1)

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        held = self.seen[self._at(numbers)]
        if len(self.numbers):
            some = numbers[held]
            held[held] = self.numbers[np.minimum(np.searchsorted(self.numbers, some), len(self.numbers) - 1)] == some
        return held


def _packed(codes: list[np.ndarray], words: list[bytes], depth: int) -> bytes:
    """Words and both transforms of a shard, each compressed, after their sizes before and after."""
    flat = np.concatenate([np.zeros(1, np.int32), *codes])
    # Separators side by side, of empty pieces, are one.
    flat = flat[np.concatenate([[True], (flat[1:] != 0) | (flat[:-1] != 0)])]
    parts = [b" ".join(words), _transform(flat, depth).tobytes(), _transform(flat[::-1].copy(), depth).tobytes()]
    held = [pa.compress(p, codec="zstd", asbytes=True) for p in parts]
    return np.array([[len(p), len(h)] for p, h in zip(parts, held)], "<i8").tobytes() + b"".join(held)


def unpacked(packed: bytes, lang: str) -> Shard:
    from xxhash import xxh64_intdigest

    sizes, at, parts = np.frombuffer(packed[:48], "<i8").reshape(3, 2), 48, []
    for whole, held in sizes:
        parts.append(pa.decompress(packed[at : at + held], int(whole), codec="zstd", asbytes=True))
        at += held
    return Shard(parts[0].split(b" "), np.frombuffer(parts[1], np.int32), np.frombuffer(parts[2], np.int32), xxh64_intdigest(lang.encode()))


def shards(docs: DataFrame, folder: str, depth: int = LONGEST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Writes the shards of `docs` (lang, text; null: `und`, empty) to files in `folder`. Returns shard, lang, words, path, position, bytes.

    A task fills one shard a language at a time, each with at most about `shard_words` words or one longer text.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, defaultdict]] = {}
        sizes: dict[str, int] = defaultdict(int)

        def done(lang: str) -> pa.RecordBatch:
            codes, known = held.pop(lang)
            del known[b"\xff"]
            return pa.RecordBatch.from_pydict({"lang": [lang], "words": [sizes.pop(lang)], "index": pa.array([_packed(codes, list(known), depth)], pa.large_binary())})

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                found = words_of(text.as_py())
                codes, known = held.get(lang) or held.setdefault(lang, ([], defaultdict()))
                if not known:
                    known.default_factory = known.__len__
                    known[b"\xff"]
                ids = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
                codes += [ids, np.zeros(1, np.int32)]
                sizes[lang] += int(np.count_nonzero(ids))
                if sizes[lang] >= shard_words:
                    yield done(lang)
        for lang in [*held]:
            if sizes[lang]:
                yield done(lang)

    def encode(batch: pa.RecordBatch) -> Iterator[tuple[bytes, dict]]:
        for lang, words, index in zip(*(batch.column(c) for c in ("lang", "words", "index"))):
            packed = index.as_py()
            yield packed, {"lang": lang.as_py(), "words": words.as_py(), "bytes": len(packed)}

    ship(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), text_of().alias("text"))
    built = texts.mapInArrow(build, "lang string, words long, index binary")
    written = write_files(built, folder, ".fm", encode, StructType().add("lang", "string").add("words", "long").add("bytes", "long"))
    return stage(written.withColumn("shard", F.monotonically_increasing_id()), "shards")


def _opened(manifest: pa.Table) -> Shard:
    row = manifest.to_pylist()[0]
    system, own = opened(row["path"])
    with system.open_input_file(own) as f:
        f.seek(row["position"])
        return unpacked(f.read(row["bytes"]), row["lang"])


def _sets(told: pa.Table, upto: int) -> dict[int, Known]:
    """The phrase numbers of each level that a shard was told are frequent."""
    out = {n: [np.zeros(0, np.uint64)] for n in range(1, upto + 1)}
    for n, number, low in zip(told.column("level").to_pylist(), told.column("range").to_pylist(), told.column("low")):
        out[n].append(np.uint64(number << 32) | low.values.to_numpy().view(np.uint32).astype(np.uint64))
    return {n: Known(np.concatenate(x)) for n, x in out.items()}


def _by_range(shard: int, of: np.ndarray, hashes: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Table:
    """One row for each range of hashes with the hashes and counts of a shard's phrases."""
    order = np.lexsort((hashes, of))
    held, first = np.unique(of[order], return_index=True)
    ends = pa.array([*first, len(order)], pa.int32())
    low, count = (pa.ListArray.from_arrays(ends, pa.array(x[order], t)) for x, t in ((hashes, kind), (counts, pa.int32())))
    return pa.table([pa.array(np.full(len(held), shard, np.int64)), pa.array(held.astype(np.int32)), low, count], names=["shard", "range", "low", "count"])


def _sums(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all phrases in the rows of one range: the row that each is in, its hash, and its count over all rows."""
    low, count = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("low", "count"))
    of = np.repeat(np.arange(len(rows)), rows.column("low").combine_chunks().value_lengths().to_numpy())
    order = np.argsort(low, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], low[order][1:] != low[order][:-1]])) if len(low) else np.zeros(0, np.int64)
    total = np.zeros(len(low), np.int64)
    total[order] = np.repeat(np.add.reduceat(count[order].astype(np.int64), starts), np.diff(np.append(starts, len(low)))) if len(low) else 0
    return of, low, total


def frequent_phrases(manifest: DataFrame, minimum: int = MINIMUM, longest: int = LONGEST) -> DataFrame:
    """lang, phrase (words with blanks between), size (in words) and f of every phrase of up to `longest` words in the
    `shards` that occurs at least `minimum` times in its language, already written."""
    spark = manifest.sparkSession
    ranges = max(1, (manifest.agg(F.sum("words")).first()[0] or 0) // RANGE_WORDS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept_schema = "shard long, level int, range int, low array<int>"
    kept = spark.createDataFrame([], kept_schema)
    ship(spark)

    def asked(of_shard, told: DataFrame, schema: str) -> DataFrame:
        """A shard is work for some seconds, however few bytes its row has, so tasks are not put together."""
        return manifest.repartition(parts, "shard").groupBy("shard").cogroup(told.repartition(parts, "shard").groupBy("shard")).applyInArrow(lambda m, t: of_shard(m, t), schema)

    def candidates(level: int):
        def of_shard(manifest: pa.Table, told: pa.Table) -> pa.Table:
            shard = _opened(manifest)
            *_, found = shard.level(_sets(told, level - 1), level, ranges)
            of, h = shard.hashed(found.words, ranges)
            return _by_range(manifest.column("shard")[0].as_py(), of, (h & _LOW).astype(np.uint32).view(np.int32), found.count, pa.int32())

        return of_shard

    def summed(level: int):
        def of_range(rows: pa.Table) -> pa.Table:
            of, low, total = _sums(rows)
            enough = total >= minimum
            ends = np.searchsorted(of[enough], np.arange(len(rows) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(low[enough]))
            told = pa.table([rows.column("shard"), pa.array(np.full(len(rows), level, np.int32)), rows.column("range"), lists], names=["shard", "level", "range", "low"])
            return told.filter(pa.array(np.diff(ends) > 0))

        return of_range

    def counted(manifest: pa.Table, told: pa.Table) -> pa.Table:
        """The phrases of all sizes by two hashes; of the longest all whose parts are frequent."""
        shard = _opened(manifest)
        found = [(*shard.hashed(f.words, ranges), f.count) for f in shard.level(_sets(told, longest - 1), longest, ranges)]
        of, h, count = (np.concatenate(x) for x in zip(*found))
        return _by_range(manifest.column("shard")[0].as_py(), of, h.view(np.int64), count, pa.int64())

    def shared_out(rows: pa.Table) -> pa.Table:
        """Tells the first shard that has a frequent phrase to spell it, with its count over all shards."""
        of, low, total = _sums(rows)
        some = np.flatnonzero(total >= minimum)
        some = some[np.unique(low[some], return_index=True)[1]]
        some = some[np.argsort(of[some], kind="stable")]
        ends = np.searchsorted(of[some], np.arange(len(rows) + 1))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (low[some], total[some])]
        return pa.table([rows.column("shard"), rows.column("range"), *lists], names=["shard", "range", "hash", "f"]).filter(pa.array(np.diff(ends) > 0))

    def spelled(manifest: pa.Table, told: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(told):
            shard = _opened(manifest)
            wanted = told.filter(pc.is_valid(told.column("hash"))).combine_chunks()
            hashes, f = (wanted.column(c).combine_chunks().flatten().to_numpy() for c in ("hash", "f"))
            order = np.argsort(hashes)
            hashes, f = hashes[order], f[order]
            sets = _sets(told.filter(pc.is_valid(told.column("level"))), longest - 1)
            for n, found in enumerate(shard.level(sets, longest, ranges), 1) if len(hashes) else ():
                own = shard.hashed(found.words, ranges)[1].view(np.int64)
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                mine = np.flatnonzero(hashes[at] == own)
                words = found.words[mine].tolist()
                out[0].extend([b" ".join([shard.words[c - 1] for c in row]) for row in words])
                out[1].extend([n] * len(words))
                out[2].extend(f[at[mine]].tolist())
        lang = manifest.column("lang")[0].as_py() if len(manifest) else None
        return pa.table([pa.array([lang] * len(out[0]), pa.string()), pa.array(out[0], pa.binary()).cast(pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], names=["lang", "phrase", "size", "f"])

    for level in range(1, longest):
        sent = asked(candidates(level), kept, "shard long, range int, low array<int>, count array<int>")
        kept = kept.unionByName(stage(sent.groupBy("range").applyInArrow(summed(level), kept_schema), "frequent"))
    exact = asked(counted, kept, "shard long, range int, low array<long>, count array<int>")
    told = stage(exact.groupBy("range").applyInArrow(shared_out, "shard long, range int, hash array<long>, f array<long>"), "told")
    return stage(asked(spelled, kept.unionByName(told, allowMissingColumns=True), "lang string, phrase string, size int, f long"), "phrases")


def scored(phrases: DataFrame, absorbed: tuple[int, int] = ABSORBED) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more that no longer one absorbs.

    phrases: (lang, phrase, size, f), with every part of a phrase. A phrase is cut where its score, 2,000,000 a / (l + r)
    rounded down, is least; of equal scores at the first place.
    """
    # A phrase inside a longer one with enough occurrences is inside one that is a word longer and has at least as many.
    longer = phrases.filter("size > 2").withColumn("words", F.split("phrase", " "))
    parts = longer.select("lang", "f", F.explode(F.array(F.array_join(F.slice("words", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("words", F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
    held = stage(parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer")), "longer")
    some = phrases.filter("size > 1").join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * absorbed[1] < F.col("f") * absorbed[0]))
    cuts = some.withColumn("words", F.split("phrase", " ")).select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    # Written, so that the joins have plain inputs and a word that very many phrases begin or end with can be split.
    cuts = stage(cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest")), "cuts")
    of = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    lefts = stage(cuts.join(of, ["lang", "first"]), "lefts")
    both = lefts.join(of.select("lang", F.col("first").alias("rest"), F.col("l").alias("r")), ["lang", "rest"])
    score = F.expr("cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    least = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, most: int = 2000, minimum: int = MINIMUM, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `most` best phrases of each language of `docs` (lang, text).

    Null texts are empty, a null language is `und`. Repeated rows count as often as they are there. Languages without a
    phrase that is frequent enough, and no documents, give no rows.
    """
    manifest = shards(docs, new_folder(docs.sparkSession, "shards"), longest)
    best = scored(frequent_phrases(manifest, minimum, longest))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return ranked.join(manifest.groupBy("lang").agg(F.sum("words").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
