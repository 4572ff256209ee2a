import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyframe.llm import common, components, exact_dedup, mixing, queries, simhash

SF = "/root/testdata/sf0.001"
EDGES = [
    (5, "a b"), (3, "ab"), (3, "ab"), (9, "a\tb"), (None, "a  b  "), (1, None), (2, ""), (4, " \n\x0b\x0c\r\t"), (7, "\xa0ab"), (8, "AB"), (11, "x" * 200_000), (10, "x" * 200_000), (12, "nul\x00"),
]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        text = text or ""
        key = text.translate({c: None for c in (32, 9, 10, 11, 12, 13)})
        groups[hashlib.sha256(key.encode()).hexdigest()].append((-len(text), doc_id is None, doc_id, i))
    return groups


def test_exact_groups_against_brute_force(make_docs):
    got = exact_dedup.groups(exact_dedup.digests(make_docs(EDGES))).collect()
    want = brute_exact(EDGES)
    assert len(got) == len(EDGES)
    for sha, members in want.items():
        held = [r for r in got if r.text_sha256 == sha]
        assert {r.keep_id for r in held} == {min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]}
        assert {r.group_size for r in held} == {len(members)} == {len(held)}
        assert sum(r.kept for r in held) == 1


def test_exact_keeps_whole_rows(make_docs):
    docs = make_docs(EDGES)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(brute_exact(EDGES))
    assert {"a  b  "} == {r.text for r in kept.filter("replace(replace(text, ' ', ''), '\t', '') = 'ab'").collect()}
    assert exact_dedup.deduplicate(make_docs([])).collect() == []


def test_filter_lets_no_repeat_through(spark):
    """Two passes over a filter far too small: everything is tested positive, nothing is lost."""
    rows = [(i, f"t{i % 700}") for i in range(1000)]
    thin = exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    small = exact_dedup.repeat_filter(thin, 1 << 12)
    assert small.count() == 1
    tested = exact_dedup.possible_repeats(thin).filter("_maybe").count()
    assert 600 <= tested <= 700  # the 300 texts that occur twice, and few others


def sim(text, words=3):
    parts = [w for w in (text or "").encode().lower().split()]
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    distinct = sorted(set(fps.values()))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for doc_id, fp in fps.items():
        least[root(fp)] = min(least.get(root(fp), doc_id), doc_id)
    return {doc_id: least[root(fp)] for doc_id, fp in fps.items()}


def test_simhash_query_against_brute_force(spark):
    got = queries.op10_simhash(spark, SF).collect()
    fps = {r.doc_id: sim(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps and len(got) == len(fps)
    assert all(len(r.fingerprint) == 16 for r in got)
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)


def test_hash_is_the_one_that_spark_has(spark):
    from pyspark.sql import functions as F

    value = spark.range(1).select(F.xxhash64(F.lit("ä b c"))).first()[0]
    assert value % 2**64 == xxh64_intdigest("ä b c".encode(), 42)


def test_links_find_all_within_two_bits(spark):
    """Random fingerprints around a few centres, so that chains, cliques and pairs at every distance occur."""
    draw = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))))
    fps = {i: f for i, f in enumerate(sorted(fps))}
    prints = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "doc_id long, fp long")
    assert {r.doc_id: r.component_id for r in simhash.near_groups(prints).collect()} == brute_components(fps)


def test_simhash_edges(make_docs):
    texts = [(9, None), (4, ""), (6, "\t \n"), (8, "one"), (7, "ONE"), (3, "one two"), (2, "é É"), (1, "a b c d"), (1, "a b c d"), (None, "zz yy"), (5, "lorem ipsum " * 60_000)]
    got = simhash.near_groups(simhash.fingerprints(make_docs(texts))).collect()
    want = Counter((d, sim(t) - (1 << 64) if sim(t) >> 63 else sim(t)) for d, t in texts)
    assert Counter((r.doc_id, r.fp) for r in got) == want
    by = {(r.doc_id, r.component_id) for r in got}
    assert {(9, 4), (4, 4), (6, 4), (8, 7), (7, 7), (1, 1), (None, None)} <= by
    kept = simhash.deduplicate(make_docs(texts))
    assert kept.columns == make_docs([]).columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter([4, 7, 3, 2, 1, None, 5])
    assert simhash.deduplicate(make_docs([])).collect() == []


def test_similar_texts_are_found(spark, make_docs):
    """Copies with a few words changed are found, texts that share less stay, whatever lies in between them."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows, copies = [], 0
    for n in range(60):
        base = [word() for _ in range(200)]
        rows.append((10 * n, " ".join(base)))
        for i, changes in enumerate((1, 2, 4), 1):  # similarities of about 0.95, 0.9 and 0.82
            edited = list(base)
            for at in range(changes):
                edited[20 + 40 * at] = word()
            rows.append((10 * n + i, " ".join(edited).upper()))
            copies += 1
        rows.append((10 * n + 9, " ".join(base[:100] + [word() for _ in range(100)])))  # a third in common
    kept = {r.doc_id for r in simhash.deduplicate(make_docs(rows)).collect()}
    assert {d for d, _ in rows if d % 10 in (0, 9)} <= kept
    assert len(kept) - 120 <= 0.05 * copies


@pytest.mark.parametrize("seed", range(3))
def test_components_against_brute_force(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (2000, 2001), (2000, 2001)] + [(3000, 3000 + i) for i in range(200)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    loops = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent if n not in loops}


def test_no_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op4_mixing", "op9_warc"])
def test_query_matches_sql(spark, name):
    run, sql = queries.QUERIES[name]
    df = run(spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)


def test_recall_at_the_similarity_does_not_depend_on_the_number_of_texts():
    """Sets of shingles with exactly 0.8 in common meet in a band; keys depend on the text alone."""
    draw = random.Random(4)
    missed = 0
    for _ in range(300):
        shared, own = [[draw.getrandbits(60) for _ in range(n)] for n in (160, 40)]
        a, b = (" ".join(f"{x:x}" for x in shared + part) for part in (own[:20], own[20:]))
        missed += not (set(simhash.band_keys(a, 1).tolist()) & set(simhash.band_keys(b, 1).tolist()))
    assert missed <= 3
    assert (1 - 0.8**simhash.BAND_ROWS) ** simhash.bands_for() <= simhash.MISS


def test_true_pairs_in_a_crowd_of_merely_alike_texts(make_docs):
    """Texts share a passage (similarities of 0.55 to 0.7), so nearly all meet; each has one copy at 0.81 to 0.9 that must go."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    passage, rows = [word() for _ in range(150)], []
    for n in range(60):
        own = passage + [word() for _ in range(34)]
        other = list(own)
        for at in range(2 + n % 2):
            other[10 + 30 * at] = word()
        rows += [(2 * n, " ".join(own)), (2 * n + 1, " ".join(other))]
    kept = {r.doc_id for r in simhash.deduplicate(make_docs(rows)).collect()}
    assert kept == {d for d, _ in rows if d % 2 == 0}


def test_pairs_that_stars_leave_against_all_pairs(spark):
    """Copies of a few texts, changed in one to thirty places: of texts that nothing holds together yet, every pair that
    is similar is a candidate, and few others are."""
    draw = random.Random(12)
    sets = {}
    for _ in range(3):
        base = [draw.getrandbits(30) for _ in range(120)]
        for _ in range(40):
            own = list(base)
            for at in draw.sample(range(120), draw.randint(1, 30)):
                own[at] = draw.getrandbits(30)
            sets[len(sets)] = sorted(set(own[: draw.randint(90, 120)]))
    component = {u: draw.choice([u, 1000 + u % 3]) for u in sets}
    apart = {u: component[u] == u or draw.random() < 0.5 for u in sets}
    held = spark.createDataFrame([(u, s) for u, s in sets.items()], "uid long, s array<int>")
    open_ = spark.createDataFrame([(u, component[u], apart[u]) for u in sets], "uid long, component long, apart boolean")
    got = {(r.a, r.b) for r in simhash.other_pairs(open_, held).collect()}
    alike = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})
    possible = {(a, b) for a in sets for b in sets if a < b and component[a] != component[b] and (apart[a] or apart[b])}
    want = {(a, b) for a, b in possible if alike(a, b) >= 0.8}
    assert want and want <= got <= possible and len(got) < len(possible) / 4
    assert {(r.a, r.b) for r in simhash.similar(held, spark.createDataFrame(sorted(got), "a long, b long")).collect()} == want


def test_near_copies_of_one_text_without_pairs_of_all(spark, make_docs):
    """A crowd of copies: whatever is linked at 0.8 is one group, what is changed too much stays."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        own = list(base)
        for at in draw.sample(range(100), i % 12):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    kept = {r.doc_id for r in simhash.deduplicate(make_docs(rows)).collect()}
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(96)} for i, t in rows}
    least = {i: i for i, _ in rows}
    for _ in rows:
        for a in least:
            for b in least:
                if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                    least[a] = least[b] = min(least[a], least[b])
    assert kept == set(least.values())


@pytest.mark.parametrize("stage", [exact_dedup.deduplicate, simhash.deduplicate, mixing.mixture])
def test_maps_inside_columns(spark, stage):
    rows = [(1, "a b c d e f", "s", ({"k": 1},)), (1, "a b c d e f", "s", ({"k": 1},)), (2, "other text", None, (None,)), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra struct<m:map<string,int>>")
    kept = stage(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2}


def test_filter_holds_all_keys_and_few_others(spark):
    keys = spark.range(500).select(F.col("id").alias("k"))
    size = common.filter_size(500)
    found = common.filter_rows(keys.select(F.explode(F.array(*common.filter_positions(size, "k"))).alias("p")))
    tested = common.with_maybe(spark.range(5000).select(F.col("id").alias("k")), found, size, "k")
    held = [r.k for r in tested.filter("_maybe").collect()]
    assert {*range(500)} <= {*held} and len(held) < 560
    # A filter that is far too small lets everything through and loses nothing.
    full = common.filter_rows(keys.select(F.explode(F.array(*common.filter_positions(1 << 12, "k"))).alias("p")))
    assert {*range(500)} <= {r.k for r in common.with_maybe(keys, full, 1 << 12, "k").filter("_maybe").collect()}


def test_near_copies_that_only_simhash_meets(make_docs):
    """Copies whose SimHash is within two bits and that share no band are found, whatever bands there are."""
    draw = random.Random(21)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    one = simhash.bands_for(miss=0.9)
    assert one == 1
    rows = []
    while len(rows) < 20:
        base = [word() for _ in range(150)]
        other = list(base)
        other[draw.randrange(150)] = word()
        other[draw.randrange(150)] = word()
        a, b = " ".join(base), " ".join(other)
        if (sim(a) ^ sim(b)).bit_count() <= 2 and not {*simhash.band_keys(a, bands=one).tolist()} & {*simhash.band_keys(b, bands=one).tolist()}:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    kept = {r.doc_id for r in simhash.deduplicate(make_docs(rows), miss=0.9).collect()}
    assert kept == {d for d, _ in rows if d % 2 == 0}
