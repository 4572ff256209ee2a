"""One registered query per operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, files, fingerprints, language, mixing, packing, quality, ranked_search, sharding, simhash, token_files, url_filter, warc
from .common import table

SPACE = "[\\x20\\x09-\\x0D]"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


END_OF_DOCUMENT = 49407  # <|endoftext|> of the vocabulary


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, written to flat files and found again in them: doc_id, path, ordinal, start, tokens."""
    written = token_files.write(table(spark, sf_dir, "documents", "doc_id", "text"), files.new_folder(spark, "tokens"), vocabulary(), END_OF_DOCUMENT)
    found = token_files.counts(written.select("path"), END_OF_DOCUMENT)
    return found.join(written, ["path", "ordinal"]).select("doc_id", F.element_at(F.split("path", "/"), -1).alias("file"), "ordinal", "start", "tokens")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table in pieces, packed: null and empty texts are the end-of-document id alone, longer ones than a
    sequence are cut, repeated rows are packed each, a table without rows packs nothing."""
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document: null and empty texts are one group, repeated rows are copies of each other, ties stay by doc_id."""
    judged = exact_dedup.groups(exact_dedup.digests(table(spark, sf_dir, "documents", "doc_id", "text")))
    return judged.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document: null texts have no words, null is a source of its own, repeated rows count each."""
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS position FROM d GROUP BY source),
c AS (SELECT *, ((position - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, coalesce(sum(weight) OVER before, 0) AS weights, sum(source_size) OVER ()::DOUBLE AS budget, sum(weight) OVER () AS weight_all
      FROM c WINDOW before AS (ORDER BY cap / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, position, budget, least(cap, max((budget - caps) / (weight_all - weights)) OVER () * weight) AS target FROM f),
p AS (SELECT d.*, source_size, position, budget, target, sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT doc_id, size, budget, position, round, (round * source_size + cum)::DOUBLE / target AS finish
      FROM p, LATERAL (SELECT unnest(range(least(3, floor(target / source_size)::BIGINT + 1))) AS round) WHERE size > 0 AND target > 0),
r AS (SELECT doc_id, size, budget, sum(size) OVER (ORDER BY finish, position, round, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM q),
n AS (SELECT doc_id, sum(size) AS taken FROM r WHERE total <= budget GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(n.taken, 0)::BIGINT AS taken FROM p LEFT JOIN n USING (doc_id)
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document: null and empty texts are equal texts of 16 bytes, repeated rows are copies of each other."""
    placed = sharding.shard(table(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every page: a null url, or one without `://`, has an empty host and path and is allowed; a null html has no links."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document: null and empty texts have empty fingerprints, equal to each other; repeated rows follow each other."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    near = fingerprints.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text")).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next.text", half))
    near = near.select("doc_id", "n_chars", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    near = fingerprints.with_sketch(near, "edited", "edited_sketch")
    return near.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprints.written("sketch").alias("fingerprint"), fingerprints.written("edited_sketch").alias("edited_fingerprint"),
        fingerprints.likeness("sketch", "edited_sketch").alias("near_edited"), fingerprints.likeness("sketch", "next_sketch").alias("near_next"), fingerprints.containment("sketch", "edited_sketch").alias("held_by_edited"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document: null texts and those without a letter are `und` with score 0, as all are without labels."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    scored = language.predict(docs.select("doc_id", "text"), language.train(docs))
    return scored.select("doc_id", language.held_out().alias("held_out"), F.col("_language.lang_pred"), F.col("_language.score"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every page: a null html is an empty payload, and small payloads are never revisits; repeated rows of a page refer to it."""
    written = warc.write(warc.planned(table(spark, sf_dir, "pages", "page_id", "url", "html")), files.new_folder(spark, "warc"))
    records = warc.read(written.select("path"), with_payload=False)
    return records.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document: texts without words have fingerprint zero and are linked like others; repeated rows share a group."""
    grouped = simhash.near_groups(simhash.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text")))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item; items without a term that a document has get no rows, null texts have no terms."""
    found = ranked_search.index(table(spark, sf_dir, "documents", "doc_id", "text"))
    return ranked_search.search(found, table(spark, sf_dir, "benchmark", "item_id", "text"), 20)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT item_id, row_number() OVER () AS query, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
s AS (SELECT count(*)::BIGINT AS number, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
m AS (SELECT d.row, doc_id, (75 + (25 * len(terms) * number) // length)::BIGINT AS m FROM d, s WHERE len(terms) > 0),
p AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
q AS (SELECT query, term, count(*)::BIGINT AS times FROM (SELECT query, unnest(terms) AS term FROM i) GROUP BY query, term),
w AS (SELECT term, floor(1000 * ln((2 * number + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), s),
a AS (SELECT query, row, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (row) GROUP BY query, row),
r AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS rank FROM a JOIN m USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (query) WHERE rank <= 20
"""


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document; null texts are empty, and without labels all scores are 0.5."""
    return quality.quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language; null texts are empty, a null language is `und`, repeated rows count each."""
    return collocations.collocations(table(spark, sf_dir, "documents", "lang", "text"), 2000)


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, words[i : i + m - 1] AS g, m FROM w, LATERAL (SELECT unnest([1, 2, 3, 4]) AS m) a, LATERAL (SELECT unnest(range(1, len(words) - m + 2)) AS i) b),
f AS (SELECT lang, g, m, array_to_string(g, ' ') AS phrase, count(*)::BIGINT AS f FROM g GROUP BY lang, g, m),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, g, m, phrase, f AS a FROM f WHERE m > 1 AND f >= 30),
i AS (SELECT lang, array_to_string(g[s : s + z - 1], ' ') AS phrase, max(a) AS longer FROM c, LATERAL (SELECT unnest(range(2, m)) AS z) x, LATERAL (SELECT unnest(range(1, m - z + 2)) AS s) y GROUP BY ALL),
k AS (SELECT c.lang, c.phrase, a, k, array_to_string(g[1 : k], ' ') AS first, array_to_string(g[k + 1 : m], ' ') AS rest
      FROM c LEFT JOIN i ON c.lang = i.lang AND c.phrase = i.phrase, LATERAL (SELECT unnest(range(1, m)) AS k) x WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
s AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
      FROM k JOIN f l ON k.lang = l.lang AND k.first = l.phrase JOIN f r ON k.lang = r.lang AND k.rest = r.phrase),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_best_fit_packing": (op2_best_fit_packing, None),
    "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
    "op4_mixing": (op4_mixing, OP4_SQL),
    "op5_sharding": (op5_sharding, None),
    "op6_url_filter": (op6_url_filter, None),
    "op7_fingerprints": (op7_fingerprints, None),
    "op8_language_id": (op8_language_id, None),
    "op9_warc": (op9_warc, OP9_SQL),
    "op10_simhash": (op10_simhash, None),
    "op11_ranked_search": (op11_ranked_search, OP11_SQL),
    "op12_quality": (op12_quality, None),
    "op13_collocations": (op13_collocations, OP13_SQL),
}
