"""Text rules shared by entity matching, document reading and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clean_text

# A year of the last or this century that is not part of a longer number.
YEAR_PATTERN = r"(?:^|[^0-9])((?:19|20)[0-9][0-9])(?![0-9])"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# A word that begins like a month, short or in full.
MONTH_PATTERN = rf"(?i)(?:^|[^a-z0-9_])({'|'.join(MONTHS)})\p{{Alpha}}*"
# Marks such as (a), (bc) or (3) at the end of a label, one or several of a kind.
FOOTNOTE_MARKS = r"(?:\s*\([a-z][a-z]?\))+$|(?:\s*\([0-9]\))+$"


def slugify(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def cik10(value: Column) -> Column:
    digits = F.trim(value.cast("string"))
    return F.when(digits.rlike(r"^\d{1,10}$"), F.lpad(digits, 10, "0"))


def ticker_ok(value: Column) -> Column:
    return value.rlike(r"^[A-Z0-9][A-Z0-9.\-]{0,11}$")


def without_footnotes(text: Column) -> Column:
    return F.regexp_replace(text, FOOTNOTE_MARKS, "")


def normalize_label(text: Column) -> Column:
    """A label for comparing: plain dashes and quotes, no footnote marks, no closing colon, lower case."""
    plain = F.translate(clean_text(text), "’–—", "'--")
    bare = F.rtrim(without_footnotes(plain), F.lit(":"))
    return F.lower(F.trim(bare))


def stated_scale(text: Column) -> Column:
    """'(in millions)' -> 1000000; thousands are looked for first."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    scale = None
    for word, power in (("thousand", 3), ("million", 6), ("billion", 9)):
        hit = lowered.rlike(rf"\bin {word}s?\b")
        scale = F.when(hit, F.lit(10**power)) if scale is None else scale.when(hit, F.lit(10**power))
    return scale.cast("decimal(28,8)")


def last_year_in(text: Column) -> Column:
    years = F.regexp_extract_all(text, F.lit(YEAR_PATTERN), F.lit(1))
    return F.try_element_at(years, F.lit(-1)).cast("int")


def month_word(text: Column) -> Column:
    """Number of the first month named in a text, or null."""
    word = F.lower(F.regexp_extract(text, MONTH_PATTERN, 1))
    position = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), word)
    return F.when(position > 0, position.cast("int"))


def media_type(content: Column) -> Column:
    head = F.lower(F.ltrim(F.substring(content, 1, 4096)))
    wide = F.lower(F.substring(content, 1, 20000))
    return F.when(head.startswith("%pdf-"), "pdf").when(
        head.contains("<html") | head.startswith("<!doctype html") | (head.startswith("<?xml") & wide.contains("<html")),
        "html",
    )


def accession_from_url(url: Column) -> Column:
    """Archive folders carry the accession without dashes; restore them."""
    raw = F.regexp_extract(url, r"^https://www\.sec\.gov/Archives/edgar/data/\d{1,10}/(\d{18})/[\w.\-]+\.(?:htm|html|pdf)$", 1)
    return F.when(raw != "", F.concat_ws("-", F.substring(raw, 1, 10), F.substring(raw, 11, 2), F.substring(raw, 13, 6)))


def endpoint_of(url: Column) -> Column:
    """struct<endpoint, cik> for the two structured endpoints; null endpoint for anything else."""
    facts = F.regexp_extract(url, r"^https://data\.sec\.gov/api/xbrl/companyfacts/CIK(\d{10})\.json$", 1)
    profile = F.regexp_extract(url, r"^https://data\.sec\.gov/submissions/CIK(\d{10})\.json$", 1)
    endpoint = F.when(facts != "", "companyfacts").when(profile != "", "submissions")
    return F.struct(endpoint.alias("endpoint"), F.nullif(F.concat(facts, profile), F.lit("")).alias("cik"))
