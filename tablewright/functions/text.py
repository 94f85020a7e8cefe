"""Text functions as native Column expressions: one named normaliser for each matching rule, tokens, phrases, headings."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

QUOTES = ("“”’", "\"\"'")
DASHES = ("–—", "--")
EDGE_MARKS = r".,!?;:()\[\]{}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of any script at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(col(c), r"(?U)\s+", " ")


def fold_quotes(c: Column | str) -> Column:
    return F.translate(col(c), *QUOTES)


def null_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def norm_enriched(c: Column | str) -> Column:
    """Upper case, collapsed; blank becomes null."""
    return null_if_blank(F.upper(collapse(strip(c))))


def norm_structured(c: Column | str) -> Column:
    """Upper case with plain quotes, collapsed; null becomes empty."""
    return strip(collapse(fold_quotes(F.upper(strip(F.coalesce(col(c), F.lit("")))))))


def norm_search(c: Column | str) -> Column:
    """Lower case; all but letters, digits and quotes, dots, slashes, plus and minus becomes a blank."""
    low = fold_quotes(F.lower(F.coalesce(col(c), F.lit(""))))
    return F.trim(F.regexp_replace(low, r"""[^a-z0-9"'./+\-]+""", " "))


def norm_parser(c: Column | str) -> Column:
    """Lower case, collapsed; null becomes empty."""
    return collapse(strip(F.lower(F.coalesce(col(c), F.lit("")))))


def norm_multi(c: Column | str) -> Column:
    """``norm_parser`` with plain quotes."""
    return fold_quotes(norm_parser(c))


def norm_compatible(c: Column | str) -> Column:
    """Lower case with plain dashes; inner white space stays."""
    return F.translate(F.lower(strip(F.coalesce(col(c), F.lit("")))), *DASHES)


def norm_entity(c: Column | str) -> Column:
    """Case-folded (sharp s equals ss), collapsed."""
    return F.replace(F.lower(collapse(strip(F.coalesce(col(c), F.lit(""))))), F.lit("ß"), F.lit("ss"))


def norm_adapter(c: Column | str) -> Column:
    return F.upper(collapse(strip(F.coalesce(col(c), F.lit("")))))


def norm_query(c: Column | str) -> Column:
    return F.lower(collapse(strip(F.coalesce(col(c), F.lit("")))))


def clean_value(c: Column | str) -> Column:
    return null_if_blank(strip(c))


@F.pandas_udf(StringType())
def _unescaped(values: pd.Series) -> pd.Series:
    return values.map(lambda v: html.unescape(v) if isinstance(v, str) and "&" in v else v)


def unescape(c: Column | str) -> Column:
    """Character references of HTML as text; the full table of names exists only in Python."""
    return _unescaped(col(c))


def _tidied(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def clean_document(c: Column | str) -> Column:
    """Unescaped text with plain blanks, line feeds and at most one empty line in a row."""
    plain = F.replace(F.translate(unescape(F.coalesce(col(c), F.lit(""))), " ", " "), F.lit("\r\n"), F.lit("\n"))
    return strip(_tidied(plain))


def clean_chunk(c: Column | str) -> Column:
    """As ``clean_document`` without unescaping; lines don't begin with blanks."""
    plain = F.replace(F.replace(F.translate(F.coalesce(col(c), F.lit("")), " ", " "), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\n[ \t]+", "\n"), r"\n{3,}", "\n\n"))


def search_tokens(c: Column | str) -> Column:
    """Tokens of ``norm_search``; none for empty text."""
    return F.filter(F.split(norm_search(c), " "), lambda t: t != "")


def phrase_tokens(c: Column | str) -> Column:
    """Tokens of ``norm_structured`` without punctuation at their ends."""
    bare = F.transform(F.split(norm_structured(c), " "), lambda t: F.regexp_replace(t, f"^[{EDGE_MARKS}]+|[{EDGE_MARKS}]+$", ""))
    return F.filter(bare, lambda t: t != "")


def has_phrase(tokens: Column, phrase: Column) -> Column:
    """Whether ``phrase`` (array) is a contiguous part of ``tokens``; an empty phrase is not."""
    spots = F.sequence(F.lit(1), F.greatest(F.size(tokens) - F.size(phrase) + 1, F.lit(1)))
    return (F.size(phrase) > 0) & (F.size(phrase) <= F.size(tokens)) & F.exists(spots, lambda i: F.slice(tokens, i, F.size(phrase)) == phrase)


def has_term(query: Column | str, term: Column | str) -> Column:
    """Whether the term stands in the query between boundaries, letters and digits alone counting."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))
    q, t = plain(query), plain(term)
    return (t != "") & F.contains(F.concat(F.lit(" "), q, F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" ")))


def title_case(c: Column | str) -> Column:
    """Upper case for each letter that follows no letter, lower for the others."""
    parted = F.regexp_replace(col(c), r"(?<=\P{L})(?=\p{L})", "\u0001 ")
    return F.replace(F.initcap(parted), F.lit("\u0001 "), F.lit(""))


def label(c: Column | str) -> Column:
    return title_case(F.replace(col(c), F.lit("_"), F.lit(" ")))


def capitalise(c: Column | str) -> Column:
    low = F.lower(col(c))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2)))


def count_words(c: Column | str) -> Column:
    bare = strip(F.coalesce(col(c), F.lit("")))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+"))).cast("long")


def identifier_like(c: Column | str) -> Column:
    """At most 150 characters with a letter or digit."""
    return (F.length(col(c)) <= 150) & col(c).rlike(r"[\p{L}\p{N}]")


def identifier_field(c: Column | str) -> Column:
    """Six characters or more with a letter and a digit."""
    return (F.length(col(c)) >= 6) & col(c).rlike(r"\p{L}") & col(c).rlike(r"\p{Nd}")


HEADING = r"^(\d+(?:\.\d+){0,4})\.?\s+(.+)$"


def heading_number(c: Column | str) -> Column:
    """The number of a numbered heading, else null: at most 180 characters; long titles don't end in a stop or colon."""
    bare = strip(c)
    title = F.regexp_extract(bare, HEADING, 2)
    sentence = (F.length(title) > 40) & title.rlike(r"[.:;]$")
    return F.when((F.length(bare) <= 180) & bare.rlike(HEADING) & ~sentence, F.regexp_extract(bare, HEADING, 1))


def heading_title(c: Column | str) -> Column:
    return F.when(heading_number(c).isNotNull(), strip(F.regexp_extract(strip(c), HEADING, 2)))


def heading_level(number: Column | str) -> Column:
    """1 section, 2 subsection, 3 and more clause."""
    n = col(number)
    return F.length(n) - F.length(F.replace(n, F.lit("."), F.lit(""))) + 1


def letter_heading(c: Column | str) -> Column:
    return strip(c).rlike(r"^[A-Z]\.\s+[A-Z][A-Z0-9 &/\-(),.']{2,}$")


# Marks of a repeated page head, what is taken out of one, page labels, scanning leftovers. They belong to one kind of
# document; the functions take others as a parameter.
HEADER_PATTERNS = (
    r"PRODUCT STANDARD",
    r"HYDERABAD",
    r"TC\s*65132",
    r"REV\s*NO",
    r"PAGE\s+\d+\s+OF\s+\d+",
)
HEADER_MARKS = (
    r"PRODUCT STANDARD",
    r"HYDERABAD",
    r"TC\s*65132",
    r"Rev\s*No\.?\s*\d+",
    r"Page\s+\d+\s+of\s+\d+",
)
PAGE_LABELS = (
    r"^Page\s+\d+\s+of\s+\d+$",
    r"^Rev\.?\s*No\.?\s*\d+$",
    r"^TC\s*\d+$",
    r"^HYDERABAD$",
    r"^PRODUCT STANDARD$",
)
NOISE_PATTERNS = (
    r"^fe\.?\s*co\s*R\s*D$",
    r"^R\s*00\s*T",
    r"^10\s+00o",
    r"^D,\s*E",
)


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found, whatever the case."""
    return F.array_contains(F.array(*[c.rlike(f"(?i){p}") for p in patterns]), True)


def repeated_header(c: Column | str, patterns: tuple[str, ...] = HEADER_PATTERNS) -> Column:
    """At least two of the header patterns."""
    up = F.upper(col(c))
    return sum((up.rlike(p).cast("int") for p in patterns), F.lit(0)) >= 2


def page_label(c: Column | str, patterns: tuple[str, ...] = PAGE_LABELS) -> Column:
    return any_of(clean_chunk(c), patterns)


def layout_noise(c: Column | str, patterns: tuple[str, ...] = NOISE_PATTERNS) -> Column:
    """Empty, or at most 8 characters with at most 3 letters, or a known leftover."""
    bare = clean_chunk(c)
    return (bare == "") | ((F.length(bare) <= 8) & (F.regexp_count(bare, F.lit("[A-Za-z]")) <= 3)) | any_of(bare, patterns)


def ratio(a: Column | str, b: Column | str) -> Column:
    """Guarded division, rounded to 8 places."""
    return F.when(col(b) > 0, F.round(col(a) / col(b), 8)).otherwise(F.lit(0.0))


def safe_int(c: Column | str, default: int = 0) -> Column:
    return F.coalesce(col(c).try_cast("double").cast("long"), F.lit(default).cast("long"))


def safe_float(c: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(default))


def first_unique(c: Column | str) -> Column:
    """An array's distinct values in order of first appearance, without nulls."""
    return F.array_distinct(F.array_compact(col(c)))
