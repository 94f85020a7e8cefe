import html
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.functions import text as tx


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


def many(spark, texts, *fs):
    return [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1).orderBy("i").select(*[f(F.col("t")).alias(f"c{k}") for k, f in enumerate(fs)]).collect()]


TEXTS = ["  a\t b  c ", "Straße “x”’", "", "   ", "DSH 3–300 RF—HART", 'Line Size: 6" / A2A?', "min. 1,5 +x-y", "2nd ab_cd été", "a&amp;b &eacute;&#39;\r\nx\n\n\n\ny  z"]


def test_normalisers(spark):
    got = many(spark, TEXTS + [None], tx.norm_enriched, tx.norm_structured, tx.norm_search, tx.norm_parser, tx.norm_multi, tx.norm_compatible, tx.norm_entity, tx.norm_adapter, tx.clean_value)
    for text, row in zip(TEXTS, got, strict=False):
        bare = re.sub(r"\s+", " ", text.strip())
        quotes = str.maketrans("“”’", "\"\"'")
        assert row[0] == (bare.upper() or None)
        assert row[1] == bare.upper().translate(quotes)
        assert row[2] == re.sub(r"""[^a-z0-9"'./+\-]+""", " ", text.lower().translate(quotes)).strip()
        assert row[3] == bare.lower() and row[4] == bare.lower().translate(quotes)
        assert row[5] == text.strip().lower().translate(str.maketrans("–—", "--"))
        assert row[6] == bare.casefold() and row[7] == bare.upper() and row[8] == (text.strip() or None)
    assert got[-1] == (None, "", "", "", "", "", "", "", None)


def test_cleaning_and_counts(spark):
    for text, row in zip(TEXTS, many(spark, TEXTS, tx.clean_document, tx.clean_chunk, tx.count_words, tx.title_case), strict=True):
        plain = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", html.unescape(text).replace(" ", " ").replace("\r\n", "\n"))).strip()
        assert row[0] == plain
        chunk = re.sub(r"[ \t]+", " ", text.replace(" ", " ").replace("\r\n", "\n").replace("\r", "\n"))
        assert row[1] == re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+", "\n", chunk)).strip()
        assert row[2] == len(text.split()) and row[3] == text.title()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab .,?()X", max_size=12), min_size=1, max_size=20), st.text("ab X", max_size=4))
def test_phrases(spark, texts, phrase):
    tokens = lambda t: [x for x in (w.strip(" \t\r\n.,!?;:()[]{}") for w in t.upper().split()) if x]
    p = tokens(phrase)
    got = many(spark, texts, lambda c: tx.has_phrase(tx.phrase_tokens(c), tx.phrase_tokens(F.lit(phrase))))
    for t, (hit,) in zip(texts, got, strict=True):
        q = tokens(t)
        assert hit == (bool(p) and any(q[i : i + len(p)] == p for i in range(len(q))))


def test_identifiers_headings_and_noise(spark):
    rows = ["1.2 Scope of supply", "3. General", "1.2.3.4 Deep", "7 " + "x" * 50 + ".", "A. GENERAL NOTES", "plain line", "ab1", "Page 3 of 9", "PRODUCT STANDARD Rev No. 3", "TC9765132581", "12", "ok then"]
    got = many(spark, rows, tx.heading_number, tx.letter_heading, tx.page_label, tx.repeated_header, tx.layout_noise, tx.identifier_field)
    by = dict(zip(rows, got, strict=True))
    assert [by[r][0] for r in rows[:6]] == ["1.2", "3", "1.2.3.4", None, None, None]
    assert by["A. GENERAL NOTES"][1] and not by["plain line"][1]
    assert by["Page 3 of 9"][2] and not by["plain line"][2] and by["PRODUCT STANDARD Rev No. 3"][3] and not by["plain line"][3]
    assert by["ab1"][4] and by["12"][4] and not by["ok then"][4] and by["TC9765132581"][5] and not by["ab1"][5]
    assert one(spark, "1.2.3", tx.heading_level) == 3 and one(spark, "inLET", tx.capitalise) == "Inlet"
    assert one(spark, "find the Item-no of it", lambda c: tx.has_term(c, F.lit("item no"))) and not one(spark, "items", lambda c: tx.has_term(c, F.lit("item")))
    assert one(spark, "7.9", tx.safe_int) == 7 and one(spark, "x", tx.safe_int) == 0 and one(spark, "x", tx.safe_float) == 0.0
