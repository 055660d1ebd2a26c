"""Scalar functions: year, tokenizers, title key (against an independent
Python computation), histogram buckets."""

import hashlib
import re
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegraph.functions.text import (
    bow_tokens, extract_year, histogram_bucket, index_terms, index_tokens, strip_dtd, term_counts, title_id, xml_unescape,
)


def py_title_id(title: str) -> int:
    t = re.sub(r"(proc\..*|proceedings.*)", "", title)
    t = re.sub(r"[^a-zA-Z+]", "", t).lower() or "title:" + title
    return struct.unpack(">q", hashlib.md5(t.encode()).digest()[:8])[0]


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col(F.col("x")).alias("y")).first().y


def test_year(spark):
    assert one(spark, extract_year, "12005") == 0
    assert one(spark, extract_year, "1990 and 2013") == 0
    assert one(spark, extract_year, "in 1999 and again in 2004.") == 2004
    assert one(spark, extract_year, "") == 0


def test_bow_tokens(spark):
    assert one(spark, bow_tokens, "") == [""]
    assert one(spark, bow_tokens, "...") == []
    assert one(spark, bow_tokens, "a, b  c1") == ["a", "", "b", "", "c"]
    assert one(spark, bow_tokens, ",Ab") == ["", "ab"]
    assert one(spark, lambda c: bow_tokens(c, keep_empty=False), "a, b") == ["a", "b"]


def test_index_terms(spark):
    df = spark.createDataFrame([("The quick fox of the old barn jumps",)], "t string")
    got = df.select(index_tokens(F.col("t")).alias("w")).select(index_terms("w").alias("x")).first().x
    # unigrams without stop words; shingles never span a removed stop word
    assert got[:5] == ["quick", "fox", "old", "barn", "jumps"]
    assert "quick fox" in got and "old barn jumps" in got and "fox old" not in got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ+ .,-proceedings\n", max_size=40), min_size=1, max_size=20))
def test_title_id_matches_python(spark_session_cached, titles):
    spark = spark_session_cached
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = [r.k for r in df.select(title_id("t").alias("k")).collect()]
    assert got == [py_title_id(t) for t in titles]


def test_titles_without_latin_letters_keep_apart(spark):
    df = spark.createDataFrame([("漢字",), ("漢字",), ("字",), ("12",)], "t string")
    own = [r.k for r in df.select(title_id("t").alias("k")).collect()]
    assert own[0] == own[1] and len(set(own)) == 3
    assert len({r.k for r in df.select(title_id("t", shared_empty_key=True).alias("k")).collect()}) == 1


def test_term_counts(spark):
    rows = [(["b", "a", "b", ""],), ([],), (["x"] * 1000,)]
    got = [r.c for r in spark.createDataFrame(rows, "t array<string>").select(term_counts("t").alias("c")).collect()]
    assert [[tuple(x) for x in c] for c in got] == [[("", 1), ("a", 1), ("b", 2)], [], [("x", 1000)]]


def test_character_references(spark):
    text = "a&#38;b&#160;c &eacute; &#x4e2d; &lt;b&gt; &amp;#38; &unknown; &#0; &#1114112; &#xD800; & &; &amp"
    assert one(spark, xml_unescape, text) == "a&b\xa0c é 中 <b> &#38; &unknown; &#0; &#1114112; &#xD800; & &; &amp"


def test_text_after_the_last_document_type(spark):
    d = '<!DOCTYPE pdf2xml SYSTEM "pdf2xml.dtd">'
    assert one(spark, strip_dtd, f"a{d}b{d}c") == "c"
    assert one(spark, strip_dtd, "a<!DOCTYPE pdf2xml>b") == "ab"


def test_title_id_ignores_case_and_punctuation(spark):
    df = spark.createDataFrame([("Time, Clocks and Ordering!",), ("time clocks AND ordering",)], "t string")
    a, b = [r.k for r in df.select(title_id("t").alias("k")).collect()]
    assert a == b


def test_histogram_bucket(spark):
    assert one(spark, histogram_bucket, 0, "long") == 0
    assert one(spark, lambda c: histogram_bucket(c, "asis"), 5, "long") in (5, 6)
    assert one(spark, histogram_bucket, 100, "long") == 48


def test_token_flags(spark):
    from citegraph.functions.text import token_flags

    df = spark.createDataFrame([("In Proceedings 2004",), ("A",), ("and",)], "t string")
    rows = df.select(token_flags("t").alias("f")).collect()
    assert rows[0].f.is_conference and rows[0].f.has_date and rows[0].f.is_numeric
    assert rows[1].f.is_initial and rows[1].f.is_upper
    assert rows[2].f.is_key_word and not rows[2].f.is_initial


def test_length_norm(spark):
    from citegraph.functions.text import length_norm

    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 10**6)], "n long").select("n", length_norm("n").alias("v"))
    assert {r.n: r.v for r in df.collect()} == {n: 1 / n**0.5 for n in (1, 2, 3, 10**6)}
