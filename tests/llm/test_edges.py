"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from drawstats.llm import brown_lm, fm_dedup, html_text, media, mixing, pieces_codec, quality, simhash, suffix_dedup, token_counts

LONG = "ab cd " * 30000 + "x" * 5000
ROWS = [(1, "a b c"), (None, "no id at all"), (2, None), (3, ""), (4, LONG), (5, "a b c"), (5, "a b c"), (6, "é\x00　 \U0001f600 z\n\nq"), (None, None), (7, " \t\n ")]
SCHEMA = "doc_id long, text string"


def docs_of(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "h", "spans", "d", "v", "n", "fp", "kept", "key", "n_words", "ids", "p_good", "media"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, None, None), (None, 1, 0), (6, 1, 1)], "doc_id long, quality long, toxic long")


OPERATORS = {
    "sentencepiece": lambda s, d: pieces_codec.decode(pieces_codec.encode(d)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "suffix": lambda s, d: suffix_dedup.remove_repeated_bytes(d),
    "brown": lambda s, d: brown_lm.scored(d),
    "fm": lambda s, d: fm_dedup.remove_repeated_words(d),
    "mixing": lambda s, d: mixing.mixed_rates(d, labels(s)),
    "counts": lambda s, d: token_counts.counted(d, token_counts.sample_edits()),
    "quality": lambda s, d: quality.quality_rules(d),
    "media": lambda s, d: media.media_columns(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_are_kept(spark, name):
    got = OPERATORS[name](spark, docs_of(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)
    twins = [tuple(r) for r in got if r.doc_id == 5]
    assert twins[0] == twins[1]  # repeated rows get equal results


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs_of(spark, [])).count() == 0


def test_decoded_text_is_the_text(spark):
    for r in pieces_codec.decode(pieces_codec.encode(docs_of(spark))).join(docs_of(spark).select("doc_id", "text"), "doc_id").collect():
        assert r.decoded == (r.text or "")


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>x"), (2, "u", "<p>x"), (3, "u", "<" * 50000), (4, "u", "plain " * 50000)], "page_id long, url string, html string")
    pages = pages.withColumn("text", F.lit("clash"))
    got = html_text.extract(pages).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id == 2} == {"x"}
    assert html_text.extract(pages.limit(0)).count() == 0
