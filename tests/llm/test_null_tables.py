"""Odd input for the operators at once: nulls in all columns, repeated rows, extra columns with clashing names, empty tables."""

import pytest

from lonepoint.llm import bpe, exact_dedup, html_extract, line_dedup, mixing, ngram_join, packing, quality, toxicity, vector_dedup
from tests.llm.test_packing import PATH, PATTERN

ROWS = [(1, "one two three\nfour five", "en", "a", 3), (1, "one two three\nfour five", "en", "a", 3), (None, None, None, None, None), (2, "", None, "", 0), (3, " \n\t", "de", "b", 1), (4, "x" * 200_000, "en", "a", 9)]
EXTRA = "kept boolean, n_links long, score double, sim long, key long, h1 long, n long, block int, id long, th long, k0 long, text_sha256 string"


@pytest.fixture(scope="module")
def tables(spark):
    n = EXTRA.count(",") + 1
    docs = spark.createDataFrame([(*r, *[None] * n) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


OPERATORS = {
    1: lambda d, x: line_dedup.deduplicated(d),
    2: lambda d, x: quality.score(d, x),
    3: lambda d, x: bpe.transcode(d, PATH, PATTERN, ("n_tokens",)),
    4: lambda d, x: packing.pack(d, PATH, PATTERN, 50256),
    5: lambda d, x: html_extract.extract_pages(d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"})),
    6: lambda d, x: mixing.amounts(d),
    7: lambda d, x: exact_dedup.exact_dedup(d),
    8: lambda d, x: toxicity.score(d, x),
    9: lambda d, x: ngram_join.near_duplicates(d),
    10: lambda d, x: vector_dedup.near_duplicates(d.selectExpr("*", "doc_id AS vec_id", "array(1.0f, CAST(n_chars AS float)) AS embedding", "n_chars AS label")),
}


@pytest.mark.parametrize("number", OPERATORS)
def test_odd_rows(tables, number):
    docs, labels = tables
    got = OPERATORS[number](docs, labels).collect()
    assert number == 4 or len(got) == len(ROWS)
    assert OPERATORS[number](docs.limit(0), labels).count() == 0
    if number in (2, 8):
        assert OPERATORS[number](docs, labels.limit(0)).count() == len(ROWS)
