from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest

from lonepoint.llm import bpe, common, line_dedup, mixing, ngram_join, quality, registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage gets and returns, each written and read again."""
    docs, out = common.read(spark, DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = common.stored(stage(spark, docs, DIR), "step")
        out.append((name, docs, made))
        docs = made
    return out


def rows(df):
    return Counter(map(repr, df.collect()))


def test_stages_keep_the_columns(spark, steps):
    columns = common.read(spark, DIR, "documents").columns
    assert 4 <= len(steps) <= 5 and all(made.columns == columns for _, _, made in steps[:-1])
    assert all(docs.count() > 0 for _, docs, _ in steps)


def test_quality_stage(spark, steps):
    _, docs, made = steps[0]
    keep = {r.doc_id for r in quality.score(docs, common.read(spark, DIR, "labels")).collect() if r.predicted}
    assert rows(made) == rows(docs.filter(docs.doc_id.isin(list(keep)))) and 0 < len(keep) < docs.count()


def test_line_stage(steps):
    _, docs, made = steps[1]
    before, after = ({r.doc_id: r.text.split("\n") for r in x.collect()} for x in (docs, made))
    assert before.keys() == after.keys()
    seen, gone = Counter(), 0
    for doc, lines in after.items():
        it = iter(before[doc])
        assert lines == [""] or all(x in it for x in lines)  # what stays is in order
        gone += len(before[doc]) - len(lines)
        seen.update(f for x in lines for f in line_dedup.normal_lines(x.encode()) if f)
    assert gone > 0 and max(seen.values()) == 1


def test_join_stage(steps):
    _, docs, made = steps[2]
    classes = {r.doc_id: r.class_id for r in ngram_join.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in made.collect()) == sorted(set(classes.values()))


def test_mix_stage(steps):
    _, docs, made = steps[3]
    times = {r.doc_id: r.times for r in mixing.amounts(docs).collect()}
    assert Counter(r.doc_id for r in made.collect()) == Counter({d: n for d, n in times.items() if n})


def test_encode_stage(steps):
    _, docs, made = steps[4]
    codec = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in made.collect():
        assert codec.decode(r.ids).decode() == texts[r.doc_id] and len(r.ids) == r.n_tokens


def test_run_is_all_stages(spark, steps):
    assert rows(corpus_pipeline.run(spark, DIR)) == rows(steps[-1][2])
    assert registry.QUERIES["pipeline"] is corpus_pipeline.run


def test_clashing_columns_and_nulls(spark):
    """Every stage over a table with extra columns named like internal ones, nulls in all columns and repeated rows."""
    data = [(1, "A first line here.\nAnd another one.", "en", "a", 1, "x", 1.0), (2, None, None, None, None, None, None), (None, "A first line here.", "en", None, 3, "y", 2.0), (1, "A first line here.\nAnd another one.", "en", "a", 1, "x", 1.0), (3, "", "en", "b", 0, None, None)]
    data += [(4, "A very long text of many words. " * 40_000, "en", "a", 1, None, None), (5, "line\n" * 20_000, "en", "a", 1, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, kept string, size double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), DIR).count() == 0
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == len(data)
