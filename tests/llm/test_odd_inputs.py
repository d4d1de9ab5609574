"""Every operator and stage over rows with nulls, long texts, repeats and clashing columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, jaccard_join, licenses, packing, pii, pseudo_likelihood, quality_model, quality_rules, warc
from tidemark.llm.common import shared_folder

LONG = "one two three four +1 (614) 555-8001 a.b@c.example.com é\n" * 40_000
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, key string, cls string, bin_id int, grade int, more string, i int, c0 string, "
    "fragment string, length int, n_words long, component_id long, block string, rated_id long, sample_id long, d long, k string"
)


@pytest.fixture(scope="module")
def docs(spark):
    rest = (7, "key", "cls", 1, 2, "more", 3, "c0", "f", 4, 5, 6, "b", 8, 9, 10, "k")
    rows = [(1, LONG, "en", "s", 3), (2, "some words in a text here", None, None, None), (2, "some words in a text here", None, None, None), (3, None, None, "s", None), (4, "", "en", None, 0), (None, "a text without an id ퟿", "de", "s", 2)]
    rows += [(None, None, None, None, None), (5, " \t\n\x0b\x0c\r ", "en", "s", 1), (6, "  　 no-break", "en", "s", 1), (7, "<|im_start|> WARC/1.1\r\n", "en", "s", 1)]
    return spark.createDataFrame([(*r, *rest) for r in rows], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (4, 0, 1), (5, 1, None), (None, 1, 0), (6, None, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(None, "one two three four 1 614 555 8001 a b c example com é"), (2, None), (3, "")], "item_id long, text string")


def ids(rows):
    return sorted((r.doc_id for r in rows), key=repr)


def test_operators_give_each_row_a_result(spark, docs):
    every = ids(docs.select("doc_id").collect())
    assert ids(quality_rules.score_quality(docs).collect()) == every
    assert ids(pii.all_spans(docs).collect()) == every
    assert ids(jaccard_join.jaccard_components(docs).collect()) == every
    assert ids(quality_model.score_documents(docs, quality_model.train(docs, quality_model.grades_of(labels(spark)))).collect()) == every
    counts = pseudo_likelihood.count_words(docs)
    known = pseudo_likelihood.lexicon(counts)
    assert ids(pseudo_likelihood.score_documents(docs, pseudo_likelihood.train(docs, known), known, counts).collect()) == every
    assert set(ids(packing.pack_documents(docs).collect())) == set(every)
    assert licenses.scan_licenses(docs, licenses.train(docs)).count() == 0


def test_long_text(spark, docs):
    spans = {r.doc_id: r for r in pii.all_spans(docs.where("doc_id = 1")).collect()}[1].base
    assert len(spans) == 80_000
    leaks = decontaminate.find_leaks(docs, bench(spark)).collect()
    assert [(r.doc_id, r.item_id, r.n_equal) for r in leaks] == [(1, -1, 14)]
    stats = quality_rules.score_quality(docs.where("doc_id = 1")).first()
    assert stats.n_words == 40_000 * 9 and stats.n_dup_lines == 39_999 and stats.base_failed


def test_stages_keep_columns_and_rows(spark, docs, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        n = out.count()
        assert n == {"jaccard_join": 9, "decontamination": 9, "pii": 10}.get(name, n)


def test_odd_pages(spark, docs):
    pages = docs.selectExpr("doc_id AS page_id", "concat('http://x/', text) AS url", "text AS html", "id", "key", "length", "fragment")
    path = f"{shared_folder(spark)}/odd-pages"
    warc.write_warc(pages.where("page_id IS NULL OR page_id <> 1"), path)
    got = warc.page_records(warc.read_warc(spark, path, payloads=False)).collect()
    assert len(got) == 9 and sum(r.page_id is None for r in got) == 2
