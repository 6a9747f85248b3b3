"""The stages of corpus_pipeline.py one by one and in a row, against plain Python where it can say what must stay; odd rows, clashing columns."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import op7_pii

CLASHING = ["key", "whole", "last_h", "last_id", "rep", "count", "__tokens", "__domain", "__near_id", "component", "h", "fold", "toxic", "__epoch"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean, toxic, copied and odd documents with many more columns, and their labels."""
    at = str(tmp_path_factory.mktemp("corpus"))
    rows = []
    for i in range(120):
        words = [f"w{zlib.crc32(f'{i}-{k}'.encode()) % 900}" for k in range(60)]
        rows.append((i, " ".join(words) + (" you utter moron" if i % 6 == 0 else "") + (" mail a.b@example.org now" if i % 5 == 0 else ""), "en" if i % 2 else "de", f"src{i % 3}"))
    rows += [(1000 + i, rows[i][1] + " end", "en", "src0") for i in range(1, 30)]  # near copies
    rows += [(7, rows[7][1], "en", "src1"), (None, "a word", None, None), (2000, None, "de", "src1"), (2001, "", "en", None), (2002, " \t", None, "src2"), (2003, "x" * 30000, "fr", "src0"), (2004, "z " * 200_000, "fr", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.withColumns({c: F.lit(f"{c}!") for c in CLASHING}).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(0, 120, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_in_a_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, sf_dir))
        assert out.columns == columns, name
        rows = out.collect()
        assert all(r[c] == f"{c}!" for r in rows for c in CLASHING), name
        if name == "toxicity":
            assert Counter(rows) == Counter(r for r in before if "moron" not in (r.text or ""))
        if name == "near_duplicates":
            ids = Counter(r.doc_id for r in rows)
            copied = {r.doc_id for r in before if r.doc_id is not None and 1000 < r.doc_id < 2000 and any(x.doc_id == r.doc_id - 1000 for x in before)}
            assert ids == Counter({r.doc_id for r in before} - copied)
        if name == "personal_data":
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in before)
            for r in rows:
                assert not op7_pii.base_spans(r.text) and (r.text is None) == (next(x.text for x in before if x.doc_id == r.doc_id) is None)
                assert r.n_chars == (None if r.text is None else len(r.text))
        if name == "mixing":
            assert not Counter(rows) - Counter(before)
            size = lambda rs: sum(len((r.text or "").split()) for r in rs)
            assert size(rows) <= size(before) * corpus_pipeline.MIX.percent // 100
        docs, before = out, rows
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert Counter(r.doc_id for r in last.collect()) == Counter(r.doc_id for r in before)
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, last.collect()))


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_of_an_empty_table(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    out = STAGES[name](spark, docs, sf_dir)
    assert out.count() == 0 and (name == "tokens" or out.columns == docs.columns)
