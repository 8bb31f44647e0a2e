"""Every stage of the pipeline on nulls, empty and repeated texts, clashing columns and an empty table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import decontaminate

SF = "/root/testdata/sf0.001"
#: Columns of every operator behind the stages, with values that must come back.
CLASHES = ["n_words", "n_hit", "items", "at", "_at", "_row", "row", "kept", "base_failed", "p_toxic", "spans", "base", "n_email", "_text", "class_id", "key", "label", "piece", "start", "length", "sequence_id", "offset", "odd.name"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 6)))
    texts = [" ".join(word() for _ in range(rnd.randint(30, 90))) for _ in range(25)]
    texts += [texts[3], texts[3] + " end", None, None, "", "", " \n\t ", "short one", " ".join(word() for _ in range(9000)), texts[5] + " mail me at some.one@example.com or +1 (212) 555-0198"]
    rows = [(i if i != 7 else None, t, "s", "en", len(t) if t is not None else None) for i, t in enumerate(texts)] + [(4, texts[4], "s", "en", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    return df.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in CLASHES})


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns_and_clean_rows(spark, docs, name, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    for r in rows:
        assert all(r[c] == f"{c}-{'null' if r.doc_id is None else r.doc_id}" for c in CLASHES)
    given = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    ids = [r.doc_id for r in rows]
    if name == "quality_rules":
        assert all(r.text is not None and len(r.text.split()) >= 20 for r in rows) and {(r.doc_id, r.text) for r in rows} <= given
        assert ids.count(4) in (0, 3)
    elif name == "near_dedup":
        assert {(r.doc_id, r.text) for r in rows} <= given and ids.count(4) == 1
        assert 3 in ids and 25 not in ids and 26 not in ids and set(range(7)) <= set(ids)
    elif name == "decontamination":
        assert len(rows) == docs.count() and {(r.doc_id, r.text) for r in rows} == given
    else:
        changed = {r.doc_id: r.text for r in rows if (r.doc_id, r.text) not in given}
        assert len(rows) == docs.count() and set(changed) == {34} and "<email>" in changed[34] and "<phone>" in changed[34]


def test_packing_takes_what_is_there(spark, docs):
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    rows = out.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert max(r.offset + r.length for r in rows) <= 2048


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_of_an_empty_table(spark, docs, name, stage):
    assert stage(spark, docs.limit(0), SF).isEmpty()


def test_decontamination_in_several_passes_keeps_all_columns(spark, docs):
    bench = spark.createDataFrame([(f"q{i}", " ".join(t.split()[5:20])) for i, t in enumerate(r.text for r in docs.filter("doc_id < 6").dropDuplicates(["doc_id"]).orderBy("doc_id").collect())], "item_id string, text string")
    plain = docs.drop("n_words", "n_hit", "items", "odd.name")
    one, many = (decontaminate.scan(plain, bench, max_bytes=m) for m in (10**6, 100))
    assert one.columns == many.columns
    text = lambda df: sorted(map(repr, df.collect()))
    assert text(one) == text(many) and one.filter("n_hit >= 15").count() >= 6
