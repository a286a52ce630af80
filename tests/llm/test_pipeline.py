"""Each stage against what its operator must leave, on a table with every awkward row."""

import re

import pytest

import corpus_pipeline
from tests.llm.test_dedup import brute_spans, gram_set, near_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", True) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    place = tmp_path_factory.mktemp("pipeline")
    bad = [(900 + i, f"you are a rotten{'abcde'[i % 5]} thing number {i} of many others here") for i in range(120)]
    good = [(2000 + i, f"they are a kind thing number {i} of many others there and {i * 7} more") for i in range(120)]
    rows = [*near_rows(), *bad, *good, (None, "no id"), (None, None)]
    frame(spark, rows).write.parquet(f"{place}/documents.parquet")
    labels = [(i, 1, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in good]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return str(place), rows


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages(spark, folder):
    place, rows = folder
    docs = frame(spark, rows)
    done = rows_of(corpus_pipeline.drop_toxic(spark, docs, place))
    assert done == sorted(((i, t) for i, t in rows if not 900 <= (i or 0) < 1020), key=repr)

    copies = rows_of(corpus_pipeline.drop_copies(spark, frame(spark, done), place))
    groups = {}
    for i, t in done:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i, t))
    best = [min(g, key=lambda x: x[:3]) for g in groups.values()]
    assert [i for i, _ in copies] == [i for i, _ in sorted(((b[3], b[4]) for b in best), key=repr)]

    near = corpus_pipeline.drop_near_copies(spark, frame(spark, copies), place).collect()
    kept = [gram_set(r["text"]) for r in near if gram_set(r["text"])]
    assert all(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(kept) for b in kept[:k])
    left = {gram_set(r["text"]) for r in near}
    assert all(any(s == t or (s and t and s & t) for t in left) for s in (gram_set(t) for _, t in copies))

    cut = corpus_pipeline.cut_repeats(spark, frame(spark, rows), place)
    assert cut.columns == docs.columns
    want = brute_spans([t for _, t in rows], corpus_pipeline.PASSAGE_BYTES)
    assert sorted(len((r["text"] or "").replace("�", "")) for r in cut.collect()) == sorted(
        len(w[3].decode("utf-8", "ignore")) for w in want
    )
    packed = corpus_pipeline.pack_batches(spark, frame(spark, rows), place).collect()
    assert sum(r["n_tokens"] for r in packed) == sum(len((t or "").split()) for _, t in rows)


def test_run_and_empty(spark, folder, tmp_path):
    place, _ = folder
    assert corpus_pipeline.run(spark, place).count() > 0
    frame(spark, [(1, "a")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{place}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
