"""Duplicate finding against brute force on small tables."""

import random
import re

import pyarrow as pa
import pytest

from cairnway.llm import exact_dedup, ngram_join, suffix_dedup

SCHEMA = "doc_id long, text string, source string, th int, cid string"


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "s", 1, "c") for i, t in rows], SCHEMA).repartition(parts)


# -- exact copies --------------------------------------------------------------


def test_exact_dedup(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a b", "ab", " a\tb\n", "abc", "", None, " ", " ", "x" * 50_000, "A b"])) for i in range(300)]
    rows += [(5, "ab"), (5, "ab"), (None, "ab"), (None, "only")]
    got = exact_dedup.exact_dedup(table(spark, rows, 9)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    assert len(got) == len(rows)
    sizes = sorted(r["group_size"] for r in got)
    assert sizes == sorted(len(g) for g in groups.values() for _ in g)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["kept"])
    assert kept == sorted(min(g)[1:] for g in groups.values())
    assert all(r["keep_id"] == r["doc_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(table(spark, rows).limit(0)).collect() == []


# -- n-gram join -----------------------------------------------------------------


def gram_set(text, n=5):
    words = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())
    return frozenset(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else None


def near_rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}é" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 150, 400]))]
        for _ in range(rng.choice([2, 9, 60])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "!!!", "one", "One!", "one two", "word " * 40_000])]
    return rows + [rows[0], rows[3]]


def brute_links(rows, threshold=0.8):
    classes = {}
    for i, t in rows:
        s = gram_set(t)
        classes.setdefault(s if s is not None else ("none", i, t), set()).add(i)
    known = {min(ids): s for s, ids in classes.items() if isinstance(s, frozenset)}
    links = {}
    for a, s in known.items():
        for b, t in known.items():
            if a < b and len(s & t) * 10 >= round(threshold * 10) * len(s | t):
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
    return classes, links


@pytest.mark.parametrize("block", [2048, 16])
def test_ngram_join(spark, block):
    rows = near_rows()
    classes, links = brute_links(rows)
    got = ngram_join.ngram_join(table(spark, rows), block=block).collect()
    assert len(got) == len(rows)
    class_of = {i: min(ids) for ids in classes.values() for i in ids}
    found = sum(r["n_links"] for r in {r["class_id"]: r for r in got}.values())
    true = sum(len(v) for v in links.values())
    assert true > 400 and 0.995 * true <= found <= true
    for r in got:
        assert r["class_id"] == class_of[r["doc_id"]]
        assert r["n_links"] <= len(links.get(r["class_id"], ()))
        seen, todo = set(), [r["class_id"]]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links.get(x, ())
        assert r["group_id"] == min(seen)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_join(table(spark, [(1, "a")]).limit(0)).collect() == []
    got = ngram_join.ngram_join(table(spark, [(None, None), (None, "a b c d e f"), (2, "")])).collect()
    assert sorted(r["n_links"] for r in got) == [0, 0, 0]


def test_runs_follow_the_target():
    assert ngram_join.runs_needed(0.8, 0.9, 2, 3) < ngram_join.runs_needed(0.8, 0.99999, 2, 3)


# -- suffix arrays ---------------------------------------------------------------


def brute_spans(texts, length):
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for p in range(len(d) - length + 1):
            count[d[p : p + length]] = count.get(d[p : p + length], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if count[d[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, kept))
    return out


def random_texts(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé") for _ in range(rng.choice([10, 20, 35]))) for _ in range(5)]
    texts = []
    for _ in range(70):
        t = ""
        for _ in range(rng.randrange(5)):
            t += rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh \0é") for _ in range(rng.randrange(40)))
        texts.append(t)
    return [*texts, *texts[:4], None, "", "a" * 60, "ab" * 40, "aaaaaaaaaaab" * 3, "b" + "a" * 45]


@pytest.mark.parametrize(("seed", "length", "gram", "block"), [(1, 12, 4, 1 << 20), (2, 12, 4, 200), (3, 9, 9, 1 << 20), (4, 16, 1, 300)])
def test_suffix_dedup(spark, monkeypatch, seed, length, gram, block):
    texts = random_texts(seed)
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[5])]
    want = brute_spans([t for _, t in rows], length)
    done = suffix_dedup.suffix_dedup(table(spark, rows), length, gram, block).collect()
    got = sorted((r["doc_id"] or 0, r["n_bytes"], sum(s["to"] - s["from"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in done)
    assert got == sorted((i or 0, *w) for (i, _), w in zip(rows, want, strict=True))


def test_two_stage_order_sorts():
    rng = random.Random(3)
    for _ in range(40):
        bodies = [bytes(rng.choice(b"ab\0c") for _ in range(rng.randrange(6, 30))) for _ in range(6)]
        bodies += [b"a" * 25, bodies[0]]
        begin, strings, there, _ = suffix_dedup.repeated(bodies, 6)
        every = [b[i : i + 6] for b in bodies for i in range(len(b) - 5)]
        want = [every.count(b[i : i + 6]) > 1 for b in bodies for i in range(len(b) - 5)]
        assert there[strings].tolist() == want


def test_long_document_in_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 64)
    text = "".join(random.Random(1).choice("abcd") for _ in range(500))
    run = suffix_dedup._marks(20, 6)
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([0, 1]), pa.array([text, "short " * 9])], names=["doc_id", "th", "text"])
    rows = [r for b in run([batch]) for r in b.to_pylist()]
    starts = sorted(p for r in rows if r["doc_id"] == 7 for p in range(r["first"], r["last"] + 1))
    assert starts == list(range(481))


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.suffix_dedup(table(spark, [(1, "a")]).limit(0)).collect() == []
