"""Best-fit packing: every piece once, sequences without gaps, near the fewest there can be."""

import itertools
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cairnway.llm import best_fit, token_files, words
from cairnway.llm.queries import QUERIES, TOKENIZERS, vocabulary

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(TOKENIZERS).exists(), reason="no vocabulary files")


def plain_exact(left, gap):
    """Whether one, two or three lengths fill the gap, by trying all."""
    ones = [n for n, k in enumerate(left) for _ in range(min(int(k), 3)) if n]
    return any(
        sum(c) == gap
        for size in (1, 2, 3)
        for c in itertools.combinations(ones, size)
    )


def test_complements_follow_the_counts():
    rng = random.Random(2)
    for _ in range(60):
        counts = np.array([0] + [rng.choice([0, 0, 0, 1, 2, 5]) for _ in range(14)])
        index = best_fit.Complements(counts)
        for _ in range(12):
            gap = rng.randrange(1, 15)
            found = index.exact(gap)
            assert (found is not None) == plain_exact(index.left, gap)
            if found:
                assert sum(found) == gap and len(found) <= 3
                for n in found:
                    index.take(n, 1)
                assert (index.left >= 0).all()
                if rng.random() < 0.3:
                    index.give(found[0], 1)
            fresh = best_fit.Complements(index.left)
            assert (fresh.pairs == index.pairs).all()


@pytest.mark.parametrize("kind", ["uniform", "small", "one", "halves", "hot"])
def test_patterns_use_every_piece_once(kind):
    rng = np.random.default_rng(4)
    size, counts = 512, np.zeros(513, np.int64)
    if kind == "uniform":
        counts[1:] = rng.integers(0, 40, size)
    elif kind == "small":
        counts[1:40] = rng.integers(0, 10**6, 39)
    elif kind == "one":
        counts[7] = 1
    elif kind == "halves":
        counts[[256, 512]] = 11, 3
    else:
        counts[1:], counts[1] = rng.integers(0, 5, size), 10**9
    made, used = best_fit.patterns(counts), np.zeros(513, np.int64)
    for often, parts in made:
        assert sum(n * k for n, k in parts) <= size
        for n, k in parts:
            used[n] += often * k
    assert (used == counts).all()
    total = sum(often for often, _ in made)
    assert total <= -(-int(counts @ np.arange(513)) // size) * 1.02 + 1
    places = best_fit.Places.of(np.minimum(counts, 50))
    filled = {}
    for n in np.flatnonzero(counts):
        rank = np.arange(min(counts[n], 50))
        for s, o in zip(*places.find(np.full(len(rank), n), rank), strict=True):
            filled.setdefault(int(s), []).append((int(o), int(n)))
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size


def test_words_equal_library():
    definition = vocabulary("word_bpe_49k.json")
    library, own = Tokenizer.from_str(definition), token_files.Encoder(definition, True)
    rng = random.Random(3)
    letters, few = [chr(c) for c in range(0x2B0)], "stremvld'' aZ9!é\n\t\xa0ª²"
    texts = ["'s", "'t", "x're've'm'll'd", "''s", "'S'T 'RE'", "a'", "s", "'", "re", "'r", "e", "<|endoftext|>a", "日本 a's", ""]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choice(few) for _ in range(rng.randrange(25))) for _ in range(8000)]
    for chosen in (texts, [t for t, ok in zip(texts, words.plain(pa.array(texts)), strict=True) if ok]):
        ids, ends = own.encode(pa.array(chosen))
        begin = 0
        for text, done, end in zip(chosen, library.encode_batch(chosen, add_special_tokens=False), ends, strict=True):
            assert ids[begin:end].tolist() == done.ids, text
            begin = end


def check(rows, docs, max_len, end_id, whole=None):
    library = Tokenizer.from_str(vocabulary("word_bpe_49k.json"))
    want = []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id])
        for i, at in enumerate(range(0, max(len(ids), 1), max_len)):
            part = ids[at : at + max_len]
            want.append((doc_id, i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    assert len(held) <= -(-sum(w[3] for w in want) // max_len) * 1.02 + 2


def test_op11_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op11_best_fit"](spark, FOLDER).collect(), docs, 2048, 0)


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    definition = vocabulary("word_bpe_49k.json")
    docs = [(1, None), (1, None), (2, ""), (None, "a b c"), (3, "word " * 9000), (4, "x y"), (4, "x y"), (5, "é" * 300)] + [(i, "") for i in range(50, 450)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, length int, rank int").repartition(5)
    for max_len, end_id in ((2048, 0), (7, 0), (64, None)):
        placed = best_fit.best_fit(frame, definition, max_len, end_id, {"ids_crc32": F.crc32("ids")})
        check(placed.collect(), docs, max_len, end_id)
    assert best_fit.best_fit(frame.limit(0), definition).collect() == []
    whole = best_fit.sequences(best_fit.best_fit(frame, definition, 64)).collect()
    assert all(len(r["ids"]) == 4 * r["n_ids"] <= 256 for r in whole)
    library = Tokenizer.from_str(definition)
    assert sum(r["n_ids"] for r in whole) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
