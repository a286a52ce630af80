"""Language, toxicity and fingerprints: held-out accuracy and brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from cairnway.llm import fingerprints, language, packing, sharding, toxicity

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, row string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, 0.5, "r") for i, t, x in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# -- language --------------------------------------------------------------------


def test_held_out_accuracy(spark, docs):
    rows = language.identify(docs, most=200).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    cut, wanted = rng.integers(97, 123, (5, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net = language.Network.fresh(["a", "b", "c"], 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    net.learning = True
    slopes = net.gradients(cut, wanted)

    def loss():
        return -net.log_probabilities(cut)[np.arange(5), wanted].mean()

    for name, value in net.weights.items():
        at = (98, 2) if name == "embed" else tuple(0 for _ in value.shape)
        kept, step = value[at], 1e-5
        value[at] = kept + step
        up = loss()
        value[at] = kept - step
        down = loss()
        value[at] = kept
        assert abs((up - down) / (2 * step) - slopes[name][at]) < 1e-4, name


def test_windows_cover_every_byte():
    texts = [b"", b"x", b"y" * 256, bytes(range(256)) * 3 + b"end"]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    cut, owner = language.windows(np.frombuffer(b"".join(texts), np.uint8), at)
    assert owner.tolist() == [0, 1, 2, 3, 3, 3, 3] and cut[-1].tobytes().endswith(b"end")
    assert cut[3].tobytes() + cut[4].tobytes() == bytes(range(256)) * 2


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !", "de"), (None, "abc", None), (3, "the cat", "en"), (3, "the cat", "en")]
    got = language.identify(table(spark, rows)).collect()
    assert len(got) == 6 and sum(r["lang_pred"] == "und" for r in got) >= 3
    assert language.identify(table(spark, rows).limit(0)).collect() == []
    none = language.identify(table(spark, [(1, "abc", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in none] == [("und", 0.0)]


# -- toxicity --------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_matcher_equals_distances():
    rng = random.Random(4)
    terms = [("".join(rng.choice("abcd") for _ in range(rng.randrange(3, 12))), rng.random() < 0.3, round(rng.random(), 3)) for _ in range(40)]
    matcher = toxicity.Matcher(terms)
    for _ in range(1500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 13)))
        found = []
        for term, stem, weight in terms:
            ends = [word[:k] for k in range(len(word) + 1)] if stem else [word]
            edits = min((distance(e[1:], term[1:]) for e in ends if e[:1] == term[0]), default=99)
            if edits <= toxicity.allowed(term, stem):
                found.append(edits)
        hit = matcher.find(word)
        assert (hit is None) == (not found) and (hit is None or hit[0] == min(found)), (word, hit)


def test_finder_equals_whole_distances():
    rng = random.Random(4)
    for _ in range(4):
        terms = [("".join(rng.choice("abcd") for _ in range(rng.randrange(3, 12))), rng.random() < 0.3, round(rng.random(), 3)) for _ in range(40)]
        finder = toxicity.Finder(terms)
        for _ in range(1500):
            word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 13)))
            found = []
            for term, stem, weight in terms:
                ends = [word[:k] for k in range(len(word) + 1)] if stem else [word]
                edits = min(distance(e, term) for e in ends)
                if edits <= toxicity.allowed(term, stem):
                    found.append((edits, -weight))
            hit = finder.find(word)
            assert (hit is None) == (not found) and (hit is None or (hit[0], -hit[1]) == min(found)), (word, hit)


def test_disguised_first_letters():
    lexicon = toxicity.Lexicon([("worthless", False, 4.0), ("idiot", False, 3.0)])
    texts = pa.array(["you diot", "you 1diot", "you xidiot", "an orthless thing", "an 0rthless thing", "an xxworthless thing", "an rthless thing"])
    assert lexicon.features(texts)[:, 2].tolist() == [3, 3, 3, 4, 4, 4, 4]
    assert not lexicon.features(pa.array(["thless", "iot", "xxidiot"])).any()


def test_words_keep_their_edits_beside_a_beginning(spark):
    forms = ["worthless", "worthles", "worthlss", "worthlesss", "worthlessly"]
    rows = [(0, w, 60, 0) for w in forms] + [(0, f"plain{i}", 1, 60) for i in range(30)]
    counts = spark.createDataFrame(rows, "fold int, word string, t long, c long").drop("fold")
    terms = toxicity.choose_terms(counts, (300, 1800), 1500)
    assert "wort" in {t for t, stem, _ in terms if stem} and set(forms) <= {t for t, stem, _ in terms if not stem}
    assert any(stem and toxicity.allowed(t, True) for t, stem, _ in terms)
    texts = pa.array(["a wrothless one", "a wothless one", "a wrthlessly one", "an orthlessness"])
    assert (toxicity.Lexicon(terms).features(texts)[:, 2] > 0).all()


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = [r for r in rows if r["predicted"] == 1 and r["toxic"] == 1]
    assert len(right) >= 0.8 * sum(r["toxic"] for r in rows)
    assert len(right) >= 0.8 * sum(r["predicted"] for r in rows)


def test_quotation_and_misspelling():
    lexicon = toxicity.Lexicon([("worthless", False, 4.0)])
    texts = pa.array(["you worthless thing", 'he said "you worthless thing" then', "you worthles thing", "a plain text", None])
    seen = lexicon.features(texts)
    assert seen[0, 0] == 4 and seen[1, 0] < 0.1 and seen[1, 4] > 3.9
    assert seen[2, 0] == 0 and seen[2, 2] == 4 and not seen[3:].any()


def test_toxicity_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (2, "x " * 60_000, "en"), (None, "bad", "en")]
    labels = spark.createDataFrame([(1, 0, None), (2, 0, 1), (2, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, rows), labels, carry=True).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["row"]["row"] == "r" and got[0]["row"]["score"] == 0.5
    assert toxicity.toxicity(table(spark, rows).limit(0), labels).collect() == []
    assert len(toxicity.toxicity(table(spark, rows), labels.limit(0)).collect()) == 4


def test_no_text_without_a_match_is_flagged(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    for only in ("toxic = 1", "toxic = 0"):
        rows = toxicity.toxicity(docs, labels.where(only)).collect()
        assert rows and all(r["score"] <= 0.5 and r["hits"] == 0 for r in rows)
    # Most labelled texts are toxic, but no word marks them.
    plain = [(i, f"word{i} other{i} more{i}", "en") for i in range(60)]
    marks = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(60)], "doc_id long, toxic int")
    assert all(r["score"] <= 0.5 and r["predicted"] == 0 for r in toxicity.toxicity(table(spark, plain), marks).collect())


def test_texts_that_share_a_phrase_are_all_learned_from():
    texts = [f"you are a rotten{i} thing number {i} of many others here" for i in range(40)]
    copies = ["one two three four five six seven eight nine ten"] * 3
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(43)), pa.array([1] * 43), pa.array([*texts, *copies])], names=["doc_id", "toxic", "text"]
    )
    marks = [tuple(r[f"s{k}"] for k in range(4)) for b in toxicity._signatures([batch]) for r in b.to_pylist()]
    assert len(set(marks[:40])) == 40 and len(set(marks[40:])) == 1


def test_bounded_ids_are_those_of_the_least_hashes(spark):
    from pyspark.sql import functions as F

    ids = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    got = {(r["toxic"], r["doc_id"]) for r in toxicity._bounded(ids, {0: 5400, 1: 600}, 100).collect()}
    rows = ids.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").collect()
    want = {(t, r["doc_id"]) for t in (0, 1) for r in [r for r in rows if r["toxic"] == t][:100]}
    assert got == want


def test_any_white_space_parts_words():
    lexicon = toxicity.Lexicon([("worthless", False, 4.0)])
    lines = ["he", "said", '"hi"', *["and"] * 30, "you", "worthless", "thing"]
    for blank in (" ", "\n", "\t", "\r\n", "\u2003"):
        seen = lexicon.features(pa.array([blank.join(lines), blank.join(["worthless"] * 3)]))
        assert seen[0, 0] == 4 and seen[0, 4] == 0 and seen[1, 1] == 12 and seen[1, 5] == 3


# -- fingerprints ----------------------------------------------------------------


def test_fingerprints(spark):
    rng = random.Random(9)
    rows = [(i * 3, " ".join(rng.choice("one two three fôur\nfive six".split(" ")) for _ in range(rng.randrange(30))), "en") for i in range(60)]
    rows += [(1000, None, "x"), (None, "last one", "x"), (1000, "other", "x"), (1000, "other", "x"), (500, rows[4][1], "x")]
    got = {(r["doc_id"], r["n_chars"]): r for r in fingerprints.fingerprints(table(spark, rows)).collect()}
    assert len(got) == len(set((i, t) for i, t, _ in rows))
    ring = [(i, t or "") for i, t, _ in sorted({r for r in rows if r[0] not in (1000, None)}, key=lambda r: -r[0])]
    for (i, t), (_, after) in zip(ring, ring[1:], strict=False):
        r, k = got[i, len(t)], len(t) // 3
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
        f, e = r["fingerprint"], r["edited_fingerprint"]
        assert r["near_edited"] == 1 - bin((f ^ e) & (1 << 64) - 1).count("1") / 64
    by_text = {}
    for i, t, _ in rows:
        if i not in (1000, None):
            by_text.setdefault(t, set()).add(got[i, len(t)]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.fingerprints(table(spark, rows).limit(0)).collect() == []
    one = fingerprints.fingerprints(table(spark, [(7, "abc def", "x")])).collect()
    assert one[0]["near_next"] == 1 and one[0]["n_chars"] == 7


@pytest.mark.parametrize(("radius", "blocks"), [(3, 5), (2, 4), (0, 2)])
def test_within(spark, radius, blocks):
    rng = random.Random(6)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    for v in list(values):
        for bits in (1, 2, 3, 4):
            w = v & (1 << 64) - 1
            for b in rng.sample(range(64), bits):
                w ^= 1 << b
            values.append(w - (1 << 64) if w >> 63 else w)
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    asked = prints.limit(40)
    got = [(r[0], r[1]) for r in fingerprints.within(prints, asked, radius, blocks).collect()]
    want = {(a, b) for a in {r[0] for r in asked.collect()} for b in values if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}
    assert len(got) == len(set(got)) and set(got) == want


# -- shards and batches ----------------------------------------------------------


def test_shards_follow_weights_and_move_few(spark):
    docs = table(spark, [(i, "t", "x") for i in range(4000)] + [(None, None, "x"), (5, "t", "x")])
    rows = sharding.shard(docs, [1, 1, 2], added=1.0, ways=4).collect()
    counts = np.bincount([r["shard"] for r in rows], minlength=3)
    assert abs(counts[2] / 4000 - 0.5) < 0.04 and abs(counts[0] / 4000 - 0.25) < 0.04
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert all(r["grown_shard"] == 3 for r in moved) and abs(len(moved) / 4000 - 0.2) < 0.04
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert sharding.shard(docs.limit(0), [1, 1]).collect() == []


def test_boundaries_pad_least():
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 40), 8, replace=False))
        counts = rng.integers(1, 30, 8)

        def padding(ends):
            return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))

        best = min(padding((*c, lengths[-1])) for c in combinations(lengths[:-1], 2))
        ends = packing.boundaries(lengths, counts, 3)
        assert len(ends) == 3 and padding(ends) == best


def test_packing_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "w " * 5000, "x"), (3, "w " * 5000, "x"), (None, "a b", "x")]
    from pyspark.sql import functions as F

    got = packing.pack(table(spark, rows), packing.words(F.col("text")), ways=4).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 2, 904, 904, 2048, 2048, 2048, 2048]
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in got}) == len(got)
    assert packing.pack(table(spark, rows).limit(0), packing.words(F.col("text"))).collect() == []
