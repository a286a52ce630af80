"""The name join against scoring every pair, and what references need."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway.operators import names, similar

DROPPED = set(lx.GENERIC_TRAIL_WORDS + lx.SEARCH_STOPWORDS)


def sound(key):
    out = re.sub(r"([a-z])\1+", r"\1", key.replace(" ", ""))
    for a, b in (("ee", "i"), ("ie", "i"), ("aa", "a"), ("oo", "u"), ("ch", "c")):
        out = out.replace(a, b)
    return out


def plain_score(a, b):
    if a == b:
        return 100.0
    ca, cb = a.replace(" ", ""), b.replace(" ", "")
    if ca == cb:
        return 98.0
    if a in b or b in a:
        return 92.0
    best = 0.0
    wa, wb = ({w for w in x.split() if len(w) >= 2 and w not in DROPPED} for x in (a, b))
    if wa & wb:
        cover, jaccard = len(wa & wb) / min(len(wa), len(wb)), len(wa & wb) / len(wa | wb)
        best = max(82.0 * cover, 78.0 * jaccard)
        if len(wa) > 1 and len(wb) > 1 and cover < 0.75:
            best = min(best, 68.0)
    best = max(best, SequenceMatcher(None, ca, cb).ratio() * 84.0)
    pa, pb = sound(a), sound(b)
    if pa == pb:
        best = max(best, 90.0)
    elif pa in pb or pb in pa:
        best = max(best, 84.0)
    else:
        best = max(best, SequenceMatcher(None, pa, pb).ratio() * 86.0)
    return round(best, 2)


def made_names():
    rng = random.Random(8)
    base = ["anamudi", "anaimudi", "waterfall trail", "waterfalls trail", "chembra peak", "ana mudi", "a", "ab", "x", "hidden valley walk",
            "one two three four five six seven eight nine ten eleven twelve", "two one three four five six seven eight nine ten eleven",
            "the trail", "lake", "lakes", "oo", "u", "123", "the lake at the end of a very long name " * 6]
    words = ["ridge", "alpen", "rose", "kolu", "kku", "meesa", "puli", "see", "berg", "glen", "trail", "bridge", "am"]
    out = set(base)
    for _ in range(70):
        out.add(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))))
    for name in list(out):
        letters = list(name)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.choice([0, 1])] = rng.choice(["", "e", "s", " ", "oo"])
        out.add(" ".join("".join(letters).split()))
    return sorted(n for n in out if n)


@pytest.mark.parametrize("least", [75.0, 93.0])
def test_no_pair_is_lost(spark, least):
    every = made_names()
    a, b = every[::2], every[1::2]
    a += ["anamudi", "waterfall trail", "lake"]
    left = names.name_index(spark.createDataFrame([(i, n) for i, n in enumerate(a)], "l long, name string"), "l").cache()
    right = names.name_index(spark.createDataFrame([(i, n) for i, n in enumerate(b)], "r long, name string"), "r").cache()
    got = {(r["l"], r["r"]): r["score"] for r in names.matched_pairs(left, right, "l", "r", least).collect()}
    want = {(i, j): s for i, x in enumerate(a) for j, y in enumerate(b) if (s := plain_score(x.strip(), y.strip())) >= least}
    assert len(want) > 3 and got == want


def test_pairs_that_share_neither_word_nor_sound(spark):
    pairs = [("Anamudi", "Anaimudi", 80.27), ("Waterfall Trail", "Waterfalls Trail", 82.8)]
    for a, b, score in pairs:
        assert abs(plain_score(a.lower(), b.lower()) - score) < 0.6
        left = names.name_index(spark.createDataFrame([(1, a)], "l long, name string"), "l")
        right = names.name_index(spark.createDataFrame([(2, b)], "r long, name string"), "r")
        assert [tuple(r) for r in names.matched_pairs(left, right, "l", "r", 75.0).collect()] == [(1, 2, plain_score(a.lower(), b.lower()))]


def test_low_bounds_are_refused(spark):
    empty = names.name_index(spark.createDataFrame([], "l long, name string"), "l")
    with pytest.raises(ValueError, match="69"):
        similar.candidate_pairs(empty, empty, 60.0)
    assert similar.candidate_pairs(empty, empty, 75.0).collect() == []


def test_references_need_75_unless_their_source_says_so(spark):
    candidates = spark.createDataFrame([(i, 1, "n") for i in range(1, 6)], "candidate_id long, place_id long, name string")
    refs = spark.createDataFrame(
        [(1, "t1", 11, 74.0, 1.0, False), (2, "t2", 12, 75.0, 1.0, False), (3, "t3", 13, 0.0, 1.0, True)],
        "candidate_id long, trail_id string, osm_id long, score double, distance_km double, from_url boolean",
    )
    relations = spark.createDataFrame([(1, "t4", 14, 80.0, None), (4, "t5", 15, 77.9, 2.0)], "candidate_id long, trail_id string, osm_id long, score double, distance_km double")
    ways = spark.createDataFrame([(4, "t6", 16, 78.0, 3.0), (4, "t7", 17, 78.0, None)], relations.schema)
    got = {r["candidate_id"]: (r["trail_id"], r["method"], r["references_found"]) for r in names.resolve(candidates, refs, relations, ways).collect()}
    assert got == {
        1: ("t4", "named_route_relation", 0), 2: ("t2", "explicit_reference", 1), 3: ("t3", "explicit_reference", 1),
        4: ("t6", "named_way", 0), 5: (None, "unmapped", 0),
    }


def test_reference_scores(spark):
    refs = spark.createDataFrame([(1, "way", 7, "x"), (2, "way", 8, "y"), (3, "way", 9, "z")], "candidate_id long, osm_type string, osm_id long, trail_id string")
    left = spark.createDataFrame([(1, "anamudi"), (1, "lake"), (2, "lake")], "candidate_id long, name_key string")
    right = spark.createDataFrame([("way", 7, "anaimudi"), ("way", 8, "zzz"), ("relation", 9, "lake")], "osm_type string, osm_id long, name_key string")
    got = {r["candidate_id"]: r["score"] for r in names.reference_scores(refs, left, right).withColumn("score", F.round("score", 2)).collect()}
    assert got == {1: plain_score("anamudi", "anaimudi"), 2: plain_score("lake", "zzz"), 3: 0.0}
