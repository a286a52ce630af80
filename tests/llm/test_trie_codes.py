"""The prefix trie and the vector codes against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnway.llm import prefix_trie, vector_codes

EMPTY = hashlib.sha256(b"").hexdigest()
TURNS = "conv_id long, turn long, role string, text string, nx int, t1 string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def plain_trie(rows):
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            held.setdefault(c, []).append((turn, role or "", text or ""))

    def order(t):
        name = f"{len(t[1])}:{t[1]}{t[2]}".encode()
        return (t[0] is not None, t[0] or 0, hashlib.sha256(name).digest())

    own = {c: [t[1:] for t in sorted(ts, key=order)] for c, ts in held.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    out = []
    for path, cs in nodes.items():
        under = [q for q in nodes if q[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(path))
        out.append((
            min(cs), len(path), min(nodes[path[:-1]]) if path else None, len(cs), kids.get(path, 0),
            sum(q not in kids for q in under), sum((len(nodes[q]) - 1) * words(q[-1][1]) for q in under if q),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def trie_rows(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(-25, 90), 10**12]:
        if c % 7 == 3:
            continue
        for t in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 9, 17])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", " c", "d\te f", ""])))
    for c in range(200, 260):  # one very common conversation
        rows += [(c, t, "user", f"same {t}") for t in range(9)]
    rows += [(300, t, "user", f"long {t % 3}") for t in range(70)]
    rows += [(301, None, None, None), (301, 2, "user", "x"), (301, 2, "user", "x"), (301, 2, "b", "y" * 100_000), (None, 1, "user", "z")]
    return [(*r, 1, "t") for r in rows]


@pytest.mark.parametrize(("width", "bound"), [(8, None), (2, 5), (1, 4)])
def test_trie_equals_plain(spark, width, bound):
    rows = conversations()
    random.Random(width).shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert trie_rows(prefix_trie.conversation_trie(df, width, bound)) == plain_trie([r[:4] for r in rows])


def test_trie_small_cases(spark):
    assert trie_rows(prefix_trie.conversation_trie(spark.createDataFrame([], TURNS))) == []
    # crc32("22") % 4 is 2 and its base is absent, so nothing of two turns is left.
    assert zlib.crc32(b"22") % 4 == 2
    rows = [(22, 0, "user", "a", 1, "t"), (22, 1, "user", "b", 1, "t")]
    ends = hashlib.sha256(b"22").hexdigest()
    assert trie_rows(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == [(22, 0, None, 1, 0, 1, 0, ends)]


def test_large_groups_of_ends_are_hashed_in_pieces(spark):
    ids = spark.range(5000).select(F.lit(1).cast("long").alias("nx"), F.lit(2).cast("long").alias("ny"), F.col("id").alias("conv_id"))
    more = spark.createDataFrame([(1, 3, 7)], "nx long, ny long, conv_id long")
    got = prefix_trie.joined_digests(ids.union(more), ["nx", "ny"], "conv_id", 200).collect()
    whole = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert {(r["ny"], r["sha256"]) for r in got} == {(2, whole), (3, hashlib.sha256(b"7").hexdigest())}


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for n in (1, 3, 8, 64):
        top = vector_codes.largest_component(n)
        a, b = rng.integers(-top, top + 1, (50, n)), rng.integers(-top, top + 1, (n, 7))
        a[0], b[:, 0] = top, -top
        a[1] = -top
        want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b.T] for r in a]
        assert vector_codes.exact_product(a, b).tolist() == want
        at, far = vector_codes.nearest(a, b.T.copy())
        plain = [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, c, strict=True)) for c in b.T] for r in a]
        assert [min(r) for r in plain] == far.tolist()
        assert [r.index(min(r)) for r in plain] == at.tolist()
        sums = vector_codes.entry_sums(a, at, 7)
        for k in range(7):
            assert sums[k].tolist() == [*(int(v) for v in a[at == k].astype(object).sum(0) + np.zeros(n, object)), int((at == k).sum())]


def plain_codes(rows, parts, entries, rounds):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(4096 * x) for x in v], label))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))[:entries]
    n = len(kept[0][1]) // parts
    cut = lambda q, p: q[p * n : (p + 1) * n]
    books = [[cut(q, p) for _, q, _ in first] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    for k in range(rounds + 1):
        chosen = [[min((far(cut(q, p), e), j) for j, e in enumerate(books[p])) for p in range(parts)] for _, q, _ in kept]
        if k == rounds:
            break
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(q, p) for (_, q, _), c in zip(kept, chosen, strict=True) if c[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = {}
    for (_, _, label), c in zip(kept, chosen, strict=True):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in c)
    return sorted(
        ((i, "".join(f"{j:02x}" for _, j in c), sum(d for d, _ in c), errors[label], sha) for (i, _, label), c in zip(kept, chosen, strict=True)),
        key=repr,
    )


def test_codes_equal_plain(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(16)], rng.choice([None, 0, 1])) for i in range(120)]
    rows += [(5, [0.5] * 16, 1), (5, [0.5] * 16, 1), (None, [-3.0] * 16, 0)] + [(500 + i, [0.125] * 16, 2) for i in range(60)]
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 15, 1), (1002, [math.nan] * 16, 1), (1003, [math.inf] + [0.0] * 15, 1), (-4, [], 1)]
    rows = [r for r in rows if r[1] != []]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, label int, code int, q int").repartition(7)
    for parts, entries, rounds in ((8, 16, 6), (2, 5, 3), (1, 200, 1)):
        got = vector_codes.vector_codes(df, parts, entries, rounds)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows, parts, entries, rounds)


def test_codes_small_cases(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).collect() == []
    one = vector_codes.vector_codes(spark.createDataFrame([(3, [0.5] * 8, None)], schema)).collect()
    assert [tuple(r)[:4] for r in one] == [(3, "00" * 8, 0, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(spark.createDataFrame([(3, [0.5] * 9, None)], schema))
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(spark.createDataFrame([(3, [0.5] * 8, None), (4, [0.5] * 16, None)], schema))
    with pytest.raises(ValueError, match="exact"):
        vector_codes.vector_codes(spark.createDataFrame([(3, [1e9] * 8, None)], schema))
