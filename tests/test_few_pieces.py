"""Features of few pieces are measured in one task each, with the rows of the path for any number."""

import random

import pyarrow as pa
import pytest

from cairnway import skew
from cairnway.operators import discovery, gaps

SCHEMA = "feature_id long, piece long, lon1 double, lat1 double, lon2 double, lat2 double, km double"


def made():
    rng = random.Random(11)
    rows = []
    for f in range(40):
        # Spots that coincide, nearly touch, stand apart and stand very far apart; rings and repeated pieces.
        spots = [(8 + rng.choice([0, 0.0002, 0.004, 0.3, 40]) * rng.random(), rng.choice([0.0, 46.0, -60.0]) + rng.random() * rng.choice([0.0001, 0.05, 3])) for _ in range(rng.choice([2, 5, 14]))]
        for p in range(rng.choice([1, 2, 6, 25])):
            a = rng.choice(spots)
            b = a if p % 7 == 3 else rng.choice(spots)
            rows.append((f, 2 * p, *a, *b, rng.choice([0.0, 0.5, 1.25, rng.random()])))
    rows += [(90, 0, None, 46.0, None, 46.0, 1.0), (90, 1, 8.0, 46.0, 8.1, 46.0, 1.0), (None, 0, 8.0, 46.0, 8.1, 46.0, 1.0)]
    return rows


def test_few_and_many_pieces_give_the_same(spark):
    pieces = spark.createDataFrame(made(), SCHEMA)
    many, few, both = (
        {r["feature_id"]: tuple(r)[1:] for r in discovery.continuity(pieces, few=n).collect()} for n in (0, 500, 5)
    )
    assert len(many) == 41 and {r[0] for r in many.values()} == {"connected", "gaps", "separate_pieces"}
    for other in (few, both):
        assert set(other) == set(many)
        for f, row in many.items():
            assert other[f] == pytest.approx(row, abs=1e-9), f


def test_few_pieces_need_no_scales(spark, monkeypatch):
    def no(*_):
        raise AssertionError("cells and scales are for features of many pieces")

    monkeypatch.setattr(discovery, "gap_tree", no)
    monkeypatch.setattr(discovery.graph, "components", no)
    assert discovery.continuity(spark.createDataFrame(made(), SCHEMA)).count() == 41


def test_pairs_are_looked_at_in_parts(monkeypatch):
    rows = sorted((r for r in made() if r[0] is not None), key=lambda r: r[:2])
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
    whole = pa.Table.from_batches(gaps.few_measured([batch])).to_pydict()
    monkeypatch.setattr(gaps, "PAIRS", 30)
    for size in (1, 7, 50):
        cut = [batch.slice(i, size) for i in range(0, batch.num_rows, size)]
        assert pa.Table.from_batches(gaps.few_measured(cut)).to_pydict() == whole
        assert sum(t.num_rows for t in skew.whole_groups(cut, "feature_id")) == batch.num_rows
