"""Token pieces in as few sequences as can be: exact complements first, best fit for the rest."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnway.llm.common import own_columns, slices
from cairnway.llm.token_files import ENCODE_BYTES, loaded
from cairnway.session import scratch

_PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, rank long"


class Complements:
    """Which lengths, pairs and triples of lengths add up to a gap, under how many are left.

    ``pairs[s]`` is the number of pairs of available lengths with the sum s. A triple of sum s
    is a length a whose rest s - a is the sum of a pair. Both indexes follow the counts: a
    length that runs out takes its pairs away.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.size = len(counts) - 1
        self.pairs = np.zeros(2 * self.size + 1, np.int64)
        here = np.flatnonzero(self.left)
        for a in here:
            self.pairs[a + here[here > a]] += 1
            self.pairs[2 * a] += self.left[a] > 1

    def take(self, length: int, number: int) -> None:
        before = int(self.left[length])
        after = before - number
        self.left[length] = after
        if before > 1 >= after:
            self.pairs[2 * length] -= 1
        if before and not after:
            others = np.flatnonzero(self.left)
            self.pairs[length + others] -= 1

    def give(self, length: int, number: int) -> None:
        before = int(self.left[length])
        if number and not before:
            self.pairs[length + np.flatnonzero(self.left)] += 1
        if before < 2 <= before + number:
            self.pairs[2 * length] += 1
        self.left[length] = before + number

    def pair(self, gap: int, most: int) -> tuple[int, int] | None:
        """(a, b) with a + b = gap and most >= a >= b, of the greatest a."""
        if gap < 2 or not self.pairs[gap]:
            return None
        low, high = (gap + 1) // 2, min(most, gap - 1, self.size)
        a = np.arange(low, high + 1)
        found = a[(self.left[low : high + 1] > 0) & (self.left[gap - a] > (a * 2 == gap))]
        return (int(found[-1]), gap - int(found[-1])) if len(found) else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths left that fill the gap exactly, the fewest and greatest first."""
        if gap <= self.size and self.left[gap]:
            return (gap,)
        if pair := self.pair(gap, gap):
            return pair
        low, high = (gap + 2) // 3, min(gap - 2, self.size)
        a = np.arange(low, high + 1)
        for first in a[(self.left[low : high + 1] > 0) & (self.pairs[gap - a] > 0)][::-1].tolist():
            self.take(first, 1)
            pair = self.pair(gap - first, first)
            self.give(first, 1)
            if pair:
                return (first, *pair)
        return None

    def best(self, gap: int) -> int:
        """The greatest length left that fits, or 0."""
        fits = np.flatnonzero(self.left[1 : min(gap, self.size) + 1])
        return int(fits[-1]) + 1 if len(fits) else 0


def patterns(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how often, [(length, copies)]) for all of ``counts[length]`` pieces; the last index is
    the size of a sequence.

    A sequence opens with the longest piece left. What fills its gap exactly is taken from the
    index; where nothing does, the best fitting piece goes in and the index is asked for the rest
    of the gap. The finished pattern is used as often as its lengths are left, so the work
    depends on the number of different lengths and not on the number of pieces.
    """
    index, out = Complements(counts), []
    while opener := index.best(index.size):
        used = [opener]
        index.take(opener, 1)
        gap = index.size - opener
        while gap:
            filled = index.exact(gap) or ((fit,) if (fit := index.best(gap)) else None)
            if filled is None:
                break
            for length in filled:
                index.take(length, 1)
                gap -= length
            used += filled
        copies: dict[int, int] = {}
        for length in used:
            copies[length] = copies.get(length, 0) + 1
        more = min(int(index.left[length]) // n for length, n in copies.items())
        for length, n in copies.items():
            index.take(length, n * more)
        out.append((more + 1, list(copies.items())))
    return out


@dataclass
class Places:
    """Where the pieces of each length go, in the order of their ranks: intervals of ranks.

    All pieces stand in one row by (length, rank); interval i begins at ``begin[i]`` in it and
    holds ``copies[i]`` pieces of its length for each sequence from ``sequence[i]`` on, the first
    of them at ``offset[i]``. At most a few intervals for each pattern.
    """

    first: np.ndarray
    begin: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    copies: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Places:
        first = np.cumsum(counts) - counts
        at, rows, sequence = first.copy(), [], 0
        for often, parts in patterns(counts):
            offset = 0
            for length, copies in parts:
                rows.append((int(at[length]), sequence, offset, copies))
                at[length] += often * copies
                offset += length * copies
            sequence += often
        columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
        return cls(first, *columns)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        at = self.first[length] + rank
        i = np.searchsorted(self.begin, at, "right") - 1
        j = at - self.begin[i]
        return self.sequence[i] + j // self.copies[i], self.offset[i] + j % self.copies[i] * length


def token_pieces(
    docs: DataFrame, definition: str, max_len: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, rank), written to the shared folder and read back.

    A document's ids and then ``end_id`` are cut into pieces of ``max_len`` and a rest; ids are
    little-endian unsigned 32-bit integers. ``rank`` counts the pieces of one length within a
    task, ``part``, so that ranks over all tasks need sums of counts only. A document without any
    id is one piece of length 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    step = 4 * max_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = loaded(shared.value, True), TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        for batch in slices(batches, most=ENCODE_BYTES):
            ids, ends = encoder.encode(batch.column("text"))
            raw, begin, rows = ids.astype("<u4", copy=False).tobytes(), 0, []
            for doc_id, end in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                own = raw[4 * begin : 4 * end] + tail
                begin = end
                rows += [(doc_id, i, own[at : at + step]) for i, at in enumerate(range(0, max(len(own), 1), step))]
            length = np.array([len(r[2]) // 4 for r in rows], np.int64)
            order = np.argsort(length, kind="stable")
            sizes = np.bincount(length, minlength=max_len + 1)
            rank = np.empty(len(rows), np.int64)
            rank[order] = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rank += seen[length]
            seen += sizes
            piece = np.array([r[1] for r in rows], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array(piece), pa.array(piece.astype(np.int64) * max_len), pa.array(length),
                 pa.array([r[2] for r in rows], pa.binary()), pa.array(np.full(len(rows), part, np.int32)), pa.array(rank)],
                names=[c.split()[0] for c in _PIECES.split(", ")],
            )

    own = own_columns(docs, id_col, text_col).selectExpr("cast(doc_id as long) doc_id", "text")
    place = scratch(docs.sparkSession, "token-pieces")
    own.mapInArrow(run, _PIECES).write.option("compression", "zstd").parquet(place)
    return docs.sparkSession.read.schema(_PIECES).parquet(place)


def place(pieces: DataFrame, max_len: int = 2048, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """``pieces`` with (sequence_id, offset) and what ``keep`` makes of them, by default the ids.

    The histogram of the lengths, ``max_len`` + 1 counts, is all that the driver sees. Rank within
    a length is the rank in the task after the counts of the tasks before it.
    """
    counts = np.zeros(max_len + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    empty = int(counts[0])
    counts[0] = 0
    places = Places.of(counts)
    sequences = int((places.sequence + 1).max(initial=0)) if empty else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.full(len(length), sequences), np.zeros(len(length), np.int64)
            some = np.flatnonzero(length > 0)
            if len(some):
                sequence[some], offset[some] = places.find(length[some], rank[some])
            table = pa.Table.from_batches([batch]).drop_columns(["rank"])
            yield from table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    kept = {"ids": F.col("ids")} if keep is None else keep
    ranked = pieces.select("doc_id", "piece", "start", "length", "part", "rank", *[c.alias(n) for n, c in kept.items()]).join(
        ahead, ["part", "length"]
    ).select("doc_id", "piece", "start", "length", (F.col("rank") + F.col("ahead")).alias("rank"), *kept)
    schema = StructType([f for f in ranked.schema.fields if f.name != "rank"]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def best_fit(
    docs: DataFrame,
    definition: str,
    max_len: int = 2048,
    end_id: int | None = 0,
    keep: Mapping[str, Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): all documents in sequences of at
    most ``max_len`` ids.

    Null texts are empty: only the end id. Without an end id they have one piece of length 0, all
    in one sequence of their own. Rows that repeat an id are packed each, a null id is kept, an
    empty table gives no rows. Pieces of one length, whatever their share, are numbered by task.
    """
    return place(token_pieces(docs, definition, max_len, end_id, id_col, text_col), max_len, keep)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids): the sequences themselves, each from the few pieces it holds."""
    held = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    whole = F.unhex(F.array_join(F.transform(held, lambda p: p["h"]), ""))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), whole.alias("ids"))
