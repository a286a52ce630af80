"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at a time; one longer text stands alone.
SLICE_BYTES = 2 << 20


def own_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text), so that further columns, whatever their names, never clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def spread(columns: list[Column], ways: int) -> Column:
    """A bucket from 0 to ways-1 by MD5, which SQL engines agree on; null counts as empty."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("int") % ways


def gapless(
    df: DataFrame, groups: list[str], order: list[str], name: str, ways: int = 256
) -> DataFrame:
    """Number the rows of each group from 0 without gaps, also when a group holds most rows.

    A group is dealt by the hash of ``order`` into ``ways`` parts. Each part is numbered in
    the order of ``order``, after all rows of the parts before it, whose counts come from a
    partial aggregate (at most groups x ways rows). Counts and numbering share one
    partitioning, so the rows move once.
    """
    keys = [*groups, "_part"]
    dealt = df.withColumn("_part", spread([F.col(c) for c in order], ways))
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    placed = dealt.withColumn("_row", F.row_number().over(inside)).join(offsets, keys)
    return placed.withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long")).drop(
        "_part", "_row", "_before"
    )


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary array; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``most`` bytes of a column, or one row."""
    for batch in batches:
        _, at = column_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def span_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many spans one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


class Pieces:
    """The texts of a slice cut at single spaces, or at all white space, each different piece
    held once.

    ``unique`` are the different pieces, ``index`` names one for every place, ``ends`` is the
    number of places up to the end of each text.
    """

    def __init__(self, column: pa.Array, all_white: bool = False):
        column = pc.fill_null(column, "") if column.null_count else column
        cut = pc.utf8_split_whitespace(column) if all_white else pc.split_pattern(column, " ")
        held = cut.flatten().dictionary_encode()
        self.dictionary: pa.Array = held.dictionary
        self.index = held.indices.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        self.ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64))
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends

    @cached_property
    def unique(self) -> list[str]:
        return self.dictionary.to_pylist()

    def expand(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All values (32-bit integers) in the order of the places, and how many there are up to
        each text's end."""
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        pool = np.frombuffer(b"".join(values), np.uint32)
        return self.spans(pool, np.cumsum(size) - size, size)

    def spans(self, pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from one pool, where each different piece has its span."""
        each = size[self.index]
        ends = np.concatenate([[0], np.cumsum(each)])[self.ends]
        return pool[span_index(first[self.index], each)], ends


class Cache:
    """Results by text in a worker process, emptied when ``most`` are held."""

    def __init__(self, most: int = 300_000):
        self.most, self.held = most, {}

    def all(self, keys: list[str], missing: Callable[[list[str]], list]) -> list:
        held = self.held
        new = [k for k in keys if k not in held]
        if new:
            if len(held) + len(new) > self.most:
                held.clear()
                new = list(keys)
            held.update(zip(new, missing(new), strict=True))
        return [held[k] for k in keys]


class PieceIds:
    """32-bit ids of pieces in a worker process, held and looked up as arrays; emptied when
    ``most`` pieces are held."""

    def __init__(self, most: int = 500_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.values, self.pool = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, pieces: pa.Array, missing: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``pool`` the ids of each of the different pieces begin, and how many there are."""
        at = pc.index_in(pieces, value_set=self.values)
        if at.null_count:
            new = pieces.filter(pc.is_null(at))
            if len(self.values) + len(new) > self.most:
                self.clear()
                new = pieces
            ids = missing(new.to_pylist())
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), np.uint32)])
            self.values = pa.concat_arrays([self.values, new.cast(pa.string())])
            at = pc.index_in(pieces, value_set=self.values)
        at = at.to_numpy(zero_copy_only=False)
        return self.first[at], self.size[at]


def whole_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str], rows: int, column: str | None = None, size: int = 0
) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``, about ``rows`` rows (or ``size``
    bytes of a binary column) each; only a larger group makes a larger table."""
    held: list[pa.RecordBatch] = []
    count = weight = 0
    cut = slices(batches, column, max(1, size // 2)) if column else batches
    parts = (b.slice(i, rows) for b in cut for i in range(0, b.num_rows, rows))
    for batch in parts:
        held.append(batch)
        count += batch.num_rows
        weight += int(column_bytes(batch.column(column))[1][-1]) if column else 0
        if count < rows and (not column or weight < size):
            continue
        table = pa.Table.from_batches(held)
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            values = table.column(k).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        marks = np.flatnonzero(change)
        if len(marks):
            yield table.slice(0, marks[-1])
            held = table.slice(marks[-1]).combine_chunks().to_batches()
            count = sum(b.num_rows for b in held)
            weight = sum(int(column_bytes(b.column(column))[1][-1]) for b in held) if column else 0
    if held:
        yield pa.Table.from_batches(held)


#: Fixed random values of the 256 bytes and fixed odd factors of the rolling hashes.
_RANDOM = np.random.default_rng(20240607)
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place where the array is ours)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, which: int, inverse: bool) -> np.ndarray:
    key = which * 2 + inverse
    if key not in _POWERS or len(_POWERS[key]) < n:
        factor = int(FACTORS[which])
        if inverse:
            factor = pow(factor, -1, 1 << 64)
        size = 1 << max(20, (n - 1).bit_length())
        powers = np.full(size, factor, np.uint64)
        powers[0] = 1
        _POWERS[key] = np.multiply.accumulate(powers)
    return _POWERS[key][:n]


class Rolling:
    """Hashes of any stretch of a byte buffer, the same wherever the stretch stands."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.which = which
        terms = BYTE_VALUES[which][data]
        terms *= _powers(len(data), which, False)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def stretch(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        whole = self.sums[ends] - self.sums[starts]
        whole *= _powers(len(self.sums), self.which, True)[starts]
        return mix(whole)

    def every(self, length: int) -> np.ndarray:
        """Of all stretches of one length."""
        whole = self.sums[length:] - self.sums[:-length]
        whole *= _powers(len(whole), self.which, True)
        return mix(whole)


WORD = re.compile(r"[^\W_]+")
