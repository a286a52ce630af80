"""Removal of long repeated strings by suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnway.llm.common import Rolling, column_bytes, own_columns, slices, span_index, whole_groups
from cairnway.session import cut

#: Starts of strings looked at together in one document, so that a long one needs no more memory.
PART = 1 << 19
#: Bytes of stretches that one suffix array is built over.
BLOCK_BYTES = 3 << 19
_MARKS = pa.schema(
    [("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("key", pa.int64()),
     ("body", pa.int64()), ("again", pa.bool_())]
)
_BODIES = pa.schema(
    [("key", pa.int64()), ("deal", pa.int32()), ("deals", pa.int32()), ("body", pa.int64()), ("c", pa.int64()),
     ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary())]
)
_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("th", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("key", pa.int64()),
     ("deal", pa.int32()), ("open", pa.list_(pa.struct([("at", pa.int64()), ("h", pa.int64()), ("done", pa.bool_())])))]
)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every stretch of ``width`` values."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _marks(length: int, gram: int):
    """Stretches of string starts whose strings share their least ``gram`` hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=2 * PART):
            data, at = column_bytes(part.column("text"))
            columns = [[] for _ in range(6)]
            for begin, end in _portions(at, length):
                for out, values in zip(columns, _mark(data[begin:end], begin, at, length, gram), strict=True):
                    out.append(values)
            held = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            row = pa.array(held[0])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(row), part.column("th").take(row), pa.array(held[1]), pa.array(held[2]),
                 pa.array(held[3]), pa.array(held[4]), pa.array(held[5].astype(bool))],
                schema=_MARKS,
            )

    return run


def _portions(at: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of portions of the buffer.

    Portions are whole documents up to PART bytes, or parts of one document that overlap by
    what a string is longer than one byte."""
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] > PART:
            begin = int(at[i])
            while True:
                hi = min(begin + PART + length - 1, int(at[i + 1]))
                yield begin, hi
                if hi == at[i + 1]:
                    break
                begin += PART
            i += 1
        else:
            j = max(i + 1, int(np.searchsorted(at, at[i] + PART, "right")) - 1)
            yield int(at[i]), int(at[j])
            i = j


def _mark(data, begin, at, length, gram):
    """(document, first, last, key, body, again) of the stretches of one portion."""
    none = [np.zeros(0, np.int64)] * 6
    if len(data) < length:
        return none
    count = len(data) - length + 1
    rolling = Rolling(data)
    hashes = rolling.every(gram)
    least = sliding_least(hashes, length - gram + 1)
    doc = np.searchsorted(at, np.arange(begin, begin + count), "right") - 1
    valid = np.arange(begin, begin + count) + length <= at[doc + 1]
    new = np.ones(count, bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    back = np.zeros(count, bool)
    # The least hash stays although its place was left behind: it stands there more than once.
    back[1:] = ~new[1:] & (hashes[: count - 1] == least[1:])
    new |= np.concatenate([[True], valid[1:] != valid[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], count) - 1
    again = np.logical_or.reduceat(back, first)
    keep = valid[first]
    first, last, again = first[keep], last[keep], again[keep]
    if not len(first):
        return none
    second = Rolling(data, 1)
    body = second.stretch(first, last + length) ^ (last - first).astype(np.uint64)
    owner = doc[first]
    shift = begin - at[owner]
    return owner, first + shift, last + shift, least[first].view(np.int64), body.view(np.int64), again


def _bodies(length: int):
    """The bytes of asked stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text, doc_id, th, asked in zip(*(part.column(c) for c in ("text", "doc_id", "th", "asked")), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for a in asked.as_py():
                    rows.append((a["key"], a["deal"], a["deals"], a["body"], a["c"], doc_id.as_py(), th.as_py(), a["first"],
                                 data[a["first"] : a["last"] + length]))
                    if len(rows) >= 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BODIES.types, strict=True)], schema=_BODIES)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BODIES.types, strict=True)], schema=_BODIES)

    return run


def two_stage_order(text: np.ndarray, need: np.ndarray, names: np.ndarray, limit: int) -> np.ndarray:
    """Positions marked in ``need`` in the order of the strings that start there.

    ``text`` has letters from 1 and a 0 after each stretch; ``names`` are equal where the next
    ``limit`` letters are, 0 where fewer are left. A suffix is small if it is below the one
    after it. Only the small ones are sorted directly. The others are induced: scanning the
    order from the lowest letter on, the suffix one letter longer than the scanned one goes
    next in its letter's bucket, ahead of the small ones there.
    """
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(np.diff(text.astype(np.int32)))
    place = np.where(step != 0, np.arange(n), n - 1)
    small = step[np.minimum.accumulate(place[::-1])[::-1]] > 0
    end = text == 0
    large = need & ~small & ~end
    direct = _sorted_directly(text, np.flatnonzero(need & small & ~end), names, limit)
    firsts = text[direct]
    small_of = np.searchsorted(firsts, np.arange(258))
    buckets: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[large[before]]
        if len(before):
            letters = text[before]
            order = np.argsort(letters, kind="stable")
            before, letters = before[order], letters[order]
            cuts = np.flatnonzero(np.diff(letters, prepend=-1, append=-1))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                buckets[letters[i]].append(before[i:j])

    induce(np.flatnonzero(need & end))
    for letter in range(1, 257):
        while buckets[letter]:
            scanned = np.concatenate(buckets[letter])
            buckets[letter] = []
            out.append(scanned)
            induce(scanned)
        scanned = direct[small_of[letter] : small_of[letter + 1]]
        if len(scanned):
            out.append(scanned)
            induce(scanned)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sorted_directly(text: np.ndarray, items: np.ndarray, names: np.ndarray, limit: int) -> np.ndarray:
    """Sort suffixes seven letters at a time; equal strings are sorted as one."""
    if not len(items):
        return items
    alike = names[items]
    own = np.where(alike == 0, ~items.astype(np.uint64), alike)
    _, chosen, member = np.unique(own, return_index=True, return_inverse=True)
    padded = np.zeros(len(text) + limit + 16, np.int64)
    padded[: len(text)] = text
    keys = np.zeros(len(text) + limit + 8, np.int64)
    for k in range(7):
        keys = (keys << 9) | padded[k : k + len(keys)]
    heads = items[chosen]
    order = np.argsort(keys[heads], kind="stable")
    value = keys[heads[order]]
    new = np.ones(len(order), bool)
    new[1:] = value[1:] != value[:-1]
    for depth in range(7, limit, 7):
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(new)[where]
        value = keys[heads[order[where]] + depth]
        again = np.lexsort((value, group))
        order[where] = order[where][again]
        value, group = value[again], group[again]
        new[where[1:]] |= (value[1:] != value[:-1]) & (group[1:] == group[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return items[np.argsort(rank[member], kind="stable")]


def common_prefix_reaches(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the bytes from a and from b agree for ``length`` bytes."""
    same = np.zeros(len(a), bool)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    for i in range(0, len(a), 8192):
        same[i : i + 8192] = (windows[a[i : i + 8192]] == windows[b[i : i + 8192]]).all(1)
    return same


def repeated(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the bodies, is a string start, its string is there again, name of the string)."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begin = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    text = data.astype(np.uint16) + 1
    text[begin + sizes] = 0
    strings = np.zeros(len(data), bool)
    strings[span_index(begin, sizes - length + 1)] = True
    names = np.zeros(len(data), np.uint64)
    names[: len(data) - length + 1] = Rolling(data).every(length) | np.uint64(1)
    names[~strings] = 0
    # What a string start is induced from stands after it, as far as suffixes still fall.
    need = strings.copy()
    step = np.sign(np.diff(text.astype(np.int32), append=0))
    place = np.where(step != 0, np.arange(len(data)), len(data) - 1)
    rising = step[np.minimum.accumulate(place[::-1])[::-1]] > 0
    stop = np.where(rising | (text == 0), np.arange(len(data)), len(data))
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    final = begin + sizes - length
    need[span_index(final, stop[final] - final + 1)] = True
    order = two_stage_order(text, need, names, length)
    order = order[strings[order]]
    a, b = order[:-1], order[1:]
    alike = names[a] == names[b]
    a, b = a[alike], b[alike]
    alike = common_prefix_reaches(data, a, b, length)
    there = np.zeros(len(data), bool)
    there[a[alike]] = True
    there[b[alike]] = True
    return begin, strings, there, names


def _resolve(length: int):
    """Stretches whose strings stand more than once in a block of their group.

    For groups dealt into several blocks also the different strings of every stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "deal"], 4000, "bytes", BLOCK_BYTES):
            table = table.combine_chunks()
            bodies = table.column("bytes").to_pylist()
            begin, strings, there, names = repeated(bodies, length)
            first, c, deals = (table.column(k).to_numpy() for k in ("first", "c", "deals"))
            rows, starts, ends, wide, places, hashes, done = [], [], [], [], [], [], []
            for i, at in enumerate(begin):
                count = len(bodies[i]) - length + 1
                hit = there[at : at + count]
                if c[i] == 1 and hit.any():
                    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                    rows += [i] * (len(edge) // 2)
                    starts.append(first[i] + edge[::2])
                    ends.append(first[i] + edge[1::2] - 1 + length)
                if deals[i] > 1:
                    named = names[at : at + count].view(np.int64)
                    held = np.unique(named, return_index=True)[1]
                    wide.append(i)
                    places.append(first[i] + held)
                    hashes.append(named[held])
                    done.append(hit[held] | (c[i] > 1))
            if rows:
                own = table.select(["doc_id", "th"]).take(pa.array(rows))
                none = [pa.nulls(len(rows), t) for t in _FOUND.types[4:]]
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(k).combine_chunks() for k in range(2)), pa.array(np.concatenate(starts)),
                     pa.array(np.concatenate(ends)), *none],
                    schema=_FOUND,
                )
            if wide:
                own = table.select(["doc_id", "th", "key", "deal"]).take(pa.array(wide))
                at = np.concatenate([[0], np.cumsum([len(x) for x in places])])
                open_ = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(places)), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(done))],
                    names=["at", "h", "done"],
                )
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).combine_chunks(), own.column(1).combine_chunks(), pa.nulls(len(wide), pa.int64()),
                     pa.nulls(len(wide), pa.int64()), own.column(2).combine_chunks(), own.column(3).combine_chunks(),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), open_)],
                    schema=_FOUND,
                )

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text; further columns pass as they are."""
    for part in slices(batches):
        sizes, spans, kept = [], [], []
        data, at = column_bytes(part.column("text"))
        held = part.column("held").to_pylist()
        for i, pieces in enumerate(held):
            text = data[at[i] : at[i + 1]]
            sizes.append(len(text))
            runs: list[list[int]] = []
            for p in sorted((p["from"], p["to"]) for p in pieces or []):
                if runs and p[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], p[1])
                else:
                    runs.append([*p])
            rest, last = [], 0
            for a, b in runs:
                rest.append(text[last:a].tobytes())
                last = b
            kept.append(b"".join([*rest, text[last:].tobytes()]))
            spans.append([{"from": a, "to": b} for a, b in runs])
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("row"), pa.array(sizes, pa.int64()), pa.array(spans, kind),
             pa.array(kept, pa.binary())],
            names=["doc_id", "row", "n_bytes", "spans", "kept"],
        )


def suffix_dedup(
    docs: DataFrame,
    length: int = 400,
    gram: int = 100,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, row, n_bytes, spans, kept) of every row; ``spans`` are cut out, ``kept`` is the
    rest, ``row`` a struct of the columns other than the text.

    A byte goes when a string of ``length`` bytes over it starts anywhere else too, in any
    document. Every such string has one least hash among its ``gram``-byte substrings, so
    equal strings share it wherever they stand. Starts in a row with the same least hash form
    a stretch, and stretches meet by that hash:

    * a hash that occurs once has no repeated string;
    * stretches equal in full (copies, the inside of passages) are counted without their bytes;
    * one copy each of stretches that differ, but share the hash, is brought together with
      its bytes. There a suffix array by two-stage sorting puts equal strings next to each other,
      and their common prefixes decide. A group of more than ``block_bytes`` is dealt into
      several arrays, and strings alone in theirs are then compared between the arrays.

    Null and short texts lose nothing. Repeated rows and rows with the same text are copies
    and lose all of a text of ``length`` bytes or more. Spans are byte offsets. Rows are
    told apart by id and hash of the text. A null id is kept. An empty table gives no rows.
    """
    own = own_columns(docs, id_col, text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text")
    )
    lowest = F.lit(-(1 << 63))
    keyed = own.withColumn("doc", F.coalesce("doc_id", lowest))
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), lowest).alias("doc"),
        F.xxhash64(text).alias("th"), F.coalesce(text, F.lit("")).alias("text"),
        F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row"),
    )
    marks = own.where(F.octet_length("text") >= length).mapInArrow(
        _marks(length, gram), "doc_id long, th long, first long, last long, key long, body long, again boolean"
    ).withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).drop("doc_id")
    shared = cut(
        marks.groupBy("key").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("k")).where("k > 1").select("key")
    )
    held = cut(marks.join(shared, "key"))
    bodies = held.groupBy("key", "body").agg(
        F.count(F.lit(1)).alias("c"), F.max("again").alias("again"),
        F.min(F.struct("doc", "th", "first", "last")).alias("at"),
    )
    bodies = cut(bodies)
    groups = bodies.groupBy("key").agg(
        F.count(F.lit(1)).alias("kinds"), F.max("again").alias("loops"),
        F.sum(F.col("at.last") - F.col("at.first") + length).alias("size"),
    ).where("kinds > 1 or loops")
    whole = held.join(bodies.where("c > 1").select("key", "body"), ["key", "body"]).select(
        "doc", "th", F.col("first").alias("from"), (F.col("last") + length).alias("to")
    )
    deals = F.ceil(F.col("size") / block_bytes).cast("int")
    asked = bodies.join(groups, "key").select(
        F.col("at.doc").alias("doc"), F.col("at.th").alias("th"),
        F.struct(
            "key", F.pmod(F.xxhash64("body"), deals).cast("int").alias("deal"), deals.alias("deals"), "body", "c",
            F.col("at.first").alias("first"), F.col("at.last").alias("last"),
        ).alias("a"),
    ).groupBy("doc", "th").agg(F.collect_list("a").alias("asked"))
    brought = (
        keyed.join(asked, ["doc", "th"])
        .select("text", F.col("doc").alias("doc_id"), "th", "asked")
        .mapInArrow(
            _bodies(length),
            "key long, deal int, deals int, body long, c long, doc_id long, th long, first long, bytes binary",
        )
        .repartition("key", "deal")
        .sortWithinPartitions("key", "deal", "body", "doc_id", "first")
    )
    found = cut(
        brought.mapInArrow(
            _resolve(length),
            "doc_id long, th long, from long, to long, key long, deal int, open array<struct<at: long, h: long, done: boolean>>",
        )
    )
    open_ = found.where("open is not null").select(
        F.col("doc_id").alias("doc"), "th", "key", "deal", F.explode("open").alias("o")
    ).select("doc", "th", "key", "deal", "o.*")
    between = open_.groupBy("key", "h").agg(F.countDistinct("deal").alias("k")).where("k > 1").select("key", "h")
    across = open_.where("not done").join(between, ["key", "h"]).select(
        "doc", "th", F.col("at").alias("from"), (F.col("at") + length).alias("to")
    )
    near = found.where("open is null").select(F.col("doc_id").alias("doc"), "th", "from", "to")
    spans = whole.unionByName(near).unionByName(across).groupBy("doc", "th").agg(
        F.collect_list(F.struct("from", "to")).alias("held")
    )
    schema = StructType().add("doc_id", "long").add("row", rows.schema["row"].dataType)
    for field in StructType.fromDDL("n_bytes long, spans array<struct<from: long, to: long>>, kept binary"):
        schema.add(field)
    return rows.join(spans, ["doc", "th"], "left").select("doc_id", "row", "text", "held").mapInArrow(_cut_out, schema)
