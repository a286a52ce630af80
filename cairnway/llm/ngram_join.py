"""Similarity join of word n-gram sets by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnway.llm.common import Rolling, column_bytes, mix, own_columns, slices, span_index, whole_groups
from cairnway.operators.graph import components
from cairnway.session import cut

#: Tokens of a set that paths choose from: the least hash in each of so many ranges.
TOKENS = 64
#: Rows of a bucket that are compared by brute force; larger buckets are split, and what
#: splitting cannot part is compared block by block.
BLOCK = 2048
#: Pairs looked at together in a task.
PAIRS = 100_000
_WORD_BYTES = np.array([chr(b).isalnum() or b >= 0x80 for b in range(128)] + [True] * 128)
_SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
     ("sketch", pa.binary())]
)


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of the different n-grams, sorted, and how many each text has.

    A word is a run of ASCII letters, digits and other-than-ASCII characters of the text in
    lower case. A text of fewer than ``words`` words has one n-gram of all of them.
    """
    lower = pc.utf8_lower(pc.fill_null(column, "") if column.null_count else column)
    data, at = column_bytes(lower)
    count = len(at) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(count, np.int64)
    inside = _WORD_BYTES[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(at))
    first[at[filled]] = inside[at[filled]]
    last[at[filled + 1] - 1] = inside[at[filled + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = Rolling(data).stretch(starts, ends)
    held = np.diff(np.searchsorted(starts, at))
    begin = np.cumsum(held) - held
    made = np.where(held >= words, held - words + 1, np.minimum(held, 1))
    owner = np.repeat(np.arange(count), made)
    where = span_index(begin, made)
    left = np.repeat(begin + held, made)
    grams = np.zeros(len(where), np.uint64)
    for k in range(words):
        there = np.minimum(where + k, len(hashes) - 1)
        step = hashes[there] * np.uint64(2 * k * 0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        grams += np.where(where + k < left, mix(step), np.uint64(0))
    grams = mix(grams)
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    owner, grams = owner[new], grams[new]
    return owner, grams, np.bincount(owner, minlength=count)


def sketches(owner: np.ndarray, grams: np.ndarray, count: int) -> np.ndarray:
    """One token for each of 64 hash ranges: the least hash there, else that of the next range
    that has one, marked with its distance. Two sets agree in a token about as often as they
    share elements."""
    least = np.full((count, TOKENS), -1, np.int64)
    ranges = (grams >> np.uint64(58)).astype(np.int64)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (ranges[1:] != ranges[:-1])
    least[owner[new], ranges[new]] = ((grams[new] >> np.uint64(26)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    open_rows = np.flatnonzero((least < 0).any(1) & (least >= 0).any(1))
    source = least[open_rows]
    filled = source.copy()
    for step in range(1, TOKENS):
        empty = filled < 0
        if not empty.any():
            break
        moved = np.roll(source, -step, axis=1)
        filled = np.where(empty & (moved >= 0), (moved + step * 0x9E3779B1) & 0xFFFFFFFF, filled)
    least[open_rows] = filled
    return least.astype("<u4")


def _sketched(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            owner, grams, n = shingles(part.column("text"), words)
            tokens = sketches(owner, grams, len(n))
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                terms = np.zeros(len(grams) + 1, np.uint64)
                np.cumsum(mix(grams ^ np.uint64(salt)), out=terms[1:])
                ends = np.cumsum(n)
                sums.append((terms[ends] - terms[ends - n]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("th"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]),
                 pa.array([t.tobytes() for t in tokens], pa.binary())],
                schema=_SKETCH,
            )

    return run


def runs_needed(threshold: float, recall: float, picks: int, depth: int) -> int:
    """Independent runs until a pair at the threshold is found with the target probability.

    On each level a pair stays together on one of ``picks`` chosen tokens unless it differs
    on all that lead on.
    """
    found = 1.0
    for _ in range(depth):
        found = 1 - (1 - threshold * found) ** picks
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def chosen_paths(sets: DataFrame, threshold: float, recall: float, picks: int, depth: int, block: int) -> DataFrame:
    """(node, size, cid): the buckets that the sets end in.

    From the root, and then in each bucket of more than ``block`` sets, ``picks`` tokens are
    chosen and a set follows those with its own value there. Buckets of one set end at once,
    small ones are leaves, and the rest go on for at most ``depth`` levels.
    """
    runs = runs_needed(threshold, recall, picks, depth)
    roots = np.random.default_rng(11).permutation(TOKENS)[: runs * picks]
    at = F.explode(F.array(*[F.lit(int(i)) for i in roots]))
    token = F.substring("sketch", F.col("at") * 4 + 1, F.lit(4))
    level = sets.select("cid", "sketch", at.alias("at")).select("cid", F.xxhash64("at", token).alias("node"))
    leaves = None
    for k in range(1, depth + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        held = cut(level.join(cut(sizes), "node"))
        last = k == depth
        done = held if last else held.where(F.col("size") <= block)
        leaves = done if leaves is None else leaves.unionByName(done)
        if last or held.where(F.col("size") > block).isEmpty():
            break
        choice = F.explode(F.array(*[F.pmod(F.xxhash64("node", F.lit(t)), F.lit(TOKENS)).cast("int") for t in range(picks)]))
        wide = held.where(F.col("size") > block).select("node", "cid", choice.alias("at")).distinct()
        level = wide.join(sets.select("cid", "sketch"), "cid").select(
            "cid", F.xxhash64("node", "at", token).alias("node")
        )
    return leaves.select("node", "size", "cid").distinct()


def ngram_join(
    docs: DataFrame,
    threshold: float = 0.8,
    words: int = 5,
    recall: float = 0.9999,
    picks: int = 2,
    depth: int = 3,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, th, class_id, copies, group_id, n_links, kept) of every row.

    Texts with the same set of word n-grams are a class, named by its smallest id, with
    ``copies`` rows. Two classes are linked when the Jaccard similarity of their sets is at
    least ``threshold``. ``n_links`` counts a class's links, ``group_id`` is the smallest id
    that links lead to, and ``kept`` marks the row of that id (with the least hash ``th`` of
    its text, where rows repeat an id).

    Buckets come from chosen paths over a sketch of each set, in as many runs as the target
    recall needs. Inside a bucket the sets are compared by brute force: sketches rule out
    far pairs, the rest are measured on the whole sets, which are read again only for
    rows with such a pair. A pair is measured in the first of the buckets it shares, so links
    are counted once and no pair leaves a task. A bucket that splitting cannot part (many
    near copies) is compared in blocks by many tasks.

    A text without words has no links and is a class of its own. A null id counts as the
    smallest one. Repeated rows are copies. An empty
    table gives no rows.
    """
    own = own_columns(docs, id_col, text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text"
    )
    rows = cut(
        own.mapInArrow(_sketched(words), "doc_id long, th long, n long, s1 long, s2 long, sketch binary").withColumn(
            "cid",
            F.when(F.col("n") > 0, F.xxhash64("s1", "s2", "n")).otherwise(F.xxhash64(F.lit("none"), "doc_id", "th")),
        )
    )
    classes = cut(
        rows.groupBy("cid").agg(
            F.min(F.struct("doc_id", "th")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"),
            F.max("sketch").alias("sketch"),
        )
    )
    sets = classes.where("n > 0")
    leaves = cut(chosen_paths(sets, threshold, recall, picks, depth, block))
    paths = leaves.groupBy("cid").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    units = (
        leaves.withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "cid")
    )
    known = sets.select("cid", "n", "sketch").join(paths, "cid")
    unit = ["node", "lo", "hi"]
    close = cut(
        units.join(known, "cid")
        .repartition(*unit)
        .sortWithinPartitions(*unit, "mine", "cid")
        .mapInArrow(_near(threshold, False), "node long, lo int, hi int, mine int, cid long")
    )
    wanted = close.select("cid").distinct().join(classes.select("cid", "rep"), "cid")
    lowest = F.lit(-(1 << 63))
    texts = own.withColumn("key", F.coalesce("doc_id", lowest)).join(
        wanted.select("cid", F.coalesce("rep.doc_id", lowest).alias("key"), F.col("rep.th").alias("th")), ["key", "th"]
    )
    full = texts.select("cid", "text").mapInArrow(_whole(words), "cid long, grams binary")
    measured = cut(
        close.join(full, "cid")
        .join(known, "cid")
        .repartition(*unit)
        .sortWithinPartitions(*unit, "mine", "cid")
        .mapInArrow(_near(threshold, True), "cid long, links long, root long")
    )
    links = measured.groupBy("cid").agg(F.sum("links").alias("links"))
    edges = measured.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    groups = components(edges, measured.select("cid").distinct(), "cid").join(classes.select("cid", "rep"), "cid")
    first = groups.groupBy("component").agg(F.min("rep").alias("first"))
    found = groups.select("cid", "component").join(first, "component").join(links, "cid")
    named = classes.select("cid", "rep", "copies").join(found.select("cid", "first", "links"), "cid", "left").select(
        "cid", "rep", "copies", F.coalesce("first", "rep").alias("first"), "links"
    )
    return rows.select("doc_id", "th", "cid").join(named, "cid").select(
        "doc_id", "th", F.col("rep.doc_id").alias("class_id"), "copies",
        F.col("first.doc_id").alias("group_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.struct("doc_id", "th").eqNullSafe(F.col("first")).alias("kept"),
    )


def _whole(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, grams, n = shingles(part.column("text"), words)
            at = np.concatenate([[0], np.cumsum(n)]) * 8
            binary = pa.Array.from_buffers(
                pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(grams)]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("cid"), binary], names=["cid", "grams"])

    return run


def _near(threshold: float, measure: bool):
    """Sets of a unit that have a close pair by their sketches; with ``measure`` the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = whole_groups(batches, ["node", "lo", "hi"], 4096, "grams" if measure else None, 8 << 20)
        for table in groups:
            table = _once(table.combine_chunks())
            if measure:
                yield _links(table, threshold)
            else:
                keep = np.zeros(table.num_rows, bool)
                for a, b in _close_pairs(table, threshold):
                    keep[a] = keep[b] = True
                yield from table.select(["node", "lo", "hi", "mine", "cid"]).filter(pa.array(keep)).to_batches()

    return run


def _once(table: pa.Table) -> pa.Table:
    """Without repeats of a set in a unit: rows that agree in everything bring its text twice."""
    again = np.ones(table.num_rows, bool)
    for c in ("node", "lo", "hi", "cid"):
        values = table.column(c).to_numpy()
        again[1:] &= values[1:] == values[:-1]
    again[:1] = False
    return table.filter(pa.array(~again)).combine_chunks() if again.any() else table


def _close_pairs(table: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a table of whole units that may reach the threshold and meet here first."""
    column = {c: table.column(c).to_numpy() for c in ("node", "lo", "hi", "mine", "n", "cid")}
    total = table.num_rows
    same = np.ones(total, bool)
    for c in ("node", "lo", "hi"):
        same[1:] &= column[c][1:] == column[c][:-1]
    same[0] = False
    begin = np.flatnonzero(~same)
    end = np.append(begin[1:], total)
    group = np.cumsum(~same) - 1
    one_block = column["lo"] == column["hi"]
    right = np.bincount(group, weights=(column["mine"] == column["hi"]) & ~one_block, minlength=len(begin)).astype(np.int64)
    here = np.arange(total)
    low = np.where(one_block, here + 1, (end - right)[group])
    low = np.where(one_block | (column["mine"] == column["lo"]), low, end[group])
    many = end[group] - low
    data, at = column_bytes(table.column("sketch").combine_chunks())
    full = data.reshape(total, TOKENS * 4)
    tokens = full[:, ::4] ^ full[:, 1::4]  # eight bits of each token
    lists = table.column("nodes").combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    paths = np.full((total, int(lengths.max(initial=1))), np.iinfo(np.int64).max)
    paths[np.repeat(here, lengths), span_index(np.zeros(total, np.int64), lengths)] = lists.flatten().to_numpy()
    sizes = column["n"]
    bounds = np.cumsum(many)
    start = 0
    while start < total:
        stop = max(start + 1, int(np.searchsorted(bounds, (bounds[start - 1] if start else 0) + PAIRS, "right")))
        a = np.repeat(here[start:stop], many[start:stop])
        b = span_index(low[start:stop], many[start:stop])
        start = stop
        small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        ok = (small >= threshold * large - 1e-9) & (column["cid"][a] != column["cid"][b])
        a, b, small = a[ok], b[ok], small[ok]
        for i in range(0, len(a), 65_536):
            p, q = a[i : i + 65_536], b[i : i + 65_536]
            agree = (tokens[p] == tokens[q]).sum(1)
            # At the threshold a sketch differs by six deviations more than this; small sets skip it.
            ok = (agree >= (threshold - 0.3) * TOKENS) | (small[i : i + 65_536] < TOKENS)
            p, q = p[ok], q[ok]
            first = np.full(len(p), -1, np.int64)
            rest = np.arange(len(p))
            for k in range(paths.shape[1]):
                own = paths[p[rest], k]
                shared = (paths[q[rest]] == own[:, None]).any(1)
                first[rest[shared]] = own[shared]
                rest = rest[~shared]
                if not len(rest):
                    break
            ok = first == column["node"][p]
            if ok.any():
                yield p[ok], q[ok]


def _links(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """(cid, links, root): links of the pairs that meet here first, root joins linked sets."""
    data, at = column_bytes(table.column("grams").combine_chunks())
    kinds, where = np.unique(np.frombuffer(data.tobytes(), np.uint64), return_inverse=True)
    at = at // 8
    mark = np.zeros(len(kinds) + 1, bool)
    sizes, cids = np.diff(at), table.column("cid").to_numpy()
    links, root = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
    edges = []
    for a, b in _close_pairs(table, threshold):
        cuts = np.flatnonzero(np.diff(a, prepend=-1, append=-1))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            x, y = a[i], b[i:j]
            own = where[at[x] : at[x + 1]]
            mark[own] = True
            for k in range(0, len(y), 512):
                some = y[k : k + 512]
                hits = np.concatenate([[0], np.cumsum(mark[where[span_index(at[some], sizes[some])]])])
                ends = np.cumsum(sizes[some])
                shared = hits[ends] - hits[ends - sizes[some]]
                # Whole numbers decide, so that a pair at the threshold is never lost to rounding.
                near = shared * 1_000_000 >= round(threshold * 1_000_000) * (sizes[x] + sizes[some] - shared)
                links[x] += near.sum()
                links[some[near]] += 1
                if near.any():
                    edges.append((np.full(near.sum(), x), some[near]))
            mark[own] = False
    if edges:
        a, b = (np.concatenate(e) for e in zip(*edges, strict=True))
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
    held = links > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(cids[held]), pa.array(links[held]), pa.array(cids[root[held]])], names=["cid", "links", "root"]
    )
