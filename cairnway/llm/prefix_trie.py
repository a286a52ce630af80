"""All shared beginnings of conversations, from ROLLUP over columns of turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnway.llm.packing import WORDS
from cairnway.session import cut
from cairnway.skew import narrow, position

#: Turns in one block of columns; longer conversations go on in further blocks.
BLOCK = 8
#: Blocks of one conversation that a task runs through at a time, where one is very long.
RUN_BLOCKS = 65_536
#: Bytes of joined ids in one row on the way to a digest.
PIECE_BYTES = 1 << 16


def turns_of(conversations: DataFrame, bound: int | None = None) -> tuple[DataFrame, bool]:
    """(conv_id, p, id, w): each conversation's turns in order from p = 1; and whether one is very long.

    ``id`` stands for role and text, both empty when null; ``w`` counts the words of the text.
    Turns are ordered by ``turn``, null first, turns of equal number by ``id``, repeated rows
    follow each other. Rows without a conversation are left out. Texts stay where they are read:
    only ids and counts are shuffled. ``bound`` is how many turns of one conversation a task may
    sort; longer ones are numbered in ranges.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("id"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("w"),
    )
    wide = not narrow(own, ["conv_id"], bound)
    return position(own, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("id")], "p", bound).drop("turn"), wide


def rebuilt(turns: DataFrame, span: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their span: (conv_id, n) and (conv_id, n, d, id, w).

    The first h turns of conversation c - c % span come first, h = crc32(c) % heads, then the own
    turns after the first h. At most span conversations ask for one head of heads - 1 turns.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("p").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    asked = sizes.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % span).alias("base"), h.alias("h"))
    theirs = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("at_base"))
    plans = asked.join(theirs, "base", "left").withColumn("b", F.least("h", F.coalesce("at_base", F.lit(0)))).withColumn(
        "n", F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    )
    plans = cut(plans.select("conv_id", "base", "h", "b", "n"))
    begun = turns.where(F.col("p") < heads).select(F.col("conv_id").alias("base"), F.col("p").alias("d"), "id", "w")
    first = plans.where("b > 0").join(begun, "base").where("d <= b").select("conv_id", "n", "d", "id", "w")
    rest = turns.join(plans, "conv_id").where("p > h").select("conv_id", "n", (F.col("p") - F.col("h") + F.col("b")).alias("d"), "id", "w")
    return plans.select("conv_id", "n"), first.unionByName(rest)


def _half(which: int, k: Column, d: Column, turns: list[Column]) -> Column:
    """One half of the hash of a block's first d turns; the turns are digests already."""
    return F.xxhash64(F.lit(which), k, d, *turns)


def blocks_of(convs: DataFrame, turns: DataFrame, width: int, wide: bool, run: int = RUN_BLOCKS) -> DataFrame:
    """(conv_id, n, k, t1 .. t<width>, x, y, before): a row per block of ``width`` turns.

    ``x`` and ``y``, 128 bits, name the node where block k begins: the hashes of all blocks
    before, each with its place, put together by exclusive or, so that very long conversations
    are run through in parts. ``before`` are the words ahead of the block. A conversation
    without turns has one block without turns.
    """
    rows = turns.unionByName(
        convs.select("conv_id", "n", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("w"))
    ).withColumn("k", F.floor((F.greatest("d", F.lit(1)) - 1) / width).cast("long"))
    if not wide:
        rows = rows.repartition("conv_id")
    turn = F.when(F.col("d") > 0, F.struct("d", F.struct("id", "w").alias("t")))
    held = rows.groupBy("conv_id", "k").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(turn)).alias("held"))
    cols = [F.get("held", F.lit(i))["t"].alias(f"t{i + 1}") for i in range(width)]
    blocks = held.select("conv_id", "n", "k", *cols)
    whole = [F.col(f"t{i + 1}.id") for i in range(width)]
    own = {
        "hx": _half(0, F.col("k"), F.lit(width), whole), "hy": _half(1, F.col("k"), F.lit(width), whole),
        "hw": sum((F.coalesce(F.col(f"t{i + 1}.w"), F.lit(0)) for i in range(1, width)), F.coalesce(F.col("t1.w"), F.lit(0))),
    }
    blocks = blocks.withColumns(own)

    def upto(w) -> dict[str, Column]:
        return {
            "x": F.coalesce(F.bit_xor("hx").over(w), F.lit(0).cast("long")), "y": F.coalesce(F.bit_xor("hy").over(w), F.lit(0).cast("long")),
            "before": F.coalesce(F.sum("hw").over(w), F.lit(0).cast("long")),
        }

    ahead = (Window.unboundedPreceding, -1)
    if not wide:
        return blocks.withColumns(upto(Window.partitionBy("conv_id").orderBy("k").rowsBetween(*ahead))).drop(*own)
    runs = blocks.withColumn("run", F.floor(F.col("k") / run))
    sums = runs.groupBy("conv_id", "run").agg(F.bit_xor("hx").alias("hx"), F.bit_xor("hy").alias("hy"), F.sum("hw").alias("hw"))
    offsets = sums.withColumns(upto(Window.partitionBy("conv_id").orderBy("run").rowsBetween(*ahead))).select(
        "conv_id", "run", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("before").alias("ow")
    )
    inside = runs.withColumns(upto(Window.partitionBy("conv_id", "run").orderBy("k").rowsBetween(*ahead)))
    return inside.join(offsets, ["conv_id", "run"]).withColumns(
        {"x": F.col("x").bitwiseXOR(F.col("ox")), "y": F.col("y").bitwiseXOR(F.col("oy")), "before": F.col("before") + F.col("ow")}
    ).drop(*own, "run", "ox", "oy", "ow")


def rolled_up(blocks: DataFrame, width: int, values: str) -> DataFrame:
    """``values`` of every node: (k, x, y, t1 .. , level, ...), level turns deep in block k.

    One ROLLUP serves all blocks, since x and y name the node a block begins at. Groups of a
    level where the conversation has ended are no nodes; as a condition on grouping columns,
    Spark drops them below the shuffle. A block's own beginning is the last node of the block
    before, so it counts in the first block only.
    """
    names = ", ".join(f"t{i + 1}" for i in range(width))
    filled = " + ".join(f"(t{i + 1} is not null)::int" for i in range(width))
    level = f"{width} - bit_count(grouping_id())"
    return blocks.sparkSession.sql(
        f"SELECT k, x, y, {names}, CAST({level} AS LONG) AS level, {values} FROM {{blocks}} "
        f"GROUP BY k, x, y, ROLLUP ({names}) HAVING {level} = {filled} AND ({level} > 0 OR k = 0)",
        blocks=blocks,
    )


def _named(nodes: DataFrame, width: int) -> DataFrame:
    """Add (x, y) of the node itself, of its parent, its depth, its turn's words, and those of its path."""
    turns = [F.col(f"t{i + 1}.id") for i in range(width)]

    def name(which: int, own: str, level: Column) -> Column:
        started = F.col(own)
        return F.when(level <= 0, started).otherwise(started.bitwiseXOR(_half(which, F.col("k"), level.cast("int"), turns_upto(level))))

    def turns_upto(level: Column) -> list[Column]:
        return [F.when(F.lit(i) < level, t) for i, t in enumerate(turns)]

    at, above = F.col("level"), F.col("level") - 1
    words = F.array(*[F.coalesce(F.col(f"t{i + 1}.w"), F.lit(0)) for i in range(width)])
    return nodes.withColumns({
        "nx": name(0, "x", at), "ny": name(1, "y", at),
        "px": F.when(at > 0, name(0, "x", above)), "py": F.when(at > 0, name(1, "y", above)),
        "depth": F.col("k") * width + at, "own_words": F.when(at > 0, F.get(words, (at - 1).cast("int"))).otherwise(0),
        "path_words": F.aggregate(F.slice(words, F.lit(1), F.greatest(above, F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda a, b: a + b),
    })


def joined_digests(ids: DataFrame, keys: list[str], value: str, piece: int = PIECE_BYTES) -> DataFrame:
    """(keys, sha256): the digest of each group's values, in ascending order and joined by commas.

    Ranges of (keys, value), so that a group of any size spreads, are joined into rows of about
    ``piece`` bytes. Then each group's rows are hashed one after the other as they are read: SHA-256
    can't be put together from parts, so the joined bytes of a group stream through one task, which
    holds one row of them.
    """
    ranged = ids.select(*keys, value).repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    fields = ", ".join(f"{k} {ids.schema[k].dataType.simpleString()}" for k in keys)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, group, held, size = [], None, [], 0
        for batch in batches:
            for *key, one in zip(*(batch.column(c).to_pylist() for c in (*keys, value)), strict=True):
                if held and (key != group or size >= piece):
                    out.append((*group, held[0], ",".join(map(str, held)).encode()))
                    held, size = [], 0
                group = key
                held.append(one)
                size += 20
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*keys, "first", "piece"])
                out = []
        if held:
            out.append((*group, held[0], ",".join(map(str, held)).encode()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*keys, "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, out = None, None, []
        for batch in batches:
            for *key, piece_bytes in zip(*(batch.column(c).to_pylist() for c in (*keys, "piece")), strict=True):
                if key == group:
                    state.update(b",")
                else:
                    if group is not None:
                        out.append((*group, state.hexdigest()))
                    group, state = key, hashlib.sha256()
                state.update(piece_bytes)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*keys, "sha256"])
                out = []
        if group is not None:
            out.append((*group, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*keys, "sha256"])

    pieces = ranged.mapInArrow(joined, f"{fields}, first long, piece binary")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hashed, f"{fields}, sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, width: int = BLOCK, wide: bool = False, run: int = RUN_BLOCKS) -> DataFrame:
    """Every node of the trie of conversations: (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256), from (conv_id, n) and (conv_id, n, d, id, w).

    Two roll-ups over the blocks. The first gives each node its smallest member and its members.
    A conversation is the smallest member of its nodes from some depth f on, and shares the turns
    before it with a smaller one: those words are what it saves. So below a node every member but
    the smallest saves its shared words without the words of the path that leads to the node, and
    every leaf is counted by its smallest member: sums that no longer depend on the level, which the
    second roll-up adds up for all nodes together.
    """
    blocks = cut(blocks_of(convs, turns, width, wide, run))
    members = rolled_up(blocks, width, "min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest, max(before) AS before")
    nodes = cut(
        _named(members, width).select(
            "nx", "ny", "px", "py", "depth", "conv_id", "n_convs", "longest",
        )
    )
    firsts = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("f"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf")
    )
    lengths = F.array(*[F.coalesce(F.col(f"t{i + 1}.w"), F.lit(0)) for i in range(width)])
    shared = F.aggregate(
        F.slice(lengths, F.lit(1), F.greatest(F.least(F.coalesce(F.col("f") - 1, F.col("n")) - F.col("k") * width, F.lit(width)), F.lit(0)).cast("int")),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    facts = (
        blocks.join(firsts, "conv_id", "left")
        .groupBy("conv_id")
        .agg(F.sum(shared).alias("shared"), F.coalesce(F.max("leaf"), F.lit(0)).alias("leaf"))
    )
    below = rolled_up(
        blocks.join(facts, "conv_id"), width,
        "sum(leaf) AS n_leaves, sum(shared) AS shared, min_by(shared, conv_id) AS own, count(*) AS members, max(before) AS before",
    )
    sums = _named(below, width).select(
        "nx", "ny", "n_leaves",
        (F.col("shared") - F.col("own") - (F.col("members") - 1) * (F.col("before") + F.col("path_words"))).alias("saved_tokens"),
    )
    ends = blocks.where(F.col("n") <= (F.col("k") + 1) * width).withColumn("level", F.col("n") - F.col("k") * width)
    digests = joined_digests(
        _named(ends, width).select("nx", "ny", "conv_id"), ["nx", "ny"], "conv_id"
    )
    children = nodes.where("px is not null").groupBy(F.col("px").alias("nx"), F.col("py").alias("ny")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("nx").alias("px"), F.col("ny").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    key = ["nx", "ny"]
    return (
        nodes.join(sums, key).join(children, key, "left").join(digests, key, "left").join(parents, ["px", "py"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame, width: int = BLOCK, bound: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node.

    Null role and text are empty, a null turn comes first, rows without a conv_id belong to no
    conversation. Conversations that lose all turns end at the root. Repeated rows are turns of
    their own. An empty table has no nodes, not even a root.
    """
    own, wide = turns_of(conversations.select("conv_id", "turn", "role", "text"), bound)
    convs, turns = rebuilt(own)
    return prefix_trie(convs, turns, width, wide, RUN_BLOCKS if bound is None else max(1, bound // width))
