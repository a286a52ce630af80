"""Exact duplicates by sorting the content itself."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnway.llm.common import column_bytes, own_columns
from cairnway.session import cut

#: White space that equality ignores: blank and the bytes 9 to 13.
BLANKS = "[\\x20\\x09-\\x0D]"
_RUNS = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("head", pa.bool_()), ("sha", pa.string())]
)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal when they agree after all white space is taken out. Sampled splitters
    over the start, the hash and the rank of the normalised bytes deal the rows into ranges,
    each range is sorted on disk, and every row is compared in full with the one before it.
    The rank (longest original first, then smallest id) is part of the splitters, so a group
    of copies of any size spreads over many ranges; groups that cross a border are put
    together from one small row per range end. The first row of a group stays.

    Null and blank texts are all equal to the empty text. Rows that repeat an id are rows of
    their own; of rows that agree in everything, one stays. A null id ranks last. An empty
    table gives no rows.
    """
    own = own_columns(docs, id_col, text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, "").alias("norm"),
        (-F.coalesce(F.char_length("text"), F.lit(0))).alias("rank"),
    )
    keyed = own.select("*", F.substring("norm", 1, 16).alias("start"), F.xxhash64("norm").alias("h"))
    splitters = ["start", "h", "rank", F.col("doc_id").asc_nulls_last()]
    ranged = keyed.repartitionByRange(*splitters).sortWithinPartitions(
        "start", "h", "norm", "rank", F.col("doc_id").asc_nulls_last()
    )
    rows = cut(
        ranged.select("doc_id", "h", F.col("norm").cast("binary").alias("norm")).mapInArrow(
            _runs, "doc_id long, part int, run long, head boolean, sha string"
        )
    )
    pieces = rows.groupBy("part", "run").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("sha").alias("sha"),
        F.max(F.when(F.col("head"), F.col("doc_id"))).alias("first_id"),
    )
    ends = pieces.groupBy("part").agg(F.max("run").alias("last"))
    border = pieces.join(ends, "part").where((F.col("run") == 0) | (F.col("run") == F.col("last")))
    # Two rows for each range at most, whatever the size of the table.
    merged = F.broadcast(
        border.groupBy("sha").agg(
            F.sum("n").alias("whole"),
            F.min_by("first_id", F.struct("part", "run")).alias("whole_id"),
            F.min("part").alias("whole_part"),
        )
    )
    placed = pieces.join(merged, "sha", "left").select(
        "part", "run", "sha",
        F.coalesce("whole", "n").alias("group_size"),
        F.when(F.col("whole").isNotNull(), F.col("whole_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("whole_part", "part").alias("keep_part"),
    )
    return rows.drop("sha").join(placed, ["part", "run"]).select(
        "doc_id", "keep_id", "group_size",
        (F.col("head") & (F.col("part") == F.col("keep_part"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring equal texts of a sorted range; the digest comes with the first of each run."""
    part, run, last, last_hash = TaskContext.get().partitionId(), -1, None, None
    for batch in batches:
        n = batch.num_rows
        data, at = column_bytes(batch.column("norm"))
        hashes = batch.column("h").to_numpy(zero_copy_only=False)
        view = memoryview(data)
        near = np.zeros(n, bool)
        near[1:] = (hashes[1:] == hashes[:-1]) & (np.diff(at)[1:] == np.diff(at)[:-1])
        runs, heads, shas = np.empty(n, np.int64), np.empty(n, bool), [None] * n
        for i in range(n):
            text = view[at[i] : at[i + 1]]
            if i == 0:
                same = last is not None and hashes[0] == last_hash and text == last
            else:
                same = near[i] and text == view[at[i - 1] : at[i]]
            if not same:
                run += 1
                shas[i] = hashlib.sha256(text).hexdigest()
            runs[i], heads[i] = run, not same
        if n:
            last, last_hash = bytes(view[at[n - 1] : at[n]]), hashes[n - 1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(runs), pa.array(heads),
             pa.array(shas, pa.string())],
            schema=_RUNS,
        )
