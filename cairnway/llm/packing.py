"""Batches of similar length with the least padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway.llm.common import gapless
from cairnway.session import cut

#: A word is a run of characters other than the blank and bytes 9 to 13.
WORDS = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of words, the length that the query packs by."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets that pad the least.

    ``best[j]`` is the least padding of the first j lengths by the buckets so far; one more
    bucket from i to j pads every row in it up to the length j. Of equal choices the one
    with the earliest start wins.
    """
    m = len(lengths)
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths, dtype=np.int64)])
    best = np.full(m + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0], starts = 0, []
    for _ in range(min(buckets, m)):
        after, start = best.copy(), np.zeros(m + 1, np.int64)
        after[:] = np.iinfo(np.int64).max // 4
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            start[j] = np.argmin(cost)
            after[j] = cost[start[j]]
        best = after
        starts.append(start)
    ends, j = [], m
    for start in reversed(starts):
        ends.append(int(lengths[j - 1]))
        j = int(start[j])
    return ends[::-1]


def pack(
    docs: DataFrame,
    length: Column,
    max_len: int = 2048,
    buckets: int = 16,
    budget: int = 65536,
    id_col: str = "doc_id",
    ways: int = 256,
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, n_tokens, bucket, bucket_len, batch, slot, padding).

    Documents longer than ``max_len`` are cut into pieces of that length and a rest. The
    histogram of piece lengths over all rows (``max_len`` + 1 rows at most) goes to the driver,
    where dynamic programming finds the bucket boundaries of least padding. Inside a bucket,
    rows fill batches of as many rows as padded rows fit into ``budget``. A bucket is
    numbered in ``ways`` parts, so none is gathered in one task.

    A document without tokens, or of null length, is one piece of length 0 in the smallest
    bucket. Rows that repeat an id are packed each. An empty table gives no rows.
    """
    sized = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n"))
    )
    last = F.greatest(F.ceil(F.col("n") / max_len) - 1, F.lit(0))
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * max_len).alias("start"),
        F.least(F.col("n") - F.col("piece") * max_len, F.lit(max_len)).cast("int").alias("n_tokens"),
    )
    histogram = sorted((r["n_tokens"], r["c"]) for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect())
    lengths = np.array([n for n, _ in histogram], np.int64)
    ends = boundaries(lengths, np.array([c for _, c in histogram], np.int64), buckets) if histogram else [0]
    bucket, rows = F.lit(None), F.lit(None)
    for b, end in reversed(list(enumerate(ends))):
        inside = F.col("n_tokens") <= end
        bucket = F.when(inside, F.lit(b)).otherwise(bucket)
        rows = F.when(inside, F.lit(end)).otherwise(rows)
    bucketed = pieces.withColumns({"bucket": bucket.cast("int"), "bucket_len": rows.cast("int")})
    placed = gapless(bucketed, ["bucket"], ["doc_id", "piece", "n_tokens"], "_at", ways)
    fits = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))), F.lit(1))
    return placed.select(
        "doc_id", "piece", "start", "n_tokens", "bucket", "bucket_len",
        F.floor(F.col("_at") / fits).cast("long").alias("batch"),
        (F.col("_at") % fits).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
