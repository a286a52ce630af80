"""Shards by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway.llm.common import gapless


def score(key: Column, shard: int, weight: float) -> Column:
    """What a shard bids for a key: weight / -ln(u), u uniform in (0, 1) by 52 bits of MD5.

    A shard wins a share of the keys in proportion to its weight, and its bids do not depend
    on the other shards.
    """
    digest = F.md5(F.concat(key, F.lit(f"#{shard}")))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.lit(float(weight)) / F.log((bits + 0.5) / F.lit(float(1 << 52)))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest bid; of equal bids the smaller number."""
    bids = [F.struct(score(key, s, w).alias("bid"), F.lit(-s).alias("s")) for s, w in enumerate(weights)]
    return (-F.array_max(F.array(*bids))["s"]).cast("int")


def shard(
    docs: DataFrame,
    weights: Sequence[float],
    added: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    ways: int = 256,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Key and weights alone decide the shard. ``grown_shard`` is the shard once one more of
    weight ``added`` exists: either the same or the new one, as the old bids stay. ``slot``
    numbers a shard's rows without gaps; a shard is numbered in ``ways`` parts, so its size
    bounds no task. Only hashes and sizes are moved, never texts.

    A null id has the empty key. A null text has size 8 and the checksum of no bytes. Rows
    that repeat an id share a shard and get slots of their own. An empty table gives no rows.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    grown = [*weights, added] if added is not None else None
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return gapless(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", ways).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
