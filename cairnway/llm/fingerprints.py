"""SimHash fingerprints and all fingerprints within a Hamming radius."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnway.llm.common import own_columns
from cairnway.session import cut

BITS = 64
_PAIR = 0x100000001


def votes(texts: DataFrame, keys: list[str], text: str, words: int) -> DataFrame:
    """(keys, fingerprint): one 64-bit SimHash for each row of different ``keys``.

    A term is ``words`` neighbouring words (what single blanks and line ends part), weighted by
    how often it occurs. The 64 bits of its hash vote, with its weight, for or against each
    bit of the fingerprint. Two bits are counted in one long, 32 bits each, so 32 sums count
    all votes in a partial aggregate; no list of terms is gathered.
    """
    parts = F.split(F.regexp_replace(F.col(text), "\n", " "), " ")
    listed = texts.select(*keys, parts.alias("_w"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - words, F.lit(0)))).alias("_i")
    terms = listed.select(*keys, "_w", at).select(
        *keys, F.xxhash64(*[F.get("_w", F.col("_i") + k) for k in range(words)]).alias("_h")
    )
    sums = [
        F.sum(F.shiftrightunsigned("_h", b).bitwiseAND(F.lit(_PAIR))).alias(f"_v{b}") for b in range(BITS // 2)
    ]
    counted = terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sums)
    bits: Column = F.lit(0).cast("long")
    for b in range(BITS // 2):
        low, high = F.col(f"_v{b}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_v{b}", 32)
        for count, place in ((low, b), (high, b + 32)):
            bit = F.when(count * 2 > F.col("_n"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
            bits = bits.bitwiseOR(F.shiftleft(bit, place))
    return counted.select(*keys, bits.alias("fingerprint"))


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def successors(keys: DataFrame) -> DataFrame:
    """(doc, th, n_chars, next_doc, next_th): who follows whom in descending order, in a ring.

    Only keys are sorted, in ranges; the ends of the ranges meet in a table of one row for
    each range.
    """
    order = [F.col("doc").desc(), F.col("th").desc()]
    ranged = cut(keys.repartitionByRange(*order).select("*", F.spark_partition_id().alias("range")))
    inside = Window.partitionBy("range").orderBy(*order)
    ahead = ranged.withColumns({"next_doc": F.lead("doc").over(inside), "next_th": F.lead("th").over(inside)})
    place = F.struct("doc", "th")
    heads = ranged.groupBy("range").agg(F.max(place).alias("head"))
    ends = heads.select(
        "range",
        F.coalesce(F.lead("head").over(Window.orderBy("range")), F.first("head").over(Window.orderBy("range"))).alias("after"),
    )
    return ahead.join(F.broadcast(ends), "range").select(
        "doc", "th", "n_chars",
        F.when(F.col("next_th").isNull(), F.col("after.doc")).otherwise(F.col("next_doc")).alias("next_doc"),
        F.coalesce("next_th", "after.th").alias("next_th"),
    )


def fingerprints(
    docs: DataFrame, words: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Fingerprints are longs here. The edited text has its last third of code points replaced by
    as many from the start of the next document in descending order of id. Texts move once by
    their key, and of each only the start that the document before it needs moves again.

    Null counts as empty; a text without terms votes with one empty term. Rows that repeat
    both id and text are one row; different texts with one id are ordered by their hash. A
    null id comes last. One document follows itself. An empty table gives no rows.
    """
    own = own_columns(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64("text").alias("th"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    keys = own.groupBy("doc", "th").agg(F.max(F.char_length("text")).alias("n_chars"))
    follows = cut(successors(keys))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    needed = follows.select(
        F.col("next_doc").alias("doc"), F.col("next_th").alias("th"),
        F.col("doc").alias("to_doc"), F.col("th").alias("to_th"), third.alias("k"),
    )
    starts = own.join(needed, ["doc", "th"]).select(
        F.col("to_doc").alias("doc"), F.col("to_th").alias("th"), F.expr("left(text, k)").alias("start")
    )
    length = F.char_length("text")
    kept = F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))")
    both = own.join(starts, ["doc", "th"]).select("doc", "th", "text", length.alias("n_chars"), F.concat(kept, "start").alias("edited"))
    each = both.select(
        "doc", "th", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"),
    ).select("doc", "th", "n_chars", "edited_sha256", F.col("x.kind").alias("kind"), F.col("x.text").alias("text"))
    voted = votes(each, ["doc", "th", "n_chars", "edited_sha256", "kind"], "text", words)
    prints = cut(
        voted.groupBy("doc", "th").agg(
            F.max("n_chars").alias("n_chars"), F.max("edited_sha256").alias("edited_sha256"),
            F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fingerprint"),
            F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
        )
    )
    after = prints.select(F.col("doc").alias("next_doc"), F.col("th").alias("next_th"), F.col("fingerprint").alias("f2"))
    return (
        prints.join(follows.select("doc", "th", "next_doc", "next_th"), ["doc", "th"])
        .join(after, ["next_doc", "next_th"])
        .select(
            F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "n_chars", "edited_sha256",
            "fingerprint", "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("f2")).alias("near_next"),
        )
    )


def masks(radius: int, blocks: int) -> list[int]:
    """Bits that each table keys by: all choices of ``blocks - radius`` of the blocks.

    Fingerprints that differ in at most ``radius`` bits agree in full on some choice.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in choice) for choice in combinations(range(blocks), blocks - radius)]


def within(prints: DataFrame, asked: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(fingerprint, other): every fingerprint of ``prints`` at most ``radius`` bits from one of ``asked``.

    Both sides enter one table for each choice of blocks, keyed by those bits. A pair is
    taken from the first table in which it meets, inside the join, so it comes once.
    """
    chosen = masks(radius, blocks)
    signed = [m - (1 << BITS) if m >> 63 else m for m in chosen]

    def tables(df: DataFrame, name: str) -> DataFrame:
        keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)]))
        return df.select("fingerprint").distinct().select(F.col("fingerprint").alias(name), keyed.alias("x")).select(name, "x.t", "x.k")

    differ = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(True)
    for i, m in enumerate(signed):
        earlier = earlier & ((F.lit(i) >= F.col("l.t")) | (differ.bitwiseAND(F.lit(m)) != 0))
    near = (F.bit_count(differ) <= radius) & earlier
    left, right = tables(asked, "a").alias("l"), tables(prints, "b").alias("r")
    on = (F.col("l.t") == F.col("r.t")) & (F.col("l.k") == F.col("r.k")) & near
    return left.join(right, on).select(F.col("a").alias("fingerprint"), F.col("b").alias("other"))
