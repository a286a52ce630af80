"""The operators bound to the given tables, each with the SQL its rows must equal where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnway.llm import (
    best_fit, bpe, exact_dedup, fingerprints, language, ngram_join, packing, prefix_trie, sharding, suffix_dedup, token_files,
    toxicity, vector_codes,
)
from cairnway.session import cut, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Where the vocabulary files are; they are read by the driver and broadcast.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
SHARDS = 24
MAX_LEN, BUCKETS, BUDGET = 2048, 16, 65536


def query(oracle: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if oracle:
            ORACLES[build.__name__] = oracle
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    return Path(TOKENIZERS, name).read_text(encoding="utf-8")


@query()
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, written to seekable files and read back from them."""
    manifest = token_files.write_token_files(
        table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), scratch(spark, "token-files"), 2, pieces=True
    )
    return token_files.read_token_files(manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


_PART = "('0x' || substr(md5({key}), 1, 7))::BIGINT % 256"

_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i] || [0, 1, 2, 3, 4, 5, 6, 7],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) r(i)
)"""
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex({bytes}), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"""

_SHARD_SQL = f"""
WITH {_CRC_TABLE}, rows AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, encode(coalesce(text, '')) AS b FROM documents
), summed AS (
  SELECT doc_id, k, octet_length(b) + 8 AS size,
    {_CRC.format(bytes="b")} AS text_crc32
  FROM rows, crc_table
), bids AS (
  SELECT doc_id, k, size, text_crc32, s, -1.0 / ln((('0x' || substr(md5(k || '#' || s), 1, 13))::BIGINT + 0.5::DOUBLE)
    / 4503599627370496::DOUBLE) AS bid
  FROM summed, range({SHARDS + 1}) r(s)
), won AS (
  SELECT doc_id, k, size, text_crc32, arg_max(s, bid) FILTER (s < {SHARDS}) AS shard, arg_max(s, bid) AS grown_shard
  FROM bids GROUP BY ALL
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY
    {_PART.format(key="k || ':' || text_crc32 || ':' || size")}, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM won
"""


@query(_SHARD_SQL)
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 equal shards by the law ``key``, and where one more shard would put them."""
    return sharding.shard(table(spark, folder, "documents"), [1.0] * SHARDS, added=1.0)


_EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW best AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)
"""


@query(_EXACT_SQL)
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the copy that stays for it."""
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


_PACK_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents
), pieces AS (
  SELECT doc_id, p AS piece, p * {MAX_LEN} AS start, least(n - p * {MAX_LEN}, {MAX_LEN}) AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(greatest((n + {MAX_LEN - 1}) // {MAX_LEN}, 1))) AS p FROM sized)
), hist AS (
  SELECT n_tokens AS len, row_number() OVER (ORDER BY n_tokens) AS j, sum(count(*)) OVER (ORDER BY n_tokens) AS rows,
    sum(sum(n_tokens)) OVER (ORDER BY n_tokens) AS tokens
  FROM pieces GROUP BY n_tokens
), marks AS (SELECT 0 AS len, 0 AS j, 0 AS rows, 0 AS tokens UNION ALL SELECT * FROM hist),
best(k, j, cost, start) AS (
  SELECT 0, 0::BIGINT, 0::HUGEINT, 0::BIGINT
  UNION ALL
  SELECT b.k + 1, h.j, min(b.cost + h.len * (h.rows - m.rows) - (h.tokens - m.tokens)),
    arg_min(b.j, (b.cost + h.len * (h.rows - m.rows) - (h.tokens - m.tokens), b.j))
  FROM best b JOIN marks m ON m.j = b.j JOIN hist h ON h.j > b.j
  WHERE b.k < least({BUCKETS}, (SELECT count(*) FROM hist)) GROUP BY b.k + 1, h.j
), ends(k, j) AS (
  SELECT least({BUCKETS}, count(*))::INT, count(*) FROM hist
  UNION ALL
  SELECT e.k - 1, b.start FROM ends e JOIN best b ON b.k = e.k AND b.j = e.j WHERE e.k > 1
), tops AS (SELECT e.k - 1 AS bucket, h.len AS bucket_len FROM ends e JOIN hist h ON h.j = e.j),
placed AS (
  SELECT p.*, t.bucket, t.bucket_len FROM pieces p ASOF JOIN tops t ON p.n_tokens <= t.bucket_len
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY
    {_PART.format(key="coalesce(doc_id::VARCHAR, '') || ':' || piece || ':' || n_tokens")}, doc_id NULLS FIRST, piece, n_tokens) - 1 AS a,
    greatest({BUDGET} // greatest(bucket_len, 1), 1) AS fits
  FROM placed
)
SELECT doc_id, piece::BIGINT AS piece, start::BIGINT AS start, n_tokens::INT AS n_tokens, bucket::INT AS bucket,
  bucket_len::INT AS bucket_len, (a // fits)::BIGINT AS batch, (a % fits)::INT AS slot,
  (bucket_len - n_tokens)::INT AS padding
FROM numbered
"""


@query(_PACK_SQL)
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, measured in words, in batches of 65,536 words from 16 length buckets."""
    return packing.pack(
        table(spark, folder, "documents"), packing.words(F.col("text")), MAX_LEN, BUCKETS, BUDGET
    )


@query()
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents by prefix-wise BPE, and the texts that the ids stand for."""
    definition = vocabulary("byte_bpe_50k.json")
    done = bpe.decode(bpe.encode(table(spark, folder, "documents"), definition), definition)
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


_JOIN_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[0-9a-z]|[^\x00-\x7F])+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN ['#' || doc_id] ELSE list_sort(list_distinct(list_transform(
    range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS s
  FROM cut
), classes AS (
  SELECT s, min(doc_id) AS class_id, count(*) AS copies FROM sets GROUP BY s
), grams AS (
  SELECT class_id, len(s) AS n, unnest(s) AS g FROM classes
), links AS (
  SELECT a.class_id AS p, b.class_id AS q FROM grams a JOIN grams b ON a.g = b.g AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) * 10 >= 8 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT class_id, class_id FROM classes UNION SELECT r.a, l.q FROM reach r JOIN links l ON l.p = r.b
), groups AS (SELECT a AS class_id, min(b) AS group_id FROM reach GROUP BY a),
counted AS (SELECT p AS class_id, count(*) AS n_links FROM links GROUP BY p)
SELECT doc_id, class_id, copies, group_id, coalesce(n_links, 0) AS n_links
FROM sets JOIN classes USING (s) JOIN groups USING (class_id) LEFT JOIN counted USING (class_id)
"""


@query(_JOIN_SQL)
def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class of equal five-word sets, its links of 0.8 and its group."""
    return ngram_join.ngram_join(table(spark, folder, "documents")).drop("th", "kept")


_SUFFIX_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), starts AS (
  SELECT doc_id, unnest(range(n - 399)) AS p FROM d WHERE n >= 400
), named AS (
  SELECT doc_id, p, md5(substr(x, 2 * p + 1, 800)) AS h FROM starts JOIN d USING (doc_id)
), again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS k FROM named) WHERE k > 1
), marked AS (
  SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 400, true) AS fresh FROM again
), numbered AS (
  SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked
), runs AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, run, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS a, a AS b FROM runs
  UNION ALL
  SELECT doc_id, 1000000000, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id
), rest AS (
  SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY run) AS y FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(y, ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN rest USING (doc_id)
"""


@query(_SUFFIX_SQL)
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that stand more than once."""
    done = suffix_dedup.suffix_dedup(table(spark, folder, "documents"))
    lengths = F.transform("spans", lambda s: s["to"] - s["from"])
    return done.select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from two thirds of the ids."""
    return language.identify(table(spark, folder, "documents"))


@query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, learned from labels of two thirds of the ids."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    For every id divisible by 50, ``n_near`` counts the other documents within three bits.
    """
    done = cut(fingerprints.fingerprints(table(spark, folder, "documents")))
    sizes = done.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    asked = done.where("doc_id % 50 = 0").select("fingerprint").distinct()
    near = (
        fingerprints.within(sizes, asked)
        .join(sizes.withColumnRenamed("fingerprint", "other"), "other")
        .groupBy("fingerprint")
        .agg((F.sum("n") - 1).alias("n_near"))
    )
    return done.join(near, "fingerprint", "left").select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        fingerprints.hexed(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.hexed(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next",
        F.when(F.col("doc_id") % 50 == 0, F.col("n_near")).alias("n_near"),
    )


@query()
def op11_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2,048 ids; the digests come from the written pieces."""
    docs = table(spark, folder, "documents")
    return best_fit.best_fit(docs, vocabulary("word_bpe_49k.json"), MAX_LEN, 0, {"ids_crc32": F.crc32("ids")})


_TRIE_SQL = rf"""
WITH {_CRC_TABLE}, turned AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS p, id, w FROM turned
), sizes AS (
  SELECT conv_id, count(*) AS own FROM own GROUP BY conv_id
), plans AS (
  SELECT a.conv_id, a.base, a.h, least(a.h, coalesce(b.own, 0)) AS b, least(a.h, coalesce(b.own, 0)) + greatest(a.own - a.h, 0) AS n
  FROM (SELECT conv_id, own, conv_id - conv_id % 20 AS base, {_CRC.format(bytes="encode(conv_id::VARCHAR)")} % 4 AS h FROM sizes, crc_table) a
  LEFT JOIN sizes b ON b.conv_id = a.base
), turns AS (
  SELECT q.conv_id, q.n, o.p AS d, o.id, o.w FROM plans q JOIN own o ON o.conv_id = q.base WHERE o.p <= q.b
  UNION ALL
  SELECT q.conv_id, q.n, o.p - q.h + q.b, o.id, o.w FROM plans q JOIN own o USING (conv_id) WHERE o.p > q.h
), paths AS (
  SELECT conv_id, n, d, w, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM turns
  UNION ALL
  SELECT conv_id, n, 0, 0, '' FROM plans
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest, max(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM paths GROUP BY path, d
), below AS (
  SELECT p.path, p.d, sum((b.longest = b.d)::INT) AS n_leaves, sum((b.n_convs - 1) * b.w) AS saved_tokens
  FROM nodes b JOIN paths p ON p.conv_id = b.conv_id AND p.d <= b.d GROUP BY p.path, p.d
), children AS (
  SELECT left(path, (64 * (d - 1))::INT) AS path, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
)
SELECT a.conv_id, a.d::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a JOIN below USING (path, d) LEFT JOIN children USING (path, d)
LEFT JOIN nodes b ON a.d > 0 AND b.d = a.d - 1 AND b.path = left(a.path, (64 * (a.d - 1))::INT)
"""


@query(_TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All shared beginnings of all conversations, rebuilt so that neighbours begin alike."""
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


def _codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """One assignment and one move of the entries after the other, each a pair of common tables."""
    def assigned(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
    SELECT c.r, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS dist
    FROM comps c JOIN book{k} b ON b.part = c.part AND b.pos = c.pos GROUP BY c.r, c.part, b.entry)
  GROUP BY r, part
)"""

    def moved(k: int) -> str:
        return f"""book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.v)::BIGINT AS v
  FROM book{k} b LEFT JOIN (
    SELECT c.part, a.entry, c.pos, sum(c.v) AS s, count(*) AS n
    FROM comps c JOIN near{k} a ON a.r = c.r AND a.part = c.part GROUP BY ALL) m USING (part, entry, pos)
)"""

    steps = ",\n".join(f"{assigned(k)},\n{moved(k)}" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS r,
    list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comps AS MATERIALIZED (
  SELECT r, (i * {vector_codes.PARTS}) // len(q) AS part, i % (len(q) // {vector_codes.PARTS}) AS pos, q[i + 1] AS v
  FROM (SELECT r, q, unnest(range(len(q))) AS i FROM kept)
), book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, v FROM comps WHERE r <= {vector_codes.ENTRIES}),
{steps},
{assigned(rounds)}, coded AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM near{rounds} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), digest
"""


@query(_codes_sql())
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors from eight codebooks of 16 entries, after six rounds."""
    return vector_codes.vector_codes(table(spark, folder, "embeddings"))
