"""From raw documents to packed batches, in five stages; each reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnway.llm.exact_dedup import BLANKS, exact_dedup
from cairnway.llm.ngram_join import ngram_join
from cairnway.llm.packing import pack, words
from cairnway.llm.suffix_dedup import suffix_dedup
from cairnway.llm.toxicity import toxicity
from cairnway.session import scratch

_LOWEST = -(1 << 63)
#: Bytes of 50 words with the blank after each, at three letters a word: words of running text
#: are longer on average in any of the languages, so a passage of more than 50 words reaches it.
PASSAGE_BYTES = 50 * 4


def _kept_rows(docs: DataFrame, kept: DataFrame, mark, longest: bool) -> DataFrame:
    """One row of ``docs`` for each (doc_id, mark) in ``kept``, also where rows repeat an id.

    The row travels as one struct, so its columns may have any names.
    """
    keys = ["doc", "mark"]
    id_or_least = F.coalesce(F.col("doc_id"), F.lit(_LOWEST)).alias("doc")
    marked = docs.select(F.struct("*").alias("row"), id_or_least, mark.alias("mark"))
    wanted = kept.select(id_or_least, "mark").distinct()
    best = Window.partitionBy(*keys).orderBy((-F.char_length("row.text")) if longest else F.lit(1))
    found = marked.join(wanted, keys).withColumn("place", F.row_number().over(best))
    return found.where("place = 1").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; labels of two thirds of the ids are learned from.

    Null and empty texts stay, and so do all rows where labels are missing or of one kind. Rows
    that repeat an id are judged each by its own text.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity(docs, labels, carry=True).where("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents that agree but for white space: the longest, then the smallest id."""
    kept = exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("mark"))
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, "")
    return _kept_rows(docs, kept, F.sha2(normal, 256), True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by five-word similarity of 0.8.

    Texts without a word, null and empty ones too, are no copies of each other. Of rows that agree
    in id and text one stays.
    """
    kept = ngram_join(docs).where("kept").select("doc_id", F.col("th").alias("mark"))
    return _kept_rows(docs, kept, F.xxhash64("text"), False)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of ``PASSAGE_BYTES`` that stand more than once.

    A letter cut in two leaves U+FFFD; n_chars counts what is left. A text that is all
    repeats stays as an empty text; null becomes empty.
    """
    done = suffix_dedup(docs, PASSAGE_BYTES, PASSAGE_BYTES // 4).select("row.*", F.expr("make_valid_utf8(cast(kept as string))").alias("text"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 words in batches of 65,536 words, from 16 length buckets.

    Null and empty texts are pieces of no words; rows that repeat an id are packed each.
    """
    return pack(docs, words(F.col("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack_batches),
]
#: Toxicity is learned, so no SQL states the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        place = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
