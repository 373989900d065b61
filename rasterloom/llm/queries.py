"""The operators applied to whole tables, one query each, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import ann, chat, extract, importance, langid, licenses, lm, mixing, negatives, packing, sql, warc
from rasterloom.llm.minhash import near_duplicates
from rasterloom.llm.vectors import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(column: str):
    """crc32 of a number written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10).withColumnRenamed("id", "vec_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from two thirds of the documents."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, _crc("doc_id") % 3 != 1).withColumnRenamed("id", "doc_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to a content-addressed archive and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-bigram and unigram scores of all texts, learned from four fifths of them."""
    return lm.score(_table(spark, sf_dir, "documents"), _crc("doc_id") % 5 != 1).withColumnRenamed("id", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of sources weighing 3, 1, 2 in turn takes of every document."""
    out = mixing.plan(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5, repeats=2)
    return out.select(out["id"].alias("doc_id"), "size", "source_size", "target", "taken", "position")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more between vectors, and the classes that they make."""
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9).withColumnRenamed("id", "vec_id")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by the Jaccard similarity of their sets of two-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80).withColumnRenamed("id", "doc_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back."""
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(turns))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, declared in a line or inherited.

    The path of a document is its source, the tens of its id, its id.  A document that
    opens with a notice (its first line) is its directory's licence file.
    """
    docs = _table(spark, sf_dir, "documents")
    tens = F.floor(F.col("doc_id") / 10).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), tens, F.col("doc_id").cast("string"))
    out = licenses.license_scan(docs, path, F.col("line") == 0)
    return out.select(out["id"].alias("doc_id"), "path", "license", "score", "origin", "license_dir")


def op10_license_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, declared in any line or inherited from any level above.

    Documents of even id are named LICENSE.id and are licence files, wherever their notice
    stands: every fifth of them lies in the directory of its source, others whose id is
    divisible by four in that of their hundreds, the rest, like all other documents, in that of
    their tens.
    """
    return _tree(_table(spark, sf_dir, "documents"))


def op10_license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of ``op10_license_tree``; lines, paragraphs and whole texts against notices and licence texts."""
    return _tree(_table(spark, sf_dir, "documents"), templates=licenses.TEMPLATES + licenses.TEXTS, units=licenses.blocks)


def _tree(docs: DataFrame, **how) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 2 == 0, F.concat(F.lit("LICENSE."), i.cast("string"))).otherwise(i.cast("string"))
    hundreds = F.when(i % 10 != 0, F.floor(i / 100).cast("string"))
    tens = F.when((i % 10 != 0) & (i % 4 != 0), F.floor(i / 10).cast("string"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), hundreds, tens, name)
    out = licenses.license_scan(docs, path, **how)
    return out.select(out["id"].alias("doc_id"), "path", "license", "score", "origin", "license_dir")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by their words' likeness to those of the benchmark."""
    out = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(out["id"].alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract.main_text(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; labels of ids divisible by 7 are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_warc": op4_warc,
    "op5_scoring": op5_scoring,
    "op6_mixing": op6_mixing,
    "op7_vectors": op7_vectors,
    "op8_minhash": op8_minhash,
    "op9_chat": op9_chat,
    "op10_licenses": op10_licenses,
    "op10_license_tree": op10_license_tree,
    "op10_license_texts": op10_license_texts,
    "op11_resampling": op11_resampling,
    "op12_extraction": op12_extraction,
    "op13_negatives": op13_negatives,
}

ORACLE: dict[str, str] = {
    "op4_warc": sql.OP4,
    "op6_mixing": sql.OP6,
    "op7_vectors": sql.OP7,
    "op8_minhash": sql.OP8,
    "op9_chat": sql.OP9,
    "op10_licenses": sql.OP10,
    "op10_license_tree": sql.OP10_TREE,
    "op10_license_texts": sql.OP10_TEXTS,
    "op11_resampling": sql.OP11,
    "op13_negatives": sql.OP13,
}
