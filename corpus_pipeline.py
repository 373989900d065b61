"""A corpus pipeline: language, near-duplicates, mixture, packing.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again
as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import langid
from rasterloom.llm.common import column_names, cut
from rasterloom.llm.minhash import near_duplicates
from rasterloom.llm.mixing import mix
from rasterloom.llm.packing import pack

#: Below this cosine with every prototype, a text is of no learned language.
LEAST_COSINE = 0.1
#: Letters from which a low cosine says something; of shorter texts it is small in any language.
LEAST_LETTERS = 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters, and long ones unlike every learned language; fill in missing languages.

    A text has about as many trigrams as letters and blanks; with few, its cosine is small
    even where its language is right, so short texts stay.  Null texts go.  If no row has a
    language, nothing is dropped.  Null ids and repeated rows are kept as they are; texts are
    read whole; an empty table stays empty; other columns, whatever their names, are passed on.
    """
    names = docs.columns
    pred, score = column_names(docs, 2)
    prototypes = langid.fit(docs, "text", "lang", F.xxhash64("doc_id", "text"))
    seen = langid.predict(docs, prototypes, pred_col=pred, score_col=score)
    short = F.length(F.regexp_replace("text", r"\P{L}+", "")) < LEAST_LETTERS
    fine = (F.col(pred) != "und") & ((F.col(score) >= LEAST_COSINE) | short) if prototypes else F.lit(True)
    return seen.where(fine).withColumn("lang", F.coalesce("lang", pred)).select(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near copies.

    Texts of fewer than five words are copies only of equal ones; texts without words stay.
    Rows of one id and text are one document; of rows that share an id but not the text
    each text is kept or none.  Documents without an id stay.  Texts are read whole, an empty table stays
    empty.  Other columns, whatever their names, are passed on.
    """
    kept = near_duplicates(docs, shingle=5, percent=80).where("kept").select(F.col("id").alias("doc_id")).distinct()
    # ids are the side that is built: sorting whole documents for the join takes more of an executor's memory
    named = docs.join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    # rows of one id and text are found by ids and hashes, so that only those rows are sorted whole
    mark, times = column_names(docs, 2)
    text = F.xxhash64("text").alias(mark)
    again = docs.where("doc_id is not null").groupBy("doc_id", text).agg(F.count("*").alias(times)).where(F.col(times) > 1)
    again = cut(again.select("doc_id", mark), "repeated")
    if not again.isEmpty():
        marked = named.select("*", text)
        once = marked.join(again, ["doc_id", mark], "left_anti")
        some = marked.join(again, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", "text"])
        named = once.select(*docs.columns).unionByName(some.select(*docs.columns))
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source up to its target, copies included, in training order.

    Documents without words, and those of a null text, are not taken.  ``n_chars`` is that of the text as taken.
    Documents without an id are taken as others are; those of one source, size and id are taken in an order that
    reruns repeat.  A null source is one of its own; an empty table stays empty.  Other columns, whatever their names, are passed on.
    """
    out = mix(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids, as pieces; the columns are those of ``pack``.

    Null and empty texts are their closing id alone, long ones are cut freely; rows that share an id, or have none, are
    documents of their own; an empty table gives no sequence.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("mixture", mixture), ("packing", packing)]

#: SQL can't express language profiles or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
