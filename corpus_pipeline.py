"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and works on all that the stage before it kept.

All stages but the last return the columns of documents; the last returns the packed sequences' pieces. SQL cannot express the
stages (ORACLE_SQL is None); they are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm import fmindex, langid, linedup, packing, simhash
from jsonloom.llm.common import aside, restored, small_batches, stored

ORACLE_SQL = None
#: Documents whose language is less likely than all others together are rejected, as are those without letters.
LEAST_POSTERIOR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; learned from the text and non-null lang of those not held out.

    Rows with a null text, without letters, or of a language less likely than all others together go; where nothing could be
    learned, all go. Repeated rows and null doc_ids are treated each for itself; an empty table stays empty."""
    small_batches(spark)
    model = langid.fit(docs.where(~F.coalesce(langid.held_out(), F.lit(False))).select("doc_id", "text", "lang"))
    rows = aside(docs, "doc_id", "text")
    found = langid.identify(rows, model, *[c for c in rows.columns if c != "doc_id"])
    return restored(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_POSTERIOR)), docs, "doc_id", "text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, or nearly repeat, an earlier one; those that lose all lines go.

    Null and empty texts have no lines and stay. Rows that agree in doc_id and text are one document: both keep the same lines.
    Of a class of lines the first by (doc_id, position) stays, null doc_ids first. An empty table stays empty."""
    small_batches(spark)
    return linedup.without_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash classes (fingerprints within two bits, by anchors) and MinHash bands, for
    those farther apart, propose them; Jaccard similarity of five-word shingles 0.8 or more decides. The first by doc_id
    (null ones last), of rows that share one that of the least hash of doc_id and text, stays. Texts without words (null ones too)
    are one group; repeated rows are copies; an empty table stays empty."""
    small_batches(spark)
    names = ("doc_id", "text")
    kept = stored(simhash.representatives(docs, 0.8, 5).withColumnRenamed("doc", "_doc"))
    rows = aside(docs, *names).withColumn("_doc", F.xxhash64(*names))
    return restored(rows.join(kept, "_doc").dropDuplicates(["_doc"]), docs, *names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows cover to a twentieth or more go; from the others the windows' spans are cut.

    Null and empty texts have no words and stay as they are, as do all texts where the benchmark is empty or nothing is hit;
    repeated rows and null doc_ids are treated each for itself; an empty table stays empty."""
    small_batches(spark)
    names = ("doc_id", "text", "n_chars")
    rows = aside(docs, *names)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = fmindex.removal_spans(rows, benchmark, "doc_id", *[c for c in rows.columns if c not in ("doc_id", "text")], cut=True)
    hit = fmindex.n_hit()
    out = found.where((hit == 0) | (20 * hit < F.col("n_words"))).withColumn("text", F.col("body").cast("string"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restored(out, docs, *names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences' pieces (see packing.pack): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the end id only; repeated rows and null doc_ids are packed each for itself; an empty table gives no
    pieces."""
    small_batches(spark)
    return packing.pack(docs).drop("ids")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages in a row over the documents table; each stage but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
