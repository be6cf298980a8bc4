"""Corpus pipeline: quality rules, near copies, repeats, contamination, tokens.

Counted with the subpackage palimpsest.llm. Each stage takes all that the one
before it kept, written as Parquet and read again, so that a lost executor
costs one stage at most and no plan outgrows its stage.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import contamination, near, pieces, quality, repeats
from palimpsest.llm.common import shared_folder
from palimpsest.llm.queries import PIECE_MODEL

Docs = DataFrame
#: Folded bytes of the shortest benchmark passage that makes a document a leak: the shortest with a budget.
LEAST_PASSAGE = 10


def _columns(docs: Docs) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def _keyed(docs: Docs) -> tuple[Docs, str]:
    """``docs`` with a column that tells rows apart by doc_id, lang and text (128 bits), and its name.

    Stages decide about rows, not about ids: of two rows of one id, or of none,
    one may go and the other stay. Repeated rows share a fate.
    """
    name = next(f"__row{k}" for k in itertools.count() if f"__row{k}" not in docs.columns)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x01"))
    return docs.withColumn(name, F.unhex(F.md5(F.concat_ws("\x02", part("doc_id"), part("lang"), part("text"))))), name


def _once(docs: Docs, key: str, verdict: Docs) -> Docs:
    """Rows of ``docs`` whose key is in ``verdict`` (one column)."""
    kept = verdict.select(F.col(verdict.columns[0]).alias("_kept")).distinct()
    return docs.join(kept, docs[key] == kept["_kept"], "left_semi")


def quality_stage(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Drops rows that the quality rules reject, null, empty and short texts among them.

    A row is judged by its text and language alone; repeated rows are judged
    alike, null languages share the bands of ``und``, an empty table stays
    empty, and further columns, whatever their names, stay as they are.
    """
    rows, key = _keyed(docs)
    return _once(rows, key, quality.judge(rows, doc_id=key).where("kept").select("doc_id")).select(*_columns(docs))


def near_copy_stage(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Keeps one row of each group of near copies: the one with the least id, rows without one last.

    Of several rows of that id the one with the least key stays, of repeated
    rows one. Null, empty and blank texts link with nothing and stay, each
    different row once; an empty table stays empty; all columns stay.
    """
    rows, key = _keyed(docs)
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key")).alias("doc_id"), "text")
    found = near.near_duplicates(named)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id.key")
    return _once(rows, key, first).dropDuplicates([key]).select(*_columns(docs))


def repeat_stage(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Cuts repeated strings and passages out of the texts; n_chars follows, all rows and columns stay.

    Strings of 400 bytes that start anywhere else too, and passages of 50 words
    or more made of repeated 240-byte strings, go wherever they stand. Null,
    empty and short texts stay as they are, of repeated rows nothing is left,
    an empty table stays empty.
    """
    return repeats.clean_documents(docs)


def leak_stage(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Drops rows whose text holds a passage of the benchmark, give or take a tenth of its bytes.

    Null and empty texts hold none; repeated rows share a fate; null and empty
    passages, and those under LEAST_PASSAGE bytes, are no leak; empty tables on
    either side drop nothing; all columns stay.
    """
    rows, key = _keyed(docs)
    return contamination.without_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=key, least=LEAST_PASSAGE).select(*_columns(docs))


def token_stage(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """doc_id, n_ids, ids and round_trip of every row: null and empty texts have no ids, repeated
    rows are encoded alike, an empty table gives an empty result, other columns are left out."""
    return pieces.encode(docs, PIECE_MODEL)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("suffix_array_dedup", repeat_stage),
    ("benchmark_decontamination", leak_stage),
    ("sentencepiece_ids", token_stage),
]

#: SQL cannot express the perplexity, suffix and token stages; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
