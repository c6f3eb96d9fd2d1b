"""A training-corpus pipeline over the documents table: five stages, each over all its predecessor kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet to the shared folder and
reread as the next one's docs. All but the last return the columns of documents. Null texts count as
empty; rows without an id are judged as all others are. Further columns of documents are kept as they are,
whatever their names: columns of a stage's own get names that documents do not have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from txnclean.llm import secrets, toxicity
from txnclean.llm.decontamination import contained_items
from txnclean.llm.jaccard_join import jaccard_classes
from txnclean.llm.packing import pack_documents
from txnclean.llm.shared import free_name, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on labelled rows outside the held-out fold, scores 0.5 or more."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "_toxicity")
    return toxicity.with_score(docs, model, score_col=score).where(F.col(score) < 0.5).select(*_columns(docs))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _keyed(docs: DataFrame, row: str) -> DataFrame:
    """Adds a hash of id and text: what is decided for a row holds for rows that equal it in both, and no others."""
    return docs.withColumn(row, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit(""))))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of 5-word shingle similarity 0.8 or more: that of the smallest id.

    Rows that share an id are told apart by their texts. Of rows of a class that repeat its smallest id
    one stays, that with the smallest text. Rows without an id come last, so one of them stays only if
    all of its class have none. Texts without words are copies of each other, apart for rows with and
    without an id.
    """
    row, group, bare = (free_name(docs, n) for n in ("_row", "_class", "_bare"))
    keyed = _keyed(docs, row)
    classes = jaccard_classes(keyed, id_col=row).where("n_links > 0").select(F.col("doc_id").alias(row), F.col("class_id").alias(group)).distinct()
    words = F.coalesce(F.col("text").rlike(r"[A-Za-z0-9]|[^\x00-\x7f]"), F.lit(False))
    rows = keyed.select(row, "doc_id", (~words & F.col("doc_id").isNull()).alias(bare))
    rows = written(rows.join(classes, row).groupBy(row, "doc_id", group, bare).agg(F.count("*").alias("n")), "classes")
    least = rows.groupBy(group, bare).agg(F.min("doc_id").alias("least"))
    judged = rows.join(least, [group, bare]).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("least")))
    kept = keyed.join(judged.where("not stays").select(row), row, "left_anti")
    # more rows than one of the smallest id (or none): found without texts
    stay = judged.where("stays")
    many = stay.groupBy(group, bare).agg(F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    again = written(stay.join(many, [group, bare]).select(row, group, bare), "repeated")
    if not again.take(1):
        return kept.select(*_columns(docs))
    order = F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*_columns(docs)))
    one = kept.join(again, row).groupBy(group, bare).agg(F.min_by(F.struct(*_columns(docs)), order).alias("r")).select("r.*")
    return kept.join(again, row, "left_anti").select(*_columns(docs)).union(one.select(*_columns(docs)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows, with or without an id, that contain a benchmark item to 0.8 or more of its shingles."""
    row = free_name(docs, "_row")
    keyed = _keyed(docs, row)
    found = contained_items(keyed, table(spark, sf_dir, "benchmark"), id_col=row).select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(found, row, "left_anti").select(*_columns(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets are replaced by a mark, and n_chars follows the text."""
    clean = secrets.redact(docs, secrets.fit_markov(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean.select(*_columns(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents' tokens into sequences; a row per piece."""
    return pack_documents(docs, give_back=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

# the stages learn models, hash and tokenise: SQL cannot say them; tests/llm holds them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
