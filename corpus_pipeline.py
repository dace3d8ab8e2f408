"""A training corpus from documents: quality, near copies, benchmark passages, mixing, shards.

Each stage takes the documents that its predecessor kept; run() writes each stage's result as Parquet to the shared
folder, reads it again for the next and then deletes the one before. All but the last return the columns of their input.

Stages decide about rows, not about ids: where a decision is made elsewhere and comes back by a join, the stage first writes its
rows with a number of their own. They carry the input's columns as one struct, so no column of it can clash with theirs.

Defined cases: rows without a doc_id, or that repeat one, stay or go each for its own text; null and empty texts are one near-duplicate
group, of which one row stays; very long texts are read whole; an empty table gives no rows; other columns go along.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import decontamination, mixing, quality, sharding, simhash
from lintel.llm.storage import checkpointed, held, release, remove_table, write_table, written

#: Row numbers that may be broadcast (16 MB of them); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """(row, number, doc_id, text), written: the input's columns, and a number that no other row has."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number"))
    return written(whole, name).select("row", "number", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The input's rows but for those of these numbers."""
    gone = checkpointed(gone.select("number"))
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "number", "left_anti").select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above, all where no model can be fitted; no labels decide about a document."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not isinstance(model, quality.Machine):
        return docs
    read = [c for c in ("text", "n_chars") if c in docs.columns]
    scored = quality.scored(docs.select(F.struct(*docs.columns).alias("row"), *read), model)
    return scored.where(F.col("quality_score") >= quality.THRESHOLD).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: that of the smallest doc_id, null last."""
    rows = _numbered(docs, "near-dedup")
    found = simhash.simhash_components(rows.select(F.col("number").alias("doc_id"), "text")).select(F.col("doc_id").alias("number"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number"))
    kept = rows.select("number", "doc_id").join(found, "number").groupBy("component_id").agg(first.alias("first")).select(F.col("first.number").alias("number"))
    return _without(rows, rows.select("number").join(kept, "number", "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    rows = _numbered(docs, "decontaminate")
    found = decontamination.decontaminate(rows.select(F.col("number").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, found.where("contaminated").select(F.col("doc_id").alias("number")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it; those not drawn go."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each drawn document's shard and slot."""
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: Scores of a fitted model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs, before, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), None, held()
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = write_table(result, name.replace(" ", "-"))
        release(spark, own)
        if before:
            remove_table(spark, before)
        docs, before = spark.read.schema(result.schema).parquet(path), path
    return docs
