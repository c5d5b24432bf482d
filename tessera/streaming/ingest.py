"""Incremental ingestion: files as they arrive -> text -> chunks -> vectors -> collection, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import chunk_id
from tessera.operators import chunk, store
from tessera.sources import files


def keyword_embedding(text: Column, words: list[str]) -> Column:
    """A deterministic stand-in for a model: one component a word, 1 where the text has it."""
    return F.array(*[F.when(text.contains(w), 1.0).otherwise(0.0).cast("float") for w in words])


def chunked(documents: DataFrame) -> DataFrame:
    """Chunks of (source_id, source, file_type, markdown): ids are stable, so ingesting again overwrites."""
    word, plain = chunk.splitter_udf(chunk.CHUNKERS["docx"]), chunk.splitter_udf(chunk.CHUNKERS["text"])
    pieces = F.when(F.col("file_type").isin(*chunk.DISPATCH), word("markdown")).otherwise(plain("markdown"))
    cut = documents.where("markdown is not null").select("source_id", "source", "file_type", pieces.alias("chunks"))
    each = cut.select("source_id", "source", "file_type", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "text"))
    return each.withColumn("id", chunk_id(F.col("source_id"), F.col("chunk_index")))


def index_batch(target: store.Store, kb_id: str, documents: DataFrame, embed) -> None:
    """Write the new chunks first, then drop what is left of longer earlier versions."""
    new = chunked(documents).withColumn("embedding", embed(F.col("text"))).withColumn("pos", F.lit(0))
    new = new.select("id", "text", "embedding", "source_id", "chunk_index", "source", "file_type", "total_chunks", "pos")
    target.upsert(kb_id, new)
    rows = target.rows(kb_id)
    now = documents.select("source_id").distinct().join(new.groupBy("source_id").agg(F.max("total_chunks").alias("n")), "source_id", "left")
    stale = rows.join(now, "source_id").where(F.col("chunk_index") >= F.coalesce("n", F.lit(0))).select("id")
    if stale.head(1):
        target._change(kb_id, lambda old: old.join(stale, "id", "left_anti"))


def ingest(spark: SparkSession, path: str, target: store.Store, kb_id: str, embed, registry: files.Registry | None = None) -> None:
    """One batch over all files of a folder."""
    index_batch(target, kb_id, files.extract(files.scan(spark, path), registry), embed)


def start(spark: SparkSession, path: str, target: store.Store, kb_id: str, embed, checkpoint: str, registry: files.Registry | None = None):
    """The same as a stream that ends when all present files are in; a repeated micro-batch changes nothing."""
    found = files.extract(files.scan(spark, path, stream=True), registry)
    write = found.writeStream.foreachBatch(lambda batch, _: index_batch(target, kb_id, batch, embed))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
