"""Reciprocal-rank fusion of ranked channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def fuse(channels: dict[str, DataFrame], k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """query_id, id, fusion_score, rank and, for each channel, its rank and score; channels are (query_id, id, score,
    rank). A repeated id keeps its first rank in a channel; ranks of later hits are not closed up. Ties go to the lesser id."""
    if constant <= 0 or not channels:
        raise ValueError("fusion needs channels and a positive constant")
    tagged = None
    for order, (name, hits) in enumerate(channels.items()):
        part = hits.select("query_id", F.col("id").cast("string").alias("id"), F.lit(name).alias("channel"), F.lit(order).alias("o"), "rank", "score")
        tagged = part if tagged is None else tagged.union(part)
    once = tagged.groupBy("query_id", "id", "channel", "o").agg(F.min(F.struct("rank", "score")).alias("b"))
    each = [x for name in channels for x in (F.max(F.when(F.col("channel") == name, F.col("b.rank"))).alias(f"{name}_rank"), F.max(F.when(F.col("channel") == name, F.col("b.score"))).alias(f"{name}_score"))]
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("o", (1.0 / (constant + F.col("b.rank"))).alias("v")))), F.lit(0.0), lambda s, x: s + x["v"])
    fused = once.groupBy("query_id", "id").agg(total.alias("fusion_score"), F.min_by("channel", "o").alias("channel"), *each)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fusion_score", 12)), "id")
    fused = fused.withColumn("rank", F.row_number().over(order))
    return fused if k is None else fused.where(F.col("rank") <= k)
