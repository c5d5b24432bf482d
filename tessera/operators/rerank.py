"""Reranking: scores of an injected model matched back to candidates by position."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aligned(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, ok: whether positions are 0..n-1 exactly once for each query's candidates."""
    want = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    got = scores.groupBy("query_id").agg(F.count("*").alias("m"), F.count_distinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    ok = (F.col("m") == F.col("n")) & (F.col("d") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    return want.join(got, "query_id", "left").select("query_id", F.coalesce(ok, F.lit(False)).alias("ok"))


def apply_scores(candidates: DataFrame, scores: DataFrame, k: int | None = None) -> DataFrame:
    """candidates (query_id, pos, ...) with score and rank from scores (query_id, pos, score); ties by position. A query whose scores don't align keeps its recall order, with reranked false."""
    good = aligned(scores, candidates)
    new = scores.select("query_id", "pos", F.col("score").alias("new_score"))
    once = new.dropDuplicates(["query_id", "pos"])
    joined = candidates.join(good, "query_id").join(once, ["query_id", "pos"], "left")
    joined = joined.withColumn("score", F.when(F.col("ok"), F.col("new_score")).otherwise(F.col("score"))).withColumnRenamed("ok", "reranked").drop("new_score")
    first = F.when(F.col("reranked"), -F.col("score")).otherwise(F.lit(0.0))
    out = joined.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(first, "pos")))
    return out if k is None else out.where(F.col("rank") <= k)


def rerank(candidates: DataFrame, model: Callable[[str, list[str]], list[float]], k: int | None = None) -> DataFrame:
    """Score each query's candidates (query_id, query, pos, id, text, score) with a model: a bounded group a query.

    A query for which the model fails keeps its recall order, with reranked false."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        try:
            scores = list(model(pdf["query"].iloc[0], pdf["text"].tolist()))
        except Exception:  # no scores: they don't align
            scores = []
        return pd.DataFrame({"query_id": key[0], "pos": range(len(scores)), "score": [float(x) for x in scores]})

    scores = candidates.groupBy("query_id").applyInPandas(run, "query_id long, pos int, score double")
    return apply_scores(candidates, scores, k)
