"""Retrieval: dense, keyword or hybrid recall, fusion, reranking, limits, with diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import dense, fuse, keyword, rerank

#: Errors that say the request is wrong; they are never degraded to another channel.
FATAL = (ValueError, TypeError, KeyError)


def limits(top_k: int, fetch_k: int | None, level: int) -> tuple[int, int]:
    """(effective top_k, fetch_k); the latter ignores degradation."""
    if not 1 <= top_k <= 100 or fetch_k is not None and not 1 <= fetch_k <= 500:
        raise ValueError("top_k must be 1 to 100 and fetch_k 1 to 500")
    fetch = max(top_k, fetch_k if fetch_k is not None else max(4 * top_k, 20))
    return (max(1, int(top_k * 0.5)) if level >= 2 else top_k), fetch


def retrieve(rows: DataFrame, queries: DataFrame, mode: str = "hybrid", top_k: int = 5, fetch_k: int | None = None, where: Column | None = None, level: int = 0, model: Callable[[str, list[str]], list[float]] | None = None) -> tuple[DataFrame, dict]:
    """Chunks (query_id, rank, id, score, vector_*, keyword_*, fusion_score) and one dict of diagnostics.

    rows: id, text, embedding and what the filter reads; queries: query_id, text, vector. A batch of queries is one plan.
    In hybrid mode each channel's hits (at most fetch_k a query) are computed here and kept, so that a channel that fails
    while it runs leaves the answer to the other one; the other modes read only queries and statistics here.
    """
    effective, fetch = limits(top_k, fetch_k, level)
    if mode not in ("dense", "keyword", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    wanted = {"dense": ["vector"], "keyword": ["keyword"], "hybrid": ["vector", "keyword"]}[mode]
    found, notes = {}, []
    recall = {
        "vector": lambda: dense.dense_topk(rows, queries, fetch, where),
        "keyword": lambda: keyword.keyword_topk(rows, queries, fetch, where),
    }
    for name in wanted:
        try:
            hits = recall[name]()
            if mode == "hybrid":
                hits = hits.persist()
                hits.count()
            found[name] = hits
        except FATAL:
            raise
        except Exception as e:  # the other channel answers
            if mode != "hybrid":
                raise
            notes.append({"stage": name, "reason": "channel failed", "error_type": type(e).__name__})
    if not found:
        raise RuntimeError("no channel is available")
    merged = fuse.fuse(found)
    for name in ("vector", "keyword"):
        if name not in found:
            merged = merged.withColumn(f"{name}_rank", F.lit(None).cast("int")).withColumn(f"{name}_score", F.lit(None).cast("double"))
    score = F.col("fusion_score") if len(found) > 1 else F.col(f"{next(iter(found))}_score")
    merged = merged.withColumn("score", score)
    reranked = model is not None and level < 1
    if reranked:
        texts = rows.select(F.col("id").cast("string").alias("id"), "text")
        asked = queries.select(F.col("query_id").cast("long"), F.col("text").alias("query"))
        candidates = merged.where(F.col("rank") <= fetch).withColumn("pos", F.col("rank") - 1).drop("rank").join(texts, "id").join(F.broadcast(asked), "query_id")
        merged = rerank.rerank(candidates, model)
    out = merged.where(F.col("rank") <= effective)
    columns = ["query_id", "rank", "id", "score", "vector_rank", "vector_score", "keyword_rank", "keyword_score", "fusion_score"]
    said = {"mode": mode if len(found) == len(wanted) else {"vector": "dense"}.get(next(iter(found)), next(iter(found))), "channels": list(found), "reranked": reranked, "effective_top_k": effective, "fetch_k": fetch, "degradations": notes}
    return out.select(*columns), said
