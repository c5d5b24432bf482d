"""Load-based degradation: failure rates, levels, hysteresis and what a level permits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

WINDOW, LEAST, RATES, LOADS, RECOVERY = 200, 20, (0.2, 0.5, 0.8), (2.0, 5.0, 10.0), 30.0


def failure_rate(outcomes: DataFrame, order: str, failed: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """outcomes with failure_rate: share of failures in the last 200 outcomes, 0 with fewer than 20."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(WINDOW - 1), 0)
    n = F.count("*").over(w)
    return outcomes.withColumn("failure_rate", F.when(n < LEAST, 0.0).otherwise(F.sum(F.col(failed).cast("double")).over(w) / n))


def level(rate: Column, load: Column | None = None) -> Column:
    """0 normal, 1 no reranking, 2 fewer results, 3 no writes: the highest that a threshold reaches."""
    load = F.lit(0.0) if load is None else load
    out = F.lit(0)
    for k, (r, s) in enumerate(zip(RATES, LOADS), start=1):
        out = F.when((rate >= r) | (load >= s), k).otherwise(out)
    return out


def adjusted_top_k(top_k: Column, lv: Column) -> Column:
    return F.when(lv >= 2, F.greatest(F.lit(1), F.floor(top_k * 0.5).cast("int"))).otherwise(top_k)


def allows_rerank(lv: Column) -> Column:
    return lv < 1


def accepts_writes(lv: Column) -> Column:
    return lv < 3


def fetch_k(top_k: Column, given: Column | None = None) -> Column:
    """Candidates of each channel: max(4 k, 20) unless given, never below k."""
    usual = F.greatest(top_k * 4, F.lit(20))
    return F.greatest(top_k, usual if given is None else F.coalesce(given, usual))


def fold_levels(raw: list[int], at: list[float], recovery: float = RECOVERY) -> list[int]:
    """Effective levels: rises at once, falls one level at a time, each after `recovery` seconds."""
    out, now, since = [], 0, None
    for r, t in zip(raw, at):
        if r >= now:
            now, since = r, t
        elif since is None or t - since >= recovery:
            now, since = now - 1, t
        out.append(now)
    return out


def hysteresis(levels: DataFrame, key: str, at: str) -> DataFrame:
    """levels (key, at timestamp, level) with effective_level, folded in order of time within each key."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        seconds = (pdf[at] - pdf[at].iloc[0]).dt.total_seconds().tolist()
        return pdf.assign(effective_level=fold_levels(pdf["level"].tolist(), seconds))

    return levels.groupBy(key).applyInPandas(run, StructType([*levels.schema.fields, StructField("effective_level", IntegerType())]))
