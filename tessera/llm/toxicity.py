"""Toxicity by weak supervision.

Voters are lexicon words and prefix patterns that the labelled sample shows; each votes "toxic" where it occurs, and one
more votes "clean" where none does. A generative label model (a mixture of two classes) is fitted by EM to the votes
alone: each voter's rate in either class, the share of toxic texts, and the correlations between voters within
a class, by which correlated voters are discounted. A logistic regression over the votes' counts is then trained on the posterior labels and scores
every text.

The sample is bounded: the SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents with the least hashes, at most SAMPLE_ROWS
rows of each. Voters are all patterns that pass the tests. All documents are scored, whole.

Cases: null and empty texts score as texts without votes; null doc_id is scored, held_out null counts as held out;
several labels of a document count by their largest; without labelled rows of both classes every score is 0; repeated rows score
equally; an empty table gives an empty table; extra columns are kept by `keep_clean`.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_ROWS, LEAST_DOCS, PRECISION, COMMON = 1500, 3000, 4, 4, 0.98, 0.05
_EDGE = re.compile(r"^\W+|\W+$")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def tokens(text: str | None) -> set[str]:
    return {_EDGE.sub("", w) for w in (text or "").lower().split()} - {""}


def patterns(word: str):
    """Features of a word: itself, and its prefixes where it is longer."""
    yield "=" + word
    for k in (4, 5, 6):
        if len(word) > k:
            yield word[:k]


def discover(sets: list[set[str]], toxic: np.ndarray) -> list[str]:
    """Voters: patterns that nearly only toxic texts have, more often than chance allows for one of so many patterns, and that
    many toxic texts have or that reach texts which no earlier voter reaches (copies of one text make its words
    look like a lexicon). Of patterns that extend each other the longest that loses next to nothing is taken."""
    rows = list({(frozenset(w), bool(t)) for w, t in zip(sets, toxic)})
    pos, neg = Counter(), Counter()
    for words, t in rows:
        if t:
            pos.update({p for w in words for p in patterns(w)})
    pos = Counter({p: k for p, k in pos.items() if k >= LEAST_DOCS})
    for words, t in rows:
        if not t:
            neg.update({p for w in words for p in patterns(w) if p in pos})
    n1 = max(1, sum(t for _, t in rows))
    n0 = max(1, len(rows) - n1)
    common = list(pos)
    tests = math.log(0.05 / max(1, len(common)))
    q1, q0 = math.log(n1 / (n1 + n0)), math.log(n0 / (n1 + n0))

    def fits(p):
        share = (pos[p] / n1) / (pos[p] / n1 + (neg[p] + 0.05) / n0)
        chance = pos[p] * q1 + (neg[p] * q0 + math.log(math.comb(pos[p] + neg[p], neg[p])) if neg[p] else 0)
        return share >= PRECISION and chance < tests

    good = [p for p in common if fits(p)]
    longer: dict[str, list[str]] = {}
    for p in good:
        w = p.lstrip("=")
        for k in (4, 5, 6):
            if len(w) > k or (len(w) == k and p[0] == "="):
                longer.setdefault(w[:k], []).append(p)
    good = [p for p in good if not any(q != p and neg[q] <= neg[p] and (pos[q] >= 0.97 * pos[p] or pos[q] >= 0.75 * pos[p] and 4 * neg[q] < neg[p]) for q in longer.get(p, ()))]
    chosen: list[str] = []
    reached: set[int] = set()
    of: dict[str, set[int]] = {p: set() for p in good}
    for k, (words, t) in enumerate(rows):
        if t:
            for p in {p for w in words for p in patterns(w) if p in of}:
                of[p].add(k)
    for p in sorted(good, key=lambda p: (-pos[p], len(p), p)):
        if any(q[0] != "=" and p.lstrip("=").startswith(q) for q in chosen):
            continue
        if pos[p] >= COMMON * n1 or len(of[p] - reached) >= LEAST_DOCS:
            chosen.append(p)
            reached |= of[p]
    return chosen


def votes(words: set[str], index: dict[str, int]) -> list[int]:
    """Counts of the distinct words for which each voter votes."""
    out = [0] * len(index)
    for w in words:
        for p in patterns(w):
            k = index.get(p)
            if k is not None:
                out[k] += 1
    return out


def label_model(v: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict]:
    """Posterior of "toxic" for each row of votes (n, m) of 0 and 1, by EM, and what was estimated."""
    v = np.column_stack((v, v.sum(1) == 0)).astype(float)
    post = np.where(v[:, -1] > 0, 0.02, 0.98)
    weight = np.ones(v.shape[1])
    for step in range(rounds):
        share = float(np.clip(post.mean(), 1e-3, 1 - 1e-3))
        on = (post @ v + 0.5) / (post.sum() + 1)
        off = ((1 - post) @ v + 0.05) / ((1 - post).sum() + 1)
        logit = np.log(share / (1 - share)) + (v * np.log(on / off) + (1 - v) * np.log((1 - on) / (1 - off))) @ weight
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved = np.abs(new - post).max()
        post = new
        if step == 4:  # correlations within the classes; each voter counts as its share of its correlated group
            rest = v - (post[:, None] * on + (1 - post[:, None]) * off)
            sd = np.sqrt((rest**2).mean(0)) + 1e-9
            corr = np.abs(rest.T @ rest / len(v) / np.outer(sd, sd))
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(1))
        elif moved < 1e-6 and step > 5:
            break
    return post, {"share": share, "on": on, "off": off, "weight": weight}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights, the intercept last, by damped Newton steps on soft labels."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(x) + ridge * np.append(w[:-1], 0) / 10
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge / 10 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _inputs(v: np.ndarray) -> np.ndarray:
    return np.column_stack((np.minimum(v, 3), np.log1p(v.sum(1)), v.sum(1) > 0))


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model: voters and weights."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    picks = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picks[0].union(picks[1])), "doc_id")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    sample = sample.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_ROWS).select("text", "toxic")
    sets, marks = [], []
    for row in sample.toLocalIterator():
        sets.append({sys.intern(w) for w in tokens(row.text)})
        marks.append(row.toxic == 1)
    toxic = np.array(marks, bool)
    if not toxic.any() or toxic.all():
        return None
    chosen = discover(sets, toxic)
    if not chosen:
        return None
    index = {p: k for k, p in enumerate(chosen)}
    v = np.array([votes(s, index) for s in sets])
    post, said = label_model(v > 0)
    return {"voters": chosen, "weights": logistic(_inputs(v), post), "label_model": said}


def _scores(sent):
    """The scores of batches of texts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        index = {p: k for k, p in enumerate(model["voters"])} if model else {}
        exact = {p[1:]: k for p, k in index.items() if p[0] == "="}
        by = [{p: k for p, k in index.items() if p[0] != "=" and len(p) == n} for n in (4, 5, 6)]
        for texts in batches:
            v = np.zeros((len(texts), len(index)), np.int64)
            for r, text in enumerate(texts.to_pylist()):
                if model and text:
                    hit = set()
                    for w in set(text.lower().split()):
                        if w in exact or w[:4] in by[0] or w[:5] in by[1] or w[:6] in by[2] or not (w[0].isalnum() and w[-1].isalnum()):
                            hit.add(_EDGE.sub("", w))
                    v[r] = votes(hit, index)
            if model:
                x = _inputs(v)
                score = 1 / (1 + np.exp(-np.clip(x @ model["weights"][:-1] + model["weights"][-1], -30, 30)))
            else:
                score = np.zeros(len(texts))
            yield pa.array(score)

    return run


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """(given, score): every row of docs as a struct, with its score. Only texts go to the workers, only scores come back."""
    score = F.arrow_udf(_scores(docs.sparkSession.sparkContext.broadcast(model)), "double")
    return docs.select(F.struct("*").alias("given"), score(F.col("text").cast("string")).alias("score"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more; all its columns."""
    done = scored(docs, fit(docs, labels))
    return done.where("score < 0.5").select(*[F.col("given")[c].alias(c) for c in docs.columns])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("given.doc_id", held_out("given.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
