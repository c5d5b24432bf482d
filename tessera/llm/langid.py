"""Language identification by interpolated Kneser-Ney character models.

For each language, orders 1 to 4 over letters in lower case, everything else being one blank: raw counts at the top,
continuation counts below, absolute discounts from the counts of counts. The models are stored together: for each
order one sorted array of 64-bit gram hashes with, beside it, every language's log probability; for contexts one with
every language's weight of the lower order. A text's language is the one with the lowest cross-entropy a character; it is `accepted` where that
cross-entropy is within what the language's own training texts show.

Counts come from a bounded sample: the SAMPLE rows of each language with the least hashes; every document is scored, whole.

Languages are taken TOGETHER at a time, so that the models' size is linear in them; a text longer than PIECE is scored
piece by piece, which gives the same sums.

Cases: null text, and text without a letter, is `und` with score 0; so is every text where there is nothing to learn from; null
lang is never learned; null doc_id is scored and counts as held out; ties of the cross-entropy go to the
first language by name; repeated rows get equal results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import mix, slices, table, utf8

ORDER, SAMPLE, QUANTILE = 4, 800, 0.999
#: Languages whose models share arrays; bytes of text that are scored at a time.
TOGETHER, PIECE = 16, 1_000_000
_fold: np.ndarray | None = None


def folded() -> np.ndarray:
    """Lower-case letter of each codepoint, a blank for all that is no letter."""
    global _fold
    if _fold is None:
        _fold = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if unicodedata.category(s)[0] == "L":
                low = s.lower()
                _fold[c] = ord(low) if len(low) == 1 else c
    return _fold


def letters(data: np.ndarray, offsets: np.ndarray):
    """(codepoints, row) of texts laid end to end: each folded, blanks collapsed, one blank before it."""
    cuts = offsets - offsets[0]
    raw = data[int(offsets[0]) : int(offsets[-1])].tobytes()
    p = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    head = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    row = np.searchsorted(cuts, head, side="right") - 1
    n = len(cuts) - 1
    at = np.searchsorted(row, np.arange(n))
    p = np.insert(folded()[p], at, 32)
    row = np.insert(row, at, np.arange(n))
    keep = np.ones(len(p), bool)
    keep[1:] = (p[1:] != 32) | (p[:-1] != 32) | (row[1:] != row[:-1])
    return p[keep], row[keep]


def gram_hashes(p: np.ndarray, row: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` codepoints that end at each position; fewer at a row's start (blanks stand before it)."""
    h = np.zeros(len(p), np.uint64)
    for back in range(order - 1, -1, -1):
        q = np.full(len(p), 32, np.uint64)
        q[back:] = np.where(row[back:] == row[: len(p) - back], p[: len(p) - back], 32)
        h = h * np.uint64(0x1FFFFF0000001B3 | 1) + q + np.uint64(1)
    return mix(h + np.uint64(order))


def _counts(batches):
    """(lang, a, b, c, d, n): counts of the four codepoints of every gram."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            p, row = letters(data, offsets[i : i + 2])
            if len(p) < 2:
                continue
            q = np.concatenate((np.full(ORDER - 1, 32, np.uint32), p)).astype(np.uint64)
            code = np.stack([q[k : len(q) - ORDER + 1 + k] for k in range(ORDER)], axis=1)[1:]
            grams, n = np.unique(code, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), *[pa.array(grams[:, k].astype(np.int64)) for k in range(ORDER)], pa.array(n)], ["lang", "a", "b", "c", "d", "n"])


def kneser_ney(grams: np.ndarray, n: np.ndarray):
    """Per order 1..4: ({gram: probability}, {context: weight of the lower order}) from counts of 4-grams (k, 4)."""
    tables, weights = {}, {}
    counts = {ORDER: dict(zip(map(tuple, grams.tolist()), n.tolist()))}
    for k in range(ORDER - 1, 0, -1):
        c: dict = {}
        for g in counts[k + 1]:
            c[g[1:]] = c.get(g[1:], 0) + 1
        counts[k] = c
    alphabet = len(counts[1]) + 1
    below: dict = {}
    for k in range(1, ORDER + 1):
        c = counts[k]
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount = min(0.95, max(0.1, one / (one + 2 * two))) if one and two else 0.5
        total, kinds = {}, {}
        for g, v in c.items():
            total[g[:-1]] = total.get(g[:-1], 0) + v
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        weights[k] = {h: discount * kinds[h] / total[h] for h in total}
        lower = (lambda g: 1 / alphabet) if k == 1 else (lambda g, b=below: b[g[1:]])
        below = tables[k] = {g: (v - discount) / total[g[:-1]] + weights[k][g[:-1]] * lower(g) for g, v in c.items()}
    return tables, weights, 1 / alphabet


def _hash_of(grams: list[tuple]) -> np.ndarray:
    if not grams:
        return np.zeros(0, np.uint64)
    a = np.array(grams, np.uint64).reshape(len(grams), -1)
    h = np.zeros(len(a), np.uint64)
    for k in range(a.shape[1]):
        h = h * np.uint64(0x1FFFFF0000001B3 | 1) + a[:, k] + np.uint64(1)
    return mix(h + np.uint64(a.shape[1]))


def build(models: list) -> dict:
    """Sorted hash arrays over all languages: for each order, log probabilities; for contexts, log weights."""

    def p(m, g):
        tables, weights, floor = m
        if not g:
            return floor
        k = len(g)
        return tables[k][g] if g in tables[k] else weights[k].get(g[:-1], 1.0) * p(m, g[1:])

    out = {}
    for k in range(1, ORDER + 1):
        grams = sorted(set().union(*(m[0][k] for m in models)))
        contexts = sorted(set().union(*(m[1][k] for m in models)))
        h, c = _hash_of(grams), _hash_of(contexts) if k > 1 else np.zeros(1, np.uint64)
        logs = np.log(np.array([[p(m, g) for m in models] for g in grams], float)).astype(np.float32)
        back = np.log(np.array([[m[1][k].get(x, 1.0) for m in models] for x in contexts], float)).astype(np.float32)
        a, b = np.argsort(h), np.argsort(c)
        out[k] = (h[a], logs[a], c[b], back[b])
    out["floor"] = np.log([m[2] for m in models]).astype(np.float32)
    return out


def _find(keys: np.ndarray, asked: np.ndarray):
    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    return at, (keys[at] == asked) if len(keys) else np.zeros(len(asked), bool)


def _logs(store: dict, p: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(position, language): log probability of each codepoint after those before it in its row."""
    logs = np.zeros((len(p), len(store["floor"])), np.float32)
    left = np.arange(len(p))
    for k in range(ORDER, 0, -1):
        keys, probs, contexts, back = store[k]
        h = gram_hashes(p, row, k)[left]
        at, hit = _find(keys, h)
        logs[left[hit]] += probs[at[hit]]
        left = left[~hit]
        if not len(left):
            break
        if k > 1:
            before = gram_hashes(p, row, k - 1)
            c = np.where(left > 0, before[left - 1], np.uint64(0))
            at, known = _find(contexts, c)
            logs[left[known]] += back[at[known]]
        else:
            logs[left] += back[0] + store["floor"]
    return logs


def _long(stores: list[dict], data: np.ndarray):
    """Sums of the log probabilities by language, characters and letters of one text, in pieces that carry the last
    codepoints over."""
    total, chars, alpha, before, a = np.zeros(sum(len(s["floor"]) for s in stores)), 0, 0, np.full(1, 32, np.uint32), 0
    while a < len(data):
        b = min(len(data), a + PIECE)
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        p, _ = letters(data[a:b], np.array([0, b - a]))
        p = p[1:] if len(p) > 1 and p[0] == 32 else p  # the blank that letters() puts before a row
        q = folded()[np.frombuffer(data[a:b].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        if q[0] == 32 and before[-1] != 32:
            p = np.concatenate((np.full(1, 32, np.uint32), p[p[:1].tolist() == [32] :]))
        elif p[0] == 32:
            p = p[1:]
        if len(p):
            joined = np.concatenate((before, p))
            row = np.zeros(len(joined), np.int64)
            total += np.concatenate([-_logs(s, joined, row)[len(before) :].sum(0, dtype=np.float64) for s in stores])
            chars, alpha = chars + len(p), alpha + int((p != 32).sum())
            before = joined[-(ORDER - 1) :]
        a = b
    return total, chars, alpha


def entropies(stores: list[dict], data: np.ndarray, offsets: np.ndarray):
    """(cross-entropies a character by language, characters, letters) of each text."""
    n = len(offsets) - 1
    if n == 1 and offsets[1] - offsets[0] > PIECE:
        total, chars, alpha = _long(stores, data[int(offsets[0]) : int(offsets[1])])
        return total[None] / max(chars, 1), np.array([chars]), np.array([alpha])
    p, row = letters(data, offsets)
    inner = np.ones(len(p), bool)
    inner[np.searchsorted(row, np.arange(n))] = False  # the blank before a text is context only
    edges = np.searchsorted(row, np.arange(n))
    total = []
    for store in stores:
        logs = _logs(store, p, row)
        logs[~inner] = 0
        total.append(-np.add.reduceat(logs, edges, axis=0, dtype=np.float64) if len(p) else np.zeros((n, len(store["floor"]))))
    chars = np.bincount(row, weights=inner, minlength=n)
    alpha = np.bincount(row, weights=p != 32, minlength=n)
    return np.concatenate(total, axis=1) / np.maximum(chars, 1)[:, None], chars, alpha


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame) -> dict | None:
    """{langs, store, most}: most is each language's largest accepted cross-entropy."""
    known = docs.where("lang is not null and doc_id is not null").where(~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE).select("doc_id", "lang")
    langs = sorted(r.lang for r in picked.select("lang").distinct().collect())
    if not langs:
        return None
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(picked.where(F.col("lang").isin(langs))), ["doc_id", "lang"]).select("lang", F.col("text").cast("string").alias("text"))
    cells = rows.mapInArrow(_counts, "lang string, a long, b long, c long, d long, n long").groupBy("lang", "a", "b", "c", "d").agg(F.sum("n").alias("n")).toPandas()
    models, names = [], []
    for lang in langs:
        own = cells[cells["lang"] == lang]
        if len(own):
            names.append(lang)
            models.append(kneser_ney(own[["a", "b", "c", "d"]].to_numpy(), own["n"].to_numpy()))
    if not models:
        return None
    store = [build(models[i : i + TOGETHER]) for i in range(0, len(models), TOGETHER)]
    sent = docs.sparkSession.sparkContext.broadcast((names, store))

    def own_entropy(batches):
        names, store = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, PIECE):
                h, chars, _ = entropies(store, data, offsets[a : b + 1])
                k = [names.index(x) for x in batch.column(0).slice(a, b - a).to_pylist()]
                ok = chars >= 20
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(pa.array(ok)), pa.array(h[np.arange(b - a), k][ok])], ["lang", "h"])

    own = rows.where(F.col("lang").isin(names)).mapInArrow(own_entropy, "lang string, h double").toPandas()
    most = [float(own[own["lang"] == x]["h"].quantile(QUANTILE)) * 1.1 if (own["lang"] == x).any() else float("inf") for x in names]
    return {"langs": names, "store": store, "most": most}


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, PIECE):
                n = b - a
                if m is None:
                    lang, score, best = ["und"] * n, np.zeros(n), np.zeros(n)
                    ok = np.zeros(n, bool)
                else:
                    h, chars, alpha = entropies(m["store"], data, offsets[a : b + 1])
                    k = h.argmin(1)
                    best = h[np.arange(n), k]
                    has = alpha > 0
                    score = np.where(has, 1 / np.exp(best[:, None] - h).sum(1), 0.0)
                    lang = [m["langs"][x] if y else "und" for x, y in zip(k, has)]
                    ok = has & (best <= np.array(m["most"])[k])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(lang, pa.string()), pa.array(score), pa.array(best), pa.array(ok)], ["doc_id", "lang_pred", "score", "cross_entropy", "accepted"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, accepted boolean")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
