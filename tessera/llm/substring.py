"""Substring dedup: remove words covered by 13-word windows that also start in an earlier document.

`remove_reference` is the method as named, for a reference of bounded size: shards of the reference become suffix
automata, broadcast in turn; documents stream past for matching statistics and lose the maximal spans at or above
the threshold. Used on the corpus itself that takes one pass over all documents for each shard, a quadratic cost, so
`remove_earlier` (the query's operator) finds the same spans by routing instead: every window is represented by the
least hash of its nine 5-word grams; only windows whose representative occurs in two documents go on, as segments: runs
of windows with one representative. The least doc_id of each distinct segment (128 bits: its representative and its own hash)
settles most; under representatives with several different segments, windows are compared one by one. Each step is an
aggregation or a join on a hash with map-side combining; no group is ever held by one task.

Cases: null text has no words; null doc_id counts as the largest (it owns nothing that another document has); rows with
one doc_id never remove each other's words; repeated rows get equal results; a text of fewer than 13 words is
kept; extra columns are kept by `remove_earlier`, also ones with the names used inside; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm.common import discard, few_texts, grams, materialize, mix, slices, table, utf8, words

WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of one automaton: some 400 bytes each in a worker.
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """Of a sequence of words; a separator that no text holds keeps passages apart."""

    def __init__(self, passages):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for k, passage in enumerate(passages):
            for w in [*passage, (k,)]:
                last = self._extend(last, w)

    def _extend(self, last: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        return new

    def matching(self, tokens) -> list[int]:
        """For each position: the length of the longest match that ends there."""
        state = n = 0
        out = []
        for w in tokens:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                n = 0
            out.append(n)
        return out


def covered(matches: list[int], window: int = WINDOW) -> np.ndarray:
    """Which words lie in a match of at least `window` words."""
    cover = np.zeros(len(matches) + 1, np.int64)
    for end, n in enumerate(matches):
        if n >= window:
            cover[end - n + 1] += 1
            cover[end + 1] -= 1
    return np.cumsum(cover)[:-1] > 0


def remove_reference(docs: DataFrame, passages: list[str], window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with `kept` (text without the spans that occur in the passages) and n_removed; the passages are bounded."""
    spark, shard, shards, size = docs.sparkSession, [], [], 0
    for p in passages:
        t = WORD.findall(p or "")
        shard.append(t)
        size += len(t)
        if size >= shard_words:
            shards.append(shard)
            shard, size = [], 0
    sent = [spark.sparkContext.broadcast(s) for s in [*shards, shard]]

    def run(batches):
        automata = [SuffixAutomaton(s.value) for s in sent]
        for batch in batches:
            kept, removed = [], []
            for t in batch.column(batch.schema.get_field_index("text")).to_pylist():
                w = WORD.findall(t or "")
                gone = np.zeros(len(w), bool)
                for a in automata:
                    gone |= covered(a.matching(w), window)
                kept.append(" ".join(x for x, g in zip(w, gone) if not g))
                removed.append(int(gone.sum()))
            yield batch.append_column("kept", pa.array(kept, pa.string())).append_column("n_removed", pa.array(removed, pa.int64()))

    schema = StructType([*docs.schema.fields, StructField("kept", StringType()), StructField("n_removed", LongType())])
    return docs.mapInArrow(run, schema)


def _representatives(h, row):
    """(first word of each window, its representative gram)."""
    at, g = grams(h, row, GRAM, 1)
    span = SPAN
    n = len(g) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g[:n].copy()
    for j in range(1, span):
        np.minimum(least, g[j : j + n], out=least)
    ok = at[span - 1 :] - at[:n] == span - 1
    ok &= row[at[span - 1 :]] == row[at[:n]]
    return at[:n][ok], least[ok]


ROW = ["ta", "tb"]


def _emit_grams(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(3))
        ta = np.asarray(batch.column(1))
        for a, b in slices(offsets, 500_000):
            _, _, row, h = words(data, offsets[a : b + 1])
            at, rep = _representatives(h, row)
            row = row[at]
            new = np.ones(len(at), bool)
            new[1:] = (rep[1:] != rep[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(rep[new].view(np.int64)), pa.array(ta[a:b][row[new]])], ["rep", "ta"])


def _emit_segments(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(3))
        doc, ta, tb = (np.asarray(batch.column(k)) for k in range(3))
        reps = batch.column(4)
        values, edges = np.asarray(reps.flatten()).view(np.uint64), np.concatenate(([0], np.cumsum(np.asarray(reps.value_lengths()))))
        for a, b in slices(offsets, 500_000):
            _, _, row, h = words(data, offsets[a : b + 1])
            at, rep = _representatives(h, row)
            first = np.searchsorted(row, np.arange(b - a))
            hit = np.zeros(len(at), bool)
            bounds = np.searchsorted(row[at], np.arange(b - a + 1))
            for k in range(b - a):
                x, y = bounds[k], bounds[k + 1]
                if y > x:
                    hit[x:y] = np.isin(rep[x:y], values[edges[a + k] : edges[a + k + 1]])
            at, rep = at[hit], rep[hit]
            n = len(at)
            if not n:
                continue
            ws, window = grams(h, row, WINDOW, 2)
            window, r = window[np.searchsorted(ws, at)], row[at]
            new = np.ones(n, bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (rep[1:] != rep[:-1]) | (r[1:] != r[:-1])
            index = np.arange(n)
            inside = index - np.maximum.accumulate(np.where(new, index, 0))
            start = np.flatnonzero(inside % SPAN == 0)
            size = np.diff(np.append(start, n))
            place = (index - np.repeat(start, size)).astype(np.uint64)
            whole = np.add.reduceat(mix(window ^ (place * np.uint64(0xA24BAED4963EE407))), start)
            of = r[start]
            where = (at[start] - first[of]) << 4 | size
            windows = pa.ListArray.from_arrays(pa.array(np.append(start, n).astype(np.int32)), pa.array(window.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[start].view(np.int64)), pa.array(whole.view(np.int64)), *[pa.array(x[a:b][of]) for x in (doc, ta, tb)], pa.array(where), windows], ["rep", "seg", "doc", "ta", "tb", "at", "windows"])


def repeated(docs: DataFrame) -> DataFrame:
    """(ta, tb, hits): of the windows of a row that an earlier document has, first word << 9 | which of the next SPAN,
    from (doc, ta, tb, text): a document's number, 128 bits of number and text that name the row, its text.

    What is shared is first found on half of the name: rows that agree in it by chance only make more candidates."""
    with few_texts(docs.sparkSession):
        seen = materialize(docs.mapInArrow(_emit_grams, "rep long, ta long"), "grams")
    shared = seen.groupBy("rep").agg(F.min("ta").alias("lo"), F.max("ta").alias("hi")).where("lo < hi").select("rep")
    reps = materialize(seen.join(shared.hint("merge"), "rep", "left_semi").groupBy("ta").agg(F.collect_set("rep").alias("reps")), "reps")
    discard(seen)
    segments = docs.join(reps.hint("merge"), "ta").select("doc", "ta", "tb", "text", "reps").mapInArrow(_emit_segments, "rep long, seg long, doc long, ta long, tb long, at long, windows array<long>")
    with few_texts(docs.sparkSession):
        segments = materialize(segments, "segments")
    discard(reps)
    # A segment that an earlier document has whole is settled; windows are compared only under representatives with
    # several different segments, once for each segment.
    first = materialize(segments.groupBy("rep", "seg").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.first("windows").alias("windows")), "first")
    several = first.groupBy("rep").count().where("count > 1").select("rep")
    each = first.join(several.hint("merge"), "rep", "left_semi").select("rep", "seg", "lo", F.posexplode("windows").alias("place", "window"))
    owner = each.groupBy("rep", "window").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).where("least < most").select("rep", "window", "least")
    late = materialize(each.join(owner.hint("merge"), ["rep", "window"]).where("least < lo").groupBy("rep", "seg").agg(F.expr("bit_or(cast(shiftleft(1, place) as long))").alias("mask")), "late")
    marked = materialize(first.select("rep", "seg", "lo", "hi").join(late.hint("merge"), ["rep", "seg"], "left").where("lo < hi or mask is not null").select("rep", "seg", "lo", "mask"), "marked")
    discard(first, late)
    hit = segments.select("rep", "seg", "doc", *ROW, "at").join(marked.hint("merge"), ["rep", "seg"])
    every = F.expr("shiftleft(1L, cast(at & 15 as int)) - 1")
    hit = hit.withColumn("mask", F.when(F.col("lo") < F.col("doc"), every).otherwise(F.coalesce("mask", F.lit(0)))).where("mask <> 0")
    hits = materialize(hit.groupBy(*ROW).agg(F.collect_list(F.expr("shiftleft(shiftright(at, 4), 9) | mask")).alias("hits")), "hits")
    discard(segments, marked)
    return hits


def _spans(hits, n: int) -> np.ndarray:
    hits = np.asarray(hits, np.int64)
    cover = np.zeros(n + WINDOW + SPAN + 1, np.int64)
    for k in range(SPAN):
        at = (hits[hits >> k & 1 == 1] >> 9) + k
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
    return np.cumsum(cover)[:n] > 0


def _keyed(docs: DataFrame):
    """(doc, ta, tb, text) columns: a document's number, the row's name (128 bits of number and text, since a doc_id may
    be null or repeated), its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return doc.alias("doc"), *[F.xxhash64(F.lit(seed), doc, text).alias(name) for seed, name in enumerate(ROW, 1)], text.alias("text")


def remove_earlier(docs: DataFrame) -> DataFrame:
    """docs, text without the removed words (its other words and the white space between kept neighbours unchanged)."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            out = []
            for text, hits in zip(texts.to_pylist(), found.to_pylist()):
                if hits:
                    ends, w = [], list(WORD.finditer(text))
                    gone = _spans(hits, len(w))
                    at, before = 0, False
                    for m, g in zip(w, gone):
                        if g:
                            ends.append(text[at : m.start()] if not before else "")
                        elif before:
                            ends.append(text[m.start() : m.end()])
                        else:
                            ends.append(text[at : m.end()])
                        at, before = m.end(), g
                    text = "".join(ends) + ("" if before else text[at:])
                out.append(text)
            yield pa.array(out, pa.string())

    joined = docs.select(F.struct("*").alias("given"), *_keyed(docs)[1:3]).join(repeated(docs.select(*_keyed(docs))).hint("merge"), ROW, "left").select("given", "hits")
    done = joined.select("given", F.arrow_udf(run, "string")(F.col("given")["text"].cast("string"), "hits").alias("body"))
    columns = [F.col("body").alias("text") if c == "text" else F.col("given")[c].alias(c) for c in docs.columns]
    return done.select(*columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def run(batches):
        for batch in batches:
            n, gone, sha = [], [], []
            data, offsets = utf8(batch.column(1))
            for k, hits in enumerate(batch.column(2).to_pylist()):
                w = data[offsets[k] : offsets[k + 1]].tobytes().split()
                n.append(len(w))
                if hits:
                    g = _spans(hits, len(w))
                    w = [x for x, y in zip(w, g.tolist()) if not y]
                gone.append(n[-1] - len(w))
                sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    keyed = docs.select("doc_id", *_keyed(docs))
    joined = keyed.join(repeated(keyed.drop("doc_id")).hint("merge"), ROW, "left").select("doc_id", "text", "hits")
    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
