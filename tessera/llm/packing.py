"""Packing along a space-filling curve.

A document's token counts, hashed with signs, are projected to three dimensions by one fixed table; the Hilbert key of
the direction orders all documents; they are laid end to end in that order and cut every 2048 tokens, so only
the very last sequence has padding. Tokens are written once to the shared folder; the order is found on the narrow
columns (key, row, count) alone: range partitions, their totals (one number a partition to the driver), a running sum
inside each; then the starts join the tokens by row.

Cases: null text is empty (its only token is the separator); null doc_id is kept; repeated rows are packed each; ties of
the key are broken by row number, so equal documents spread over range partitions; extra columns are dropped; an
empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import os
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import few_texts, materialize, mix, slices, table, utf8

LENGTH, SEPARATOR, BITS, DIMS = 2048, 1, 10, 3
#: Bytes of text that a worker splits at a time; words that its cache holds (a full one starts anew, as does each task's).
SLICE, CACHE_WORDS = 2_000_000, 400_000
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?$"
#: The library's printable form of each byte; but the blank between words stays as it is.
_HIDDEN = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
PRINTABLE = "".join(chr(256 + _HIDDEN.index(b) if b in _HIDDEN and b != 32 else b) for b in range(256))
_state: dict = {}


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, d) with `bits` bits an axis, by Skilling's transpose."""
    x = axes.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _tokenizer(path: str):
    if _state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        size = 1 << 16
        # 256 hashed dimensions with signs, then a fixed projection to DIMS: one row of the product for each id
        h = mix(np.arange(size, dtype=np.uint64))
        plane = np.random.default_rng(7).standard_normal((256, DIMS)).astype(np.float32)
        marks = {x: tokenizer.encode(x, add_special_tokens=False).ids[0] for x in ".,"}
        _state.update(path=path, tokenizer=tokenizer, model=tokenizer.model.tokenize, marks=marks, cache={}, flat=np.zeros(1 << 16, np.uint16), used=0, start=np.zeros(1 << 12, np.int64), size=np.zeros(1 << 12, np.int64), plane=plane[(h & np.uint64(255)).astype(np.int64)] * np.where(h >> np.uint64(63), 1, -1).astype(np.float32)[:, None])
    return _state


def _cut(words: list[str], s: dict, letters: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each word) of words. A word of lower-case letters alone is one run for the tokenizer, which
    hands its bytes in printable form to its model: that one is asked directly. Other words are encoded in one call and
    cut at their offsets."""
    joined = " ".join(words)
    if letters:
        runs = [[t.id for t in s["model"](w)] for w in codecs.charmap_decode(joined.encode(), "strict", PRINTABLE)[0].split(" ")]
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        return np.fromiter(chain.from_iterable(runs), np.uint16, int(size.sum())), size
    e = s["tokenizer"].encode(joined, add_special_tokens=False)
    ids = np.array(e.ids, np.uint16)
    at = np.fromiter((o[0] for o in e.offsets), np.int64, len(ids))
    edges = np.searchsorted(at, np.cumsum([0] + [len(w) + 1 for w in words]))
    return ids, np.diff(edges)


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges [start, start + size) of flat, one after another."""
    to = np.cumsum(size)
    return flat[np.repeat(start - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)]


def _forget(s: dict) -> None:
    s["cache"].clear()
    s.update(flat=np.zeros(1 << 16, np.uint16), used=0, start=np.zeros(1 << 12, np.int64), size=np.zeros(1 << 12, np.int64))


def _known(stems: pa.Array, letters: bool, s: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start, size) of distinct stems: from the worker's cache, or encoded and kept there."""
    # no stem holds a blank: one string, split again, is faster than a list of an array's values
    given = pc.binary_join(pa.ListArray.from_arrays([0, len(stems)], stems.cast(pa.string())), " ")[0].as_py().split(" ")
    cache = s["cache"]
    if len(cache) > CACHE_WORDS:
        _forget(s)
    at = np.fromiter(map(cache.get, given, repeat(-1)), np.int64, len(given))
    new = np.flatnonzero(at < 0)
    for i in range(0, len(new), 20_000):
        rows = new[i : i + 20_000]
        part = [given[k] for k in rows.tolist()]
        ids, size = _cut(part, s, letters)
        n, end = len(cache), s["used"] + len(ids)
        while len(s["flat"]) < end:
            s["flat"] = np.concatenate((s["flat"], np.zeros_like(s["flat"])))
        while len(s["start"]) < n + len(part):
            s["start"], s["size"] = (np.concatenate((s[k], np.zeros_like(s[k]))) for k in ("start", "size"))
        s["flat"][s["used"] : end] = ids
        s["start"][n : n + len(part)] = s["used"] + np.cumsum(size) - size
        s["size"][n : n + len(part)] = size
        s["used"] = end
        cache.update(zip(part, range(n, n + len(part))))
        at[rows] = np.arange(n, n + len(part))
    return s["flat"], s["start"][at], s["size"][at]


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, edges): unsigned 16-bit ids of all texts, each with the separator, and where each text begins and ends.

    White space always ends a word for this tokenizer, so texts are split there, and each distinct word is looked up
    once a slice. A word of Latin-1 letters (one run for the tokenizer; case is dropped) with at most one comma or full
    stop after it (a token of its own) has the ids of its stem; all others are encoded as they are."""
    s = _tokenizer(path)
    for blank in "\n\t\r":
        texts = pc.replace_substring(texts, blank, " ")
    split = pc.split_pattern(texts, " ")
    words = split.flatten().dictionary_encode()
    distinct, index = words.dictionary, np.asarray(words.indices)
    plain = np.asarray(pc.match_substring_regex(distinct, LETTERS))
    # distinct words as ranges of one array: first those of letters by their stems, then the others
    flat, size = [], np.zeros(len(distinct), np.int64)
    for letters in (True, False):
        rows = np.flatnonzero(plain == letters)
        if not len(rows):
            continue
        these = distinct.take(pa.array(rows))
        stems = (pc.utf8_lower(pc.utf8_rtrim(these, ".,")) if letters else these).dictionary_encode()
        ids, start, n = _known(stems.dictionary, letters, s)
        of = np.asarray(stems.indices)
        start, n = start[of], n[of]
        if letters:
            for mark in ".,":
                own = np.asarray(pc.ends_with(these, mark))
                size[rows[own]] = n[own] + 1
                flat.append((rows[own], np.insert(_gather(ids, start[own], n[own]), np.cumsum(n[own]), s["marks"][mark])))
            rest = ~np.asarray(pc.match_substring_regex(these, "[.,]$"))
            rows, start, n = rows[rest], start[rest], n[rest]
        size[rows] = n
        flat.append((rows, _gather(ids, start, n)))
    start = np.zeros(len(distinct), np.int64)
    used = 0
    for rows, part in flat:
        start[rows] = used + np.cumsum(size[rows]) - size[rows]
        used += len(part)
    n = size[index]
    upto = np.concatenate(([0], np.cumsum(n)))[np.cumsum(np.asarray(pc.list_value_length(split)))]
    ids = np.insert(_gather(np.concatenate([x for _, x in flat]), start[index], n), upto, SEPARATOR)
    return ids, np.concatenate(([0], upto + np.arange(1, len(upto) + 1)))


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n, key (Hilbert), ids binary (unsigned 16 bits each)."""

    def run(batches):
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, SLICE):
                ids, edges = token_ids(pc.fill_null(batch.column(1).slice(a, b - a), "").cast(pa.large_string()), path)
                v = np.add.reduceat(_tokenizer(path)["plane"][ids], edges[:-1], axis=0)
                v /= np.maximum(np.abs(v).max(1, keepdims=True), 1e-9)
                key = hilbert(((v + 1) * ((1 << BITS) - 1) / 2).round())
                stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(edges * 2), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(edges)), pa.array(key, pa.int64()), stored], ["doc_id", "n", "key", "ids"])
        # the worker may serve other operators next
        _forget(_tokenizer(path))
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, key long, ids binary")


def starts(rows: DataFrame) -> DataFrame:
    """row, start: tokens of all rows before it in the order (key, row), without one task that sees all rows."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialize(rows.repartitionByRange(parts, "key", "row").withColumn("part", F.spark_partition_id()), "order")
    total, before = 0, []
    for part, n in sorted(ordered.groupBy("part").agg(F.sum("n")).collect()):
        before.append((part, total))
        total += n
    base = spark.createDataFrame(before, "part int, base long")
    running = F.sum("n").over(Window.partitionBy("part").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0))
    return ordered.withColumn("upto", running).join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("upto") - F.col("n")).alias("at"))


def pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids."""
    with few_texts(docs.sparkSession):
        stored = materialize(tokens(docs, path).withColumn("row", F.monotonically_increasing_id()), "tokens")
    at = starts(stored.select("row", "key", "n"))

    def run(batches):
        for batch in batches:
            out = []
            for doc, n, ids, at in zip(*(batch.column(k).to_pylist() for k in range(4))):
                ids = np.frombuffer(ids, np.uint16).astype("<u4")
                cuts = [0, *range(length - at % length, n, length), n]
                for a, b in zip(cuts, cuts[1:]):
                    part = ids[a:b]
                    out.append((doc, a, b - a, zlib.crc32(part.tobytes()), n, (at + a) // length, (at + a) % length, part.astype(np.int32) if with_ids else None))
            columns = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:7]] + ([pa.array(columns[7], pa.list_(pa.int32()))] if with_ids else []), names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kind = pa.int64() if docs.schema["doc_id"].dataType.simpleString() == "bigint" else None
    joined = stored.join(at, "row").select("doc_id", "n", "ids", "at")
    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names[1:7]) + ", ids array<int>" * with_ids)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
