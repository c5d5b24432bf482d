"""MinHash near-dedup by a containment ensemble.

Two documents are near-duplicates when their sets of 5-word shingles share at least 0.8 of the smaller set: one contains
the other to 0.8, whatever its own size. With `mutual`, they must share 0.8 of the larger set. Documents are filed twice:

Bands, for sets of like size that contain each other. Documents are partitioned by set size (powers of two). In a
partition the mutual bound becomes a Jaccard bound (for sizes a <= b it is t / (a/b + 1 - t), and whole shingles raise it
for small sets), and bands are tuned for that bound alone, so that a pair at the bound is missed with a probability below
1e-4. A document is filed in its own partition and, where 0.8 of its size reaches below it, in the next lower one under
that partition's bands.

Least hashes, for a set within one of any larger size (not if `mutual`). A set asks for its 24 least hashes (all, if
fewer); every set is filed under all of its hashes that any set asks for. A set that is contained to 0.8 finds at least
`hits` of its own there (always, up to 24 shingles; else missed with a probability below 1e-6), so it has to ask for the
rarest only, all but hits - 1 of those that others hold, and common boilerplate is not among them. An eighth of the range
of hashes is filed by all; what is asked for above it (by small sets) goes to all readers of the texts as a bit filter of
bounded size, in several passes when there is more.

Candidates of both are verified on the exact sets. Equal sets are collapsed first (one aggregation on 128 bits). A bucket
then gives one candidate a member: with its least member (bands), or with the smallest set that asks, if the other one
holds `hits` of its least hashes. What sets ask for is then reduced to hashes held in another component of the verified
links. A hash with at most PAIRED holders pairs each that asks with each of another component, and pairs with `hits` such
hashes are verified. The members of the other hashes (if mutual, of all bands) in several components are compared across
them by a prefix filter: a set that shares 0.8 of itself with another must share one of its first shingles (a fifth of
the set, and one) in any order, and rarest first keeps those groups small, so boilerplate that fills a bucket pairs
nobody. Pairs within a component, and those compared before, are not formed again.

Cases: a text of 1 to 4 words is one shingle; a text without words (null, empty) is a class of its own; null doc_id likewise;
repeated rows and ties share a class, whose id is the least doc_id; extra columns are ignored by the query, kept by
`keep_first`; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, few_texts, grams, materialize, mix, slices, table, utf8, words
from tessera.llm.components import components

SHINGLE, CONTAINMENT, PERMUTATIONS, MISS = 5, 0.8, 160, 1e-4
#: Least hashes that a set asks for; of so many at least HITS are in a set that contains it (see below), with this risk.
SKETCH, SKETCH_MISS = 24, 1e-6
#: Every hash below 2^RATE_BITS is filed (an eighth of them); filters have at most 2^FILTER_BITS bits (64 MB), 16 or more a hash.
RATE_BITS, FILTER_BITS = 61, 29
#: Holders of a hash up to which they are paired with those that ask; the members of larger buckets go through the prefix filter.
PAIRED = 1024
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)


def bound(low: int, high: int, t: float = CONTAINMENT) -> float:
    """Least Jaccard similarity of two sets with sizes of low to high, one of them contained to t in the other and reversely."""
    least = 1.0
    for b in {low, high, *range(low, min(high, low + 64) + 1)}:
        shared = math.ceil(t * b - 1e-9)
        for a in {min(b, high), max(low, shared)}:
            if shared <= a:
                least = min(least, shared / (a + b - shared))
    return least


def banding(j: float, permutations: int = PERMUTATIONS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows with which a pair at similarity j is missed with at most that probability, and as
    few bands as that takes."""
    for r in range(16, 0, -1):
        b = 1 if j >= 1 else math.ceil(math.log(miss) / math.log1p(-(j**r)))
        if b * r <= permutations:
            return b, r
    return permutations, 1


def tuned(part: int) -> tuple[int, int]:
    """Bands of the partition with sizes of 2^part and more, below 2^(part+1); and of larger sets filed there too."""
    low, high = 1 << part, (1 << part + 1) - 1
    return banding(bound(max(1, low), max(high, int(high / CONTAINMENT))))


def promised(draws: int = SKETCH, miss: float = SKETCH_MISS) -> int:
    """Of so many shingles of a large set, those that a set containing it to the bound holds but for that probability."""
    q, risk = 0, 0.0
    while (risk := risk + math.comb(draws, q) * CONTAINMENT**q * (1 - CONTAINMENT) ** (draws - q)) <= miss:
        q += 1
    return q


HITS = promised()


def shingles(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each text's distinct shingles, sorted by row."""
    at, g = grams(h, row, SHINGLE, 5)
    r = row[at]
    counts = np.bincount(row, minlength=rows)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.array([mix(np.array([int(np.bitwise_xor.reduce(mix(h[f : f + counts[s]] + np.arange(counts[s], dtype=np.uint64))))], np.uint64))[0] for s, f in zip(short, first)], np.uint64)
        r, g = np.concatenate((r, short)), np.concatenate((g, extra))
    order = np.lexsort((g, r))
    r, g = r[order], g[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return r[new], g[new]


def _sets(batch):
    """(rows, those of them with words, size and first hash of each set, hashes in order) of slices of the texts."""
    data, offsets = utf8(batch.column(1))
    for a, b in slices(offsets, 500_000):
        _, _, row, h = words(data, offsets[a : b + 1])
        r, g = shingles(h, row, b - a)
        size = np.bincount(r, minlength=b - a)
        has = np.flatnonzero(size)
        if len(has):
            yield slice(a, b), has, size[has], np.cumsum(size[has]) - size[has], g


def _name(g: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    return np.add.reduceat(mix(g * np.uint64(2 * seed + 1) + np.uint64(seed)), first)


def _asked(size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of the hashes, in order, are among the least of their sets."""
    return np.arange(size.sum()) - np.repeat(first, size) < SKETCH


def _describe(batches):
    """doc -> size and 128 bits of the set, its bucket keys, and what it asks for above the hashes that all file."""
    for batch in batches:
        for at, has, size, first, g in _sets(batch):
            both = [_name(g, first, seed) for seed in (11, 23)]
            low = g >> np.uint64(1)
            sig = np.stack([np.minimum.reduceat(low * m >> np.uint64(32), first) for m in _A])
            keys: list[list] = [[] for _ in has]
            part = np.floor(np.log2(size)).astype(np.int64)
            below = np.floor(np.log2(np.ceil(CONTAINMENT * size - 1e-9))).astype(np.int64)
            for p in np.unique(np.concatenate((part, below))):
                members = np.flatnonzero((part == p) | (below == p))
                n, rows = tuned(int(p))
                made = np.zeros((n, len(members)), np.uint64)
                for k in range(n):
                    key = np.full(len(members), (int(p) << 16) + k, np.uint64)
                    for j in range(k * rows, k * rows + rows):
                        key = mix(key ^ sig[j][members])
                    made[k] = key
                for m, own in zip(members, np.ascontiguousarray(made.T).view(np.int64)):
                    keys[m].append(own)
            flat = [np.concatenate(k) for k in keys]
            edges = np.cumsum([0] + [len(k) for k in flat]).astype(np.int32)
            rare = _asked(size, first) & (g >> np.uint64(RATE_BITS) > 0)
            ends = np.concatenate(([0], np.cumsum(np.add.reduceat(rare.astype(np.int32), first)))).astype(np.int32)
            doc = batch.column(0)[at].take(pa.array(has))
            lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(x)) for e, x in ((edges, np.concatenate(flat)), (ends, g[rare].view(np.int64)))]
            yield pa.RecordBatch.from_arrays([doc, pa.array(size), *[pa.array(x.view(np.int64)) for x in both], *lists], ["doc", "size", "s1", "s2", "keys", "rare"])


def _width(n: int, most: int = FILTER_BITS) -> int:
    """Bits, as a power of 2, of a filter of n hashes."""
    return min(max(math.ceil(math.log2(16 * n)), 16), most)


def _filter(hashes: DataFrame, width: int) -> np.ndarray:
    """A bit filter of 2^width bits, two of them set for each of the hashes (gram)."""
    at = hashes.select(F.explode(F.array(*[F.shiftrightunsigned("gram", k).bitwiseAND(F.lit((1 << width) - 1)) for k in (0, width)])).alias("p"))
    full = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << width - 6, np.uint64)
    bits[full["word"].to_numpy()] = full["bits"].to_numpy().view(np.uint64)
    return bits


def _passing(bits: np.ndarray, width: int, g: np.ndarray) -> np.ndarray:
    """Which of the hashes a filter lets through: all that it was made of, and few others."""
    take, mask = np.ones(len(g), bool), np.uint64((1 << width) - 1)
    for p in (g & mask, g >> np.uint64(width) & mask):
        take &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return take


def _holding(filter_, width: int, part: int, parts: int):
    """Each set's hashes that all file (in the first part), and those of the part that the filter lets through."""

    def file(batches):
        for batch in batches:
            for _, _, size, first, g in _sets(batch):
                low = g >> np.uint64(RATE_BITS) == 0
                take = ~low & ((g >> np.uint64(56)) % np.uint64(parts) == part) & _passing(filter_.value, width, g)
                if part == 0:
                    take |= low
                name = np.repeat(_name(g, first, 11), size)[take]
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(g[take].view(np.int64)), pa.array(_asked(size, first)[take])], ["set", "gram", "asks"])

    return file


def _among(filter_, width: int):
    """(doc, text) of the rows (doc, text, hash of doc) that the filter lets through."""

    def keep(batches):
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(_passing(filter_.value, width, batch.column(2).to_numpy().view(np.uint64))))

    return keep


def _grams(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in slices(offsets, 500_000):
            _, _, row, h = words(data, offsets[a : b + 1])
            r, g = shingles(h, row, b - a)
            edges = np.searchsorted(r, np.arange(b - a + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(edges), pa.array(g.view(np.int64)))], ["doc", "grams"])


def holders(docs: DataFrame, described: DataFrame, same: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(set, gram, asks, doc, size): of the described docs, the sets that hold a hash that one of several asks for; with
    its first document and size, by same: (size, s1, s2, first)."""
    spark = docs.sparkSession
    rare = described.select(F.explode("rare").alias("gram"))
    n = max(rare.count(), 1)
    parts = min(-(-16 * n >> filter_bits), 128)
    width = _width(-(-n // parts), filter_bits)
    filed = []
    for part in range(parts):
        mine = rare.where(F.pmod(F.shiftrightunsigned("gram", 56), F.lit(parts)) == part) if parts > 1 else rare
        sent = spark.sparkContext.broadcast(_filter(mine, width))
        with few_texts(spark):
            filed.append(materialize(docs.mapInArrow(_holding(sent, width, part, parts), "set long, gram long, asks boolean"), "held"))
        sent.destroy()
    # Shuffled once for both of its readers, whose plans are alike only if neither has to drop nulls.
    held = functools.reduce(DataFrame.union, filed).where("set is not null and gram is not null").repartition("gram")
    shared = held.groupBy("gram").agg(F.min("set").alias("x"), F.max("set").alias("y"), F.max("asks").alias("asked")).where("x < y and asked").select("gram")
    firsts = same.select(F.col("s1").alias("set"), F.col("first").alias("doc"), "size")
    named = materialize(held.join(shared.hint("merge"), "gram").distinct().join(firsts.hint("merge"), "set").select("set", "gram", "asks", "doc", "size"), "named")
    discard(*filed)
    return named


def _hits():
    """How many of its least hashes a set of the column size finds in one that contains it."""
    shared = F.ceil(F.lit(CONTAINMENT) * F.col("size") - 1e-9)
    return F.when(F.col("size") <= SKETCH, shared).otherwise(F.greatest(F.lit(SKETCH) - F.col("size") + shared, F.lit(HITS)))


def asking(held: DataFrame) -> DataFrame:
    """(set, doc, size, c, gram, n): what the sets of holders(), each with its c, ask for of sets of another c: the rarest
    of their hashes that one of another c holds, all but hits - 1; n sets hold it."""
    often = held.groupBy("gram").agg(F.count("*").alias("n"), F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("gram", "n")
    ranked = held.where("asks").join(often.hint("merge"), "gram").groupBy("set", "doc", "size", "c").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("of"))
    left = F.greatest(F.size("of") - _hits() + 1, F.lit(0)).cast("int")
    return ranked.select("set", "doc", "size", "c", F.explode(F.slice("of", F.lit(1), left)).alias("x")).select("set", "doc", "size", "c", "x.gram", "x.n")


def paired(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b): the documents that ask and those of another c that hold it and as many of the least hashes as hits."""
    sides = asked.select("gram", F.col("set").alias("sa"), F.col("doc").alias("a"), "size", F.col("c").alias("ca")).join(held.select("gram", F.col("set").alias("sb"), F.col("doc").alias("b"), F.col("size").alias("larger"), "c").hint("merge"), "gram")
    pairs = materialize(sides.where("ca <> c and size <= larger").select("sa", "sb", "a", "b", "size").distinct(), "pairs")
    of, has = (t.groupBy(F.col("set").alias(s)).agg(F.collect_list("gram").alias(g)) for t, s, g in ((held.where("asks"), "sa", "ga"), (held, "sb", "gb")))
    both = pairs.join(of.hint("merge"), "sa").join(has.hint("merge"), "sb")
    found = materialize(both.where(F.size(F.array_intersect("ga", "gb")) >= _hits()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "paired")
    discard(pairs)
    return found


def sets_of(docs: DataFrame, some: DataFrame) -> DataFrame:
    """(doc, grams) of some of the docs. A bit filter stops nearly all other texts before the join shuffles them."""
    some = materialize(some.toDF("doc").distinct(), "some")
    hashed = F.xxhash64("doc").alias("gram")
    width = _width(max(some.count(), 1))
    sent = docs.sparkSession.sparkContext.broadcast(_filter(some.select(hashed), width))
    near = docs.select("doc", "text", hashed).mapInArrow(_among(sent, width), "doc long, text string")
    with few_texts(docs.sparkSession):
        sets = materialize(near.join(some.hint("merge"), "doc", "left_semi").mapInArrow(_grams, "doc long, grams array<long>"), "sets")
    sent.destroy()
    discard(some)
    return sets


def verified(pairs: DataFrame, sets: DataFrame, mutual: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets (doc, grams) share the bound of the smaller one; of the larger one, if mutual."""
    joined = pairs.join(sets.toDF("a", "ga").hint("merge"), "a").join(sets.toDF("b", "gb").hint("merge"), "b")
    smaller, larger = (f(F.size("ga"), F.size("gb")) for f in (F.least, F.greatest))
    if mutual:
        joined = joined.where(smaller >= F.lit(CONTAINMENT) * larger)
    return materialize(joined.where(F.size(F.array_intersect("ga", "gb")) >= F.lit(CONTAINMENT) * (larger if mutual else smaller)).select("a", "b"), "links")


def across(placed: DataFrame, sets: DataFrame, mutual: bool = True) -> DataFrame:
    """(a, b): of the documents (doc, c) with sets (doc, grams) all pairs of different c that may contain each other, or,
    if not mutual, of which one may contain the other."""
    size = F.size("grams")
    each = materialize(placed.join(sets.hint("merge"), "doc").select("doc", "c", size.alias("size"), F.explode("grams").alias("gram")), "shingles")
    often = each.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    # shingles of one document come first in the order, and pair nobody: they only use up places
    places = (F.col("size") - F.ceil(F.lit(CONTAINMENT) * F.col("size") - 1e-9) + 1).cast("int")
    ranked = each.join(often.hint("merge"), "gram").groupBy("doc", "c", "size").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("of"))
    left = F.greatest(places - (F.col("size") - F.size("of")), F.lit(0)).cast("int")
    filed = materialize(ranked.select("doc", "c", "size", F.explode(F.slice("of", F.lit(1), left)).alias("x")).select("doc", "c", "size", "x.gram"), "prefixes")
    # a set that contains another one holds a first shingle of that one anywhere, if it need not be contained itself
    held = filed if mutual else materialize(each.join(filed.select("gram").distinct().hint("merge"), "gram", "left_semi").select(*filed.columns), "holding")
    discard(each)
    open_ = held.groupBy("gram").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("gram")
    side, other = (t.select("gram", "doc", "c", "size").join(open_.hint("merge"), "gram", "left_semi") for t in (filed, held))
    pairs = side.toDF("gram", "a", "ca", "sa").join(other.toDF("gram", "b", "cb", "sb").hint("merge"), "gram")
    near = (F.col("a") < F.col("b")) & (F.least("sa", "sb") >= F.lit(CONTAINMENT) * F.greatest("sa", "sb")) if mutual else F.col("sa") <= F.col("sb")
    found = materialize(pairs.where("ca <> cb").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "across")
    discard(filed, held)
    return found


def classes(docs: DataFrame, mutual: bool = False) -> DataFrame:
    """(doc, class_id) of every doc of (doc, text) that has words; doc is not null. A doc_id of several rows has the
    class of each of their texts joined. Texts are read to describe all sets, to file their hashes (not if mutual; once
    for each part of the filter), and to send the sets of documents that are to be compared (twice, if not mutual); they
    are never shuffled themselves but for the last. What nothing reads any more is deleted before the next step that
    shuffles much."""
    with few_texts(docs.sparkSession):
        described = materialize(docs.mapInArrow(_describe, "doc long, size long, s1 long, s2 long, keys array<long>, rare array<long>"), "described")
    sets, rare = materialize(described.select("doc", "size", "s1", "s2"), "names"), materialize(described.select("rare"), "rare")
    same = sets.groupBy("size", "s1", "s2").agg(F.min("doc").alias("first"))
    equal = materialize(sets.join(same.hint("merge"), ["size", "s1", "s2"]).select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct(), "equal")
    firsts = equal.where("a = b").select(F.col("a").alias("doc"))
    filed = materialize(described.join(firsts.hint("merge"), "doc", "left_semi").select("doc", F.explode("keys").alias("key")), "bands")
    discard(described)
    buckets = filed.groupBy("key").agg(F.min("doc").alias("lead"), F.max("doc").alias("top")).where("lead < top").select("key", "lead")
    members = materialize(filed.join(buckets.hint("merge"), "key").select("key", "lead", "doc").distinct(), "members")
    discard(filed)
    star = members.where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b"))
    if not mutual:
        held = holders(docs, rare, same)
        apart = held.withColumn("c", F.col("doc"))
        asked = materialize(asking(apart), "asked")
        first = asked.groupBy("gram").agg(F.min(F.struct("size", "set"))["set"].alias("set"))
        led = paired(asked.join(first.hint("merge"), ["gram", "set"]), apart)
        star = star.union(led)
    star = materialize(star.distinct(), "star")
    grams_of = sets_of(docs, star.select("a").union(star.select("b")))
    links = verified(star, grams_of, mutual)
    if not mutual:
        discard(grams_of)
    found = components(links)
    # Documents that the links leave in a bucket with one of another component: compare across components.
    filed = members.select(F.col("key").alias("gram"), "doc") if mutual else held
    placed = materialize(filed.join(found.withColumnRenamed("id", "doc"), "doc", "left").select(*filed.columns, F.coalesce("component", "doc").alias("c")), "placed")
    if mutual:
        rest, split = [], placed.groupBy("gram").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y")
    else:
        still = materialize(asking(placed), "asked")
        near, split = paired(still.where(F.col("n") <= PAIRED), placed), still.where(F.col("n") > PAIRED)
    open_ = materialize(placed.join(split, "gram", "left_semi").select("doc", "c").distinct(), "open")
    if not mutual:
        rest = [asked, near, held, led, still]
        grams_of = sets_of(docs, open_.select("doc").union(near.select("a")).union(near.select("b")))
    pairs = across(open_, grams_of, mutual)
    more = verified((pairs if mutual else pairs.union(near).distinct()).join(star, ["a", "b"], "left_anti"), grams_of, mutual)
    group = materialize(components(links.union(more).union(equal)), "classes")
    out = materialize(sets.select("doc").distinct().join(group.withColumnRenamed("id", "doc").hint("merge"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("class_id")), "classes")
    discard(sets, rare, equal, members, star, grams_of, links, found, placed, open_, pairs, more, group, *rest)
    return out


def _plain(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, mutual: bool = False) -> DataFrame:
    """One row a document: doc_id, class_id (least doc_id of its class), kept."""
    group = classes(_plain(docs), mutual).withColumnRenamed("doc", "doc_id")
    return docs.select("doc_id").join(group.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).withColumn("kept", F.col("class_id").isNull() | (F.col("class_id") == F.col("doc_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without those that are near-duplicates of a document with a smaller doc_id; all its columns."""
    gone = classes(_plain(docs)).where("doc <> class_id").select(F.col("doc").alias("doc_id"))
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
