"""Embedding near-dedup: cross-polytope hashing after Hadamard rotations, multiprobe buckets, verified pairs.

Vectors of one label are compared. Equal vectors are collapsed first and counted. A table's code is the pair of nearest
signed axes under two rotations; a vector is filed under its own code and under the next one in probe order (the axis whose
loss is least is replaced). A pair at the bound of 0.93 shares a bucket of one of the TABLES with a probability over
0.9999. Buckets of one vector are dropped before vectors are joined; larger ones are cut into blocks, and all
pairs of blocks are compared, so that no task holds a whole bucket. A block yields the number of links of each
vector (a pair counts in its first common bucket only) and a spanning forest of them, never its pairs.

Cases: a null label, and null, zero or non-finite vectors, link with nothing and are their own component; vectors of
different lengths don't link; repeated vec_ids are one vector where they are equal and else share its links and component; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.llm.components import components
from tessera.llm.cross_polytope import axes, by_length, grouped, matrix, prepared, rotate

COSINE, TABLES, BLOCK = 0.93, 14, 1024


def codes(x: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """(n, 2 * tables): own code and next code of each table."""
    out = []
    for t in range(tables):
        both = []
        for half in range(2):
            y = rotate(x, 1000 + 2 * t + half)
            two = axes(y, 2)
            reach = np.take_along_axis(np.stack((y, -y), axis=2).reshape(len(y), -1), two, 1)
            both.append((two, reach[:, 0] - reach[:, 1]))
        (a, la), (b, lb) = both
        own = a[:, 0] << 12 | b[:, 0]
        other = np.where(la < lb, a[:, 1] << 12 | b[:, 0], a[:, 0] << 12 | b[:, 1])
        out += [own + (t << 24), other + (t << 24)]
    return np.stack(out, axis=1).astype(np.int64)


def _file(batches):
    for batch in (part for whole in batches for part in by_length(whole, 1)):
        x = matrix(batch.column(1))
        if len(x):
            c = codes(x / np.linalg.norm(x, axis=1, keepdims=True))
            n = c.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * n + 1, n, dtype=np.int32)), pa.array(c.ravel()))], ["id", "codes"])


def _forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of the pairs that join two trees."""
    root: dict[int, int] = {}

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            kept.append(k)
    return kept


def _links(cosine: float):
    def run(batches):
        for group in grouped(batches, "g"):
            ids, v = np.asarray(group.column("id").to_numpy()), matrix(group.column("v"))
            c = np.asarray(group.column("codes").combine_chunks().flatten()).reshape(len(ids), -1)
            code = group.column("code")[0].as_py()
            block, m = group.column("block").to_numpy(), group.column("m").to_numpy()
            i0, j0 = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            left, right = np.flatnonzero(block == i0), np.flatnonzero(block == j0)
            u = v / np.sqrt((v * v).sum(1))[:, None]
            count, a_all, b_all = np.zeros(len(ids), np.int64), [], []
            for s in range(0, len(left), 256):
                part = left[s : s + 256]
                i, j = np.nonzero(u[part] @ u[right].T >= cosine - 1e-9)
                i, j = part[i], right[j]
                ok = ids[i] < ids[j] if i0 == j0 else ids[i] != ids[j]
                i, j = i[ok], j[ok]
                dot = (v[i] * v[j]).sum(1) / (np.sqrt((v[i] * v[i]).sum(1)) * np.sqrt((v[j] * v[j]).sum(1)))
                i, j = i[dot >= cosine], j[dot >= cosine]
                if not len(i):  # most buckets hold vectors that only met by chance
                    continue
                # the first common bucket in code order; codes of a table differ only within it
                first = np.full(len(i), np.iinfo(np.int64).max)
                for k in range(c.shape[1]):
                    twin = k ^ 1
                    for other in (k, twin):
                        same = c[i, k] == c[j, other]
                        first = np.where(same, np.minimum(first, c[i, k]), first)
                i, j = i[first == code], j[first == code]
                np.add.at(count, i, m[j])
                np.add.at(count, j, m[i])
                kept = _forest(i, j)
                a_all.append(ids[i[kept]])
                b_all.append(ids[j[kept]])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_all, b_all))
            has = np.flatnonzero(count)
            if not len(has):
                continue
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[has], a))), pa.array(np.concatenate((ids[has], b))), pa.array(np.concatenate((count[has], np.zeros(len(a), np.int64))))], ["a", "b", "n"])

    return run


def links(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, n): a = b: n links of a's; else an edge of the forest; from rows (id, label, v, m), vectors distinct."""
    filed = materialize(rows.select("id", "v").mapInArrow(_file, "id long, codes array<long>").join(rows.select("id", "label", "m"), "id"), "codes")
    each = filed.select("id", "label", F.explode(F.array_distinct("codes")).alias("code"))
    sizes = each.groupBy("label", "code").count().where("count > 1").select("label", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb"))
    placed = each.join(sizes, ["label", "code"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    # each pair of blocks i <= j: a member of block k goes to (k, j) for j >= k and to (i, k) for i < k
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"))))
    spread = placed.withColumn("p", pairs).select("id", "label", "code", "block", "p.i", "p.j")
    full = spread.join(filed.select("id", "codes", "m"), "id").join(rows.select("id", "v"), "id")
    full = full.select(F.xxhash64("label", "code", "i", "j").alias("g"), "id", "v", "codes", "code", "block", "m", "i", "j")
    return materialize(full.repartition("g").sortWithinPartitions("g").mapInArrow(_links(cosine), "a long, b long, n long"), "links")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    rows = prepared(vectors.where("label is not null"), "label").withColumn("label", F.struct("label", F.size("v").alias("length"))).withColumn("vec_id", F.col("vec_id").cast("long")).distinct()
    equal = materialize(rows.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("m")), "vectors")
    same = materialize(rows.join(equal, ["label", "v"]).select("vec_id", "id", "m"), "same")
    found = links(equal, cosine)
    group = components(found.where("a <> b").select("a", "b").union(same.select("id", "vec_id").where("id <> vec_id")))
    counts = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    per = same.join(counts, "id", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = vectors.select("vec_id").join(per, "vec_id", "left").join(group.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
