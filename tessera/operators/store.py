"""Versioned collections of vectors: each write is a new Parquet version and a new numbered pointer file.

The pointer with the highest number counts. A writer renames its pointer to the number after the one it read, which fails
if another writer was first; it then reads anew and tries again. Readers always find a whole version: the one before the
current is kept for those that began with it, older ones are deleted.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping
from hashlib import sha256
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.predicates import matches


class DimensionMismatch(ValueError):
    """Vectors of another length than the collection's."""


class ModelMismatch(ValueError):
    """Another embedding model than the collection's."""


class MissingCollection(KeyError):
    """No such collection."""


class Conflict(RuntimeError):
    """Another writer was first, each time."""


def collection_name(kb_id: Column) -> Column:
    """Readable part of at most 32 characters and 12 hex digits of the id's hash."""
    return F.concat(F.lit("kb_"), F.substring(F.regexp_replace(kb_id, "[^A-Za-z0-9_]", "_"), 1, 32), F.lit("_"), F.substring(F.sha2(kb_id, 256), 1, 12))


def last_of(batch: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key by position."""
    others = [c for c in batch.columns if c not in (key, position)]
    return batch.groupBy(key).agg(F.max_by(F.struct(*others), position).alias("r")).select(key, "r.*")


def upserted(target: DataFrame, batch: DataFrame, key: str, position: str) -> DataFrame:
    new = last_of(batch, key, position)
    return target.join(new.select(key), key, "left_anti").select(*target.columns).unionByName(new.select(*target.columns))


def remaining(target: DataFrame, where: Column | None, ids: DataFrame | None, key: str) -> DataFrame:
    """target without the rows that the condition and the ids (both, where both are given) name; neither is an error."""
    if where is None and ids is None:
        raise ValueError("deletion needs ids or a filter")
    gone = target if where is None else target.where(where)
    if ids is not None:
        gone = gone.join(ids.select(key), key, "left_semi")
    return target.join(gone.select(key), key, "left_anti")


def stale_tail(chunks: DataFrame, source_id: Any, n: int) -> Column:
    """Chunks of a source's earlier version beyond its n new ones."""
    return (F.col("source_id") == source_id) & (F.col("chunk_index") >= n)


class Store:
    """Collections under one folder: <root>/<name>/v-*/ and <root>/<name>/current.json."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, kb_id: str) -> str:
        return f"{self.root}/kb_{re.sub('[^A-Za-z0-9_]', '_', kb_id)[:32]}_{sha256(kb_id.encode()).hexdigest()[:12]}"

    def _pointers(self, kb_id: str) -> list[int]:
        fs, folder = self._fs(), self._path(self._folder(kb_id))
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[8:-5]) for n in names if re.fullmatch(r"pointer-[0-9]+\.json", n))

    def _pointer(self, kb_id: str, number: int) -> str:
        return f"{self._folder(kb_id)}/pointer-{number}.json"

    def info(self, kb_id: str) -> dict:
        """dim, model, version and the pointer's number."""
        known = self._pointers(kb_id)
        if not known:
            raise MissingCollection(kb_id)
        return json.loads(self.spark.read.text(self._pointer(kb_id, known[-1]), wholetext=True).first()[0]) | {"number": known[-1]}

    def _point(self, kb_id: str, info: dict, seen: int) -> bool:
        """Make info current, unless the pointer after `seen` is already there."""
        fs, folder, jvm = self._fs(), self._folder(kb_id), self.spark._jvm
        new, now = self._path(f"{folder}/next-{uuid.uuid4().hex}"), self._path(self._pointer(kb_id, seen + 1))
        out = fs.create(new)
        out.write(bytearray(json.dumps({k: v for k, v in info.items() if k != "number"}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(new, now, none)
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            fs.delete(new, False)
            return False
        for number in self._pointers(kb_id)[:-2]:
            old = json.loads(self.spark.read.text(self._pointer(kb_id, number), wholetext=True).first()[0])["version"]
            fs.delete(self._path(self._pointer(kb_id, number)), False)
            if old is not None:
                fs.delete(self._path(f"{folder}/{old}"), True)
        return True

    def ensure(self, kb_id: str, dim: int, model: str = "") -> None:
        if dim <= 0:
            raise ValueError("dim must be positive")
        try:
            known = self.info(kb_id)
        except MissingCollection:
            if self._point(kb_id, {"kb_id": kb_id, "dim": dim, "model": model, "version": None}, 0):
                return
            known = self.info(kb_id)
        if known["dim"] != dim:
            raise DimensionMismatch(f"{kb_id}: {known['dim']}, not {dim}")
        if known["model"] != model:
            raise ModelMismatch(f"{kb_id}: {known['model']!r}, not {model!r}")

    def rows(self, kb_id: str, info: dict | None = None) -> DataFrame:
        info = info or self.info(kb_id)
        if info["version"] is None:
            return self.spark.createDataFrame([], "id string, text string, embedding array<float>, source_id string, chunk_index int")
        return self.spark.read.parquet(f"{self._folder(kb_id)}/{info['version']}")

    def _change(self, kb_id: str, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> DataFrame:
        """Replace the rows by change(rows), on whatever version is current when it succeeds; the rows it replaced."""
        for _ in range(tries):
            info = self.info(kb_id)
            old, version = self.rows(kb_id, info), f"v-{uuid.uuid4().hex}"
            change(old).write.parquet(f"{self._folder(kb_id)}/{version}")
            if self._point(kb_id, info | {"version": version}, info["number"]):
                return old
            self._fs().delete(self._path(f"{self._folder(kb_id)}/{version}"), True)
        raise Conflict(kb_id)

    def upsert(self, kb_id: str, batch: DataFrame, position: str = "pos") -> None:
        """Rows (id, text, embedding, ..., pos): all lengths are checked before anything is written; the last of an id wins."""
        dim = self.info(kb_id)["dim"]
        if batch.where(F.col("embedding").isNull() | (F.size("embedding") != dim)).head(1):
            raise DimensionMismatch(f"{kb_id}: not {dim}")

        def change(old: DataFrame) -> DataFrame:
            new = batch
            for c in batch.columns:
                if c != position and c not in old.columns:
                    old = old.withColumn(c, F.lit(None).cast(batch.schema[c].dataType))
            for c in old.columns:
                if c not in batch.columns:
                    new = new.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
            return upserted(old, new, "id", position)

        self._change(kb_id, change)

    def delete(self, kb_id: str, ids: list[str] | None = None, given: Mapping[str, Any] | None = None) -> int:
        """Number of rows deleted. An empty filter is refused: it would delete everything."""
        if given is not None and not given:
            raise ValueError("an empty filter would delete everything")
        keys = None if ids is None else self.spark.createDataFrame([(i,) for i in ids], "id string")
        left = lambda old: remaining(old, None if given is None else matches(given, {c: F.col(c) for c in old.columns}), keys, "id")
        old = self._change(kb_id, left)
        return old.count() - left(old).count()

    def count(self, kb_id: str, given: Mapping[str, Any] | None = None) -> int:
        rows = self.rows(kb_id)
        return rows.where(matches(given, {c: F.col(c) for c in rows.columns})).count()

    def drop(self, kb_id: str) -> None:
        self._fs().delete(self._path(self._folder(kb_id)), True)
