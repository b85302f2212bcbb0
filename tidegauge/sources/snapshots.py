"""Versioned tables: a commit is one small manifest that appears whole or not at all.

Rows lie in parquet folders that are never changed. A manifest names the folders of one version: ``base`` folders, and
``deltas`` with newer rows of their keys. A write puts its folder down first and then renames the manifest of the next
version into place, so a write that fails leaves the table as it was, a reader keeps the version it opened, and of two
writers to one version the second fails. Reading lays the deltas over the base, newest row of a key first; ``compact``
folds them in. A writer may name its commits by batch, as a stream does; a batch that is committed already is left out,
so a replay changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.panel import keep_last
from .tables import drop_path


def consume(df: DataFrame) -> None:
    """Runs ``df`` and keeps nothing. A micro-batch of a stateful stream must run whole, also when its rows are known."""
    df.write.format("noop").mode("overwrite").save()


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: str = ""
    keys: tuple[str, ...] = ()
    base: tuple[str, ...] = ()
    deltas: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)
    """Last committed batch of each writer."""

    def folders(self) -> tuple[str, ...]:
        return (*self.base, *self.deltas)


class SnapshotTable:
    """A table of ``path``. ``keys`` are needed by ``upsert``; ``order`` names the column that decides within a batch."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), order: str | None = None, most_deltas: int = 8) -> None:
        self.spark, self.path, self.keys, self.order, self.most_deltas = spark, path.rstrip("/"), tuple(keys), order, most_deltas

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The named version, or the newest; an empty one where nothing was committed."""
        known = self.versions()
        if version is None:
            if not known:
                return Manifest(keys=self.keys)
            version = known[-1]
        elif version not in known:
            raise FileNotFoundError(f"{self.path} has no version {version}")
        jvm, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(self._manifest_path(version)))
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        raw = json.loads(text)
        return Manifest(raw["version"], raw["schema"], tuple(raw["keys"]), tuple(raw["base"]), tuple(raw["deltas"]), raw["batches"])

    def _commit(self, new: Manifest) -> Manifest:
        jvm, fs = self._fs()
        Path = jvm.org.apache.hadoop.fs.Path
        staged = Path(f"{self.path}/manifests/.{uuid.uuid4().hex}.tmp")
        out = fs.create(staged, True)
        try:
            out.write(bytearray(json.dumps(new.__dict__).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri() if staged.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        nothing = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(staged), fs.makeQualified(Path(self._manifest_path(new.version))), nothing)
        except Exception as error:
            fs.delete(staged, False)
            if "FileAlreadyExists" in str(error):
                raise CommitConflict(f"{self.path} has a version {new.version} already") from error
            raise
        return new

    def _put(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def committed(self, writer: str, batch: int) -> bool:
        return self._seen(self.manifest(), writer, batch)

    def _seen(self, now: Manifest, writer: str | None, batch: int | None) -> bool:
        return writer is not None and batch is not None and now.batches.get(writer, -1) >= batch

    def _next(self, now: Manifest, writer: str | None, batch: int | None, **changes) -> Manifest:
        batches = {**now.batches, writer: batch} if writer is not None and batch is not None else now.batches
        return replace(now, version=now.version + 1, batches=batches, **changes)

    def replace(self, df: DataFrame, writer: str | None = None, batch: int | None = None) -> Manifest:
        """All rows anew. ``df`` may read the table itself."""
        now = self.manifest()
        if self._seen(now, writer, batch):
            return now
        return self._commit(self._next(now, writer, batch, schema=df.schema.json(), keys=self.keys, base=(self._put(df),), deltas=()))

    def append(self, df: DataFrame, writer: str | None = None, batch: int | None = None) -> Manifest:
        """More rows beside the present ones, whatever their keys."""
        now = self.manifest()
        if self._seen(now, writer, batch):
            return now
        if now.deltas:
            raise ValueError("a table with deltas takes no appended rows; compact it first")
        return self._commit(self._next(now, writer, batch, schema=now.schema or df.schema.json(), base=(*now.base, self._put(df))))

    def upsert(self, df: DataFrame, writer: str | None = None, batch: int | None = None) -> Manifest:
        """Rows of ``df`` take the place of those with equal keys; only ``df`` is written. Where a batch repeats a key, the
        row of the greatest ``order`` wins. New columns are NULL in older rows."""
        if not self.keys:
            raise ValueError("upsert needs keys")
        now = self.manifest()
        if self._seen(now, writer, batch):
            return now
        rows = keep_last(df, self.keys, self.order) if self.order else df.dropDuplicates(list(self.keys))
        known = T.StructType.fromJson(json.loads(now.schema)) if now.schema else T.StructType()
        schema = T.StructType([*known.fields, *(f for f in df.schema.fields if f.name not in known.names)])
        new = self._commit(self._next(now, writer, batch, schema=schema.json(), keys=self.keys, deltas=(*now.deltas, self._put(rows))))
        return self.compact() if len(new.deltas) > self.most_deltas else new

    def replace_where(self, df: DataFrame, columns: Sequence[str], writer: str | None = None, batch: int | None = None) -> Manifest:
        """Rows of ``df`` take the place of all rows that agree with one of them in ``columns``, as when a range of days or a
        market is delivered again."""
        now = self.manifest()
        if self._seen(now, writer, batch):
            return now
        if not now.folders():
            return self.replace(df, writer, batch)
        touched = df.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
        kept = self.read(now.version).join(touched, same, "left_anti")
        whole = kept.unionByName(df, allowMissingColumns=True)
        return self._commit(self._next(now, writer, batch, schema=whole.schema.json(), base=(self._put(whole),), deltas=()))

    def compact(self) -> Manifest:
        """One base folder in place of base and deltas; older versions keep theirs."""
        now = self.manifest()
        if not now.deltas and len(now.base) < 2:
            return now
        return self._commit(self._next(now, None, None, base=(self._put(self.read(now.version)),), deltas=()))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. The frame names that version's folders, so later commits do not change it."""
        at = self.manifest(version)
        if not at.schema:
            raise FileNotFoundError(f"{self.path} has no version")
        schema = T.StructType.fromJson(json.loads(at.schema))
        load = lambda names: self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])
        if not at.deltas:
            return load(at.base)
        layers = [load(at.base).withColumn("_layer", F.lit(0))] if at.base else []
        layers += [load([name]).withColumn("_layer", F.lit(n)) for n, name in enumerate(at.deltas, 1)]
        whole = reduce(DataFrame.unionByName, layers)
        return keep_last(whole, list(at.keys), "_layer").select(*schema.names)

    def expire(self, keep: int = 1) -> list[str]:
        """Drops all but the newest ``keep`` manifests and the folders that only those named. Folders of a write that failed,
        or is under way, are in no manifest and stay."""
        known = self.versions()
        old, live = known[:-keep], {name for v in known[-keep:] for name in self.manifest(v).folders()}
        gone = sorted({name for v in old for name in self.manifest(v).folders()} - live)
        for v in old:
            drop_path(self.spark, self._manifest_path(v))
        for name in gone:
            drop_path(self.spark, f"{self.path}/{name}")
        return gone
