"""A versioned store of tables in a shared folder: Parquet files that numbered manifests name.

A batch is written beside what is there and becomes visible when its manifest
is renamed into place, so readers see all of a batch or nothing. A manifest of
one number can be made once; a writer that comes second tries again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# The version of the schema.
MAJOR, MINOR = 1, 1


class StoreError(Exception):
    """A store that is not there, of another version, or written by another at the same time."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


@dataclass
class Manifest:
    number: int = 0
    major: int = MAJOR
    minor: int = MINOR
    schemas: dict[str, str] = field(default_factory=dict)
    files: dict[str, list[str]] = field(default_factory=dict)


class Store:
    """A store's state as of one manifest; ``publish`` returns the next."""

    def __init__(self, spark: SparkSession, folder: str, manifest: Manifest) -> None:
        self.spark, self.folder, self.manifest = spark, folder, manifest

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schemas: dict[str, str]) -> Store:
        """A new store with empty tables, or the one that is there with tables and columns added; older minor versions are brought up to date."""
        try:
            store = cls.open(spark, folder)
        except StoreError:
            if exists(spark, folder) and cls._last(spark, folder) is not None:
                raise
            store = cls(spark, folder, Manifest())
        told = {n: StructType.fromDDL(s) for n, s in schemas.items()}
        known = {n: StructType.fromDDL(s) for n, s in store.manifest.schemas.items()}
        merged = dict(known)
        for name, schema in told.items():
            old = known.get(name, StructType())
            merged[name] = StructType([*old.fields, *(f for f in schema.fields if f.name not in old.names)])
        written = {n: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.fields) for n, s in merged.items()}
        if written == store.manifest.schemas and store.manifest.minor >= MINOR:
            return store
        return store._commit(Manifest(store.manifest.number + 1, MAJOR, max(MINOR, store.manifest.minor), written, store.manifest.files))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Store:
        """The store for reading; one that is not stamped or of another major version is refused, a newer minor one is not."""
        number = cls._last(spark, folder)
        if number is None:
            raise StoreError(f"no store in {folder}")
        text = "\n".join(r.value for r in spark.read.text(f"{folder}/manifest/{number:012d}.json").collect())
        manifest = Manifest(**json.loads(text))
        if manifest.major != MAJOR:
            raise StoreError(f"store of version {manifest.major}.{manifest.minor}, not {MAJOR}")
        return cls(spark, folder, manifest)

    @staticmethod
    def _last(spark: SparkSession, folder: str) -> int | None:
        fs, p = _path(spark, f"{folder}/manifest")
        if not fs.exists(p):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=None)

    def _commit(self, manifest: Manifest) -> Store:
        fs, temporary = _path(self.spark, f"{self.folder}/manifest/.{uuid4().hex}")
        _, final = _path(self.spark, f"{self.folder}/manifest/{manifest.number:012d}.json")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise StoreError(f"manifest {manifest.number} was written by another")
        return Store(self.spark, self.folder, manifest)

    def table(self, name: str) -> DataFrame:
        """A table's rows; empty if nothing was written yet, columns added later are null in older files."""
        schema = self.manifest.schemas.get(name)
        if schema is None:
            raise StoreError(f"no table {name}")
        files = self.manifest.files.get(name, [])
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.folder}/{f}" for f in files]) if files else self.spark.createDataFrame([], schema)

    def optional(self, name: str, schema: str) -> DataFrame:
        """A table that another program may own: empty where it is not there."""
        return self.table(name) if name in self.manifest.schemas else self.spark.createDataFrame([], schema)

    def publish(self, batch: dict[str, DataFrame], replace: tuple[str, ...] = ()) -> Store:
        """The store with the batch's rows added to its tables, all at once; tables in ``replace`` hold them alone.

        Columns must be those of the table; missing ones are null.
        """
        files = {n: list(f) for n, f in self.manifest.files.items()}
        number = self.manifest.number + 1
        for name, rows in batch.items():
            schema = StructType.fromDDL(self.manifest.schemas[name])
            strange = [c for c in rows.columns if c not in schema.names]
            if strange:
                raise StoreError(f"table {name} has no columns {strange}")
            at = f"{name}/{number:012d}-{uuid4().hex[:8]}"
            whole = rows.selectExpr(*[f"cast({f.name if f.name in rows.columns else 'null'} as {f.dataType.simpleString()}) as {f.name}" for f in schema.fields])
            whole.write.parquet(f"{self.folder}/{at}")
            files[name] = [at] if name in replace else [*files.get(name, []), at]
        return self._commit(Manifest(number, self.manifest.major, self.manifest.minor, self.manifest.schemas, files))
