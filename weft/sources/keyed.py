"""Keyed tables (B8, B4, A13 at size): versions in buckets, merged without moving the base.

A table is a folder of versions, each bucketed by the key into the same number of files. An upsert or
a delete writes one more version (of its own rows only; a deleted key is a row without values) and never
reads the others. Reading merges the versions key by key inside each bucket: they all lie by the key
already, so no shuffle moves them. ``compact`` writes the merged rows as one version.

Which versions count is said by the newest manifest. A version is written first and named by a manifest
after that, which appears under its final name at once: a job that dies in between leaves the table as it was,
and of two writers who read the same manifest the second fails and can try again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_GONE = "_deleted"


class Conflict(RuntimeError):
    """Another writer has published a version since this one looked."""


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    return jpath(path).getFileSystem(spark._jsc.hadoopConfiguration()), jpath


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str

    # ------------------------------------------------------------- manifests

    def _manifest(self) -> tuple[int, dict]:
        fs, jpath = _fs(self.spark, self.path)
        folder = jpath(f"{self.path}/_manifests")
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()] if fs.exists(folder) else []
        if not numbers:
            raise FileNotFoundError(f"no keyed table at {self.path}")
        stream = fs.open(jpath(f"{self.path}/_manifests/{max(numbers)}"))
        try:
            return max(numbers), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> None:
        fs, jpath = _fs(self.spark, self.path)
        target, draft = jpath(f"{self.path}/_manifests/{number}"), jpath(f"{self.path}/_manifests/.{number}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise Conflict(f"version {number} of {self.path} was published by another writer")

    # ------------------------------------------------------------- versions

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str = "doc_id", buckets: int = 32) -> KeyedTable:
        """A new table of the rows; of rows that share a key one stays (that of the largest digest)."""
        table = cls(rows.sparkSession, path.rstrip("/"))
        manifest = {"key": key, "buckets": buckets, "schema": rows.schema.json(), "versions": []}
        table._publish(0, table._with(manifest, 0, table._newest(manifest, rows.withColumn(_GONE, F.lit(False)), None)))
        return table

    def _newest(self, manifest: dict, rows: DataFrame, order: str | None) -> DataFrame:
        """One row per key, dealt to the buckets: only these rows are shuffled."""
        key, columns = manifest["key"], self._schema(manifest).names
        rank = F.struct(*([F.col(order)] if order else []), F.xxhash64(*columns))
        rows = rows.repartition(manifest["buckets"], F.col(key))
        return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key], _GONE), rank).alias("_r")).select(
            *[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in [*columns, _GONE]])

    def _with(self, manifest: dict, number: int, rows: DataFrame) -> dict:
        """Writes a version, a file per bucket, and names it in a manifest that is not published yet."""
        name = f"{number:08d}-{uuid.uuid4().hex[:8]}"
        files = f"weft_{uuid.uuid4().hex}"
        (rows.write.format("parquet").bucketBy(manifest["buckets"], manifest["key"]).sortBy(manifest["key"])
         .option("path", f"{self.path}/data/version={name}").saveAsTable(files))
        self.spark.sql(f"DROP TABLE {files}")  # the files stay, the session's name for them goes
        return manifest | {"versions": [*manifest["versions"], name]}

    def upsert(self, delta: DataFrame, order: str | None = None) -> None:
        """Rows of the delta replace those of the same key; of several the one with the largest ``order``.
        Columns that the delta lacks are null."""
        number, manifest = self._manifest()
        lacking = [f for f in self._schema(manifest).fields if f.name not in delta.columns]
        delta = delta.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking}).withColumn(_GONE, F.lit(False))
        self._publish(number + 1, self._with(manifest, number + 1, self._newest(manifest, delta, order)))

    def delete(self, keys: DataFrame) -> None:
        """Takes the rows of the given keys out; keys that the table lacks change nothing."""
        number, manifest = self._manifest()
        fields, key = self._schema(manifest).fields, manifest["key"]
        gone = keys.select(*[(F.col(key) if f.name == key else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], F.lit(True).alias(_GONE))
        self._publish(number + 1, self._with(manifest, number + 1, self._newest(manifest, gone, None)))

    def compact(self) -> None:
        """Writes the merged rows as one version, bucket by bucket, and lets go of the others."""
        number, manifest = self._manifest()
        rows = self.read().withColumn(_GONE, F.lit(False))
        self._publish(number + 1, self._with(manifest | {"versions": []}, number + 1, rows))

    # ------------------------------------------------------------- reading

    @staticmethod
    def _schema(manifest: dict) -> StructType:
        return StructType.fromJson(json.loads(manifest["schema"]))

    def read(self) -> DataFrame:
        """The table's rows now. The scan comes by bucket, so the merge needs no shuffle; nor does a join or an
        aggregate by the key that follows."""
        _, manifest = self._manifest()
        key, schema = manifest["key"], self._schema(manifest)
        view = f"weft_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(f"CREATE TABLE {view} ({columns}, `{_GONE}` boolean, version string) USING parquet PARTITIONED BY (version) "
                       f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {manifest['buckets']} BUCKETS LOCATION '{self.path}/data'")
        self.spark.catalog.recoverPartitions(view)
        rows = self.spark.table(view).where(F.col("version").isin(manifest["versions"]))
        merged = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in schema.names if c != key], _GONE), "version").alias("_r"))
        return merged.where(f"not _r.{_GONE}").select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in schema.names])
