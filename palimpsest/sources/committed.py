"""A fact table whose labels are written back in commits: rows in key buckets, and a manifest that names the valid version of each.

A commit rewrites only the buckets that its predictions touch, beside the old ones, and becomes valid with one renamed file.
What an interrupted commit leaves behind is named by no manifest and never read.
"""

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.domain import CHANGE_KEY
from palimpsest.sources.store import write_back

_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another commit has become valid in the meantime; the caller may try again."""


def _bucket(key, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k), F.lit("")) if k == key[-1] else F.col(k) for k in key]), F.lit(buckets)).cast("int")


class CommittedFacts:
    """Facts below ``path``; every reader sees the last commit that was finished."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, facts: DataFrame, path: str, key=CHANGE_KEY, buckets: int = 64) -> "CommittedFacts":
        """Store the facts as version 0. The last key column counts NULL as ''."""
        table, key = cls(facts.sparkSession, path), list(key)
        data = f"{table.path}/data/0-{uuid.uuid4().hex}"
        facts.withColumn(_BUCKET, _bucket(key, buckets)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(data)
        table._publish({"version": 0, "key": key, "buckets": buckets, "schema": facts.schema.json(), "batches": [],
                        "data": {str(b): data for b in table._found(data)}})
        return table

    def _found(self, data: str) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(data))]
        return [int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}=")]

    def _manifest_path(self, version: int):
        return self._at(f"{self.path}/manifests/{version:09d}.json")

    def _publish(self, manifest: dict) -> None:
        """Write the manifest under another name and rename it; a version that is there already stays."""
        target, draft = self._manifest_path(manifest["version"]), self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise Conflict(f"version {manifest['version']} exists")

    def manifest(self) -> dict:
        """The last valid one."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/manifests")) if s.getPath().getName().endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()["value"])

    def _rows(self, manifest: dict, buckets=None) -> DataFrame:
        from pyspark.sql.types import StructType
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        where = {b: d for b, d in manifest["data"].items() if buckets is None or int(b) in buckets}
        if not where:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{d}/{_BUCKET}={b}" for b, d in sorted(where.items())])

    def read(self) -> DataFrame:
        return self._rows(self.manifest())

    def commit(self, predictions: DataFrame, batch: str, label: str = "label", predicted: str = "predicted_labels",
               before_publish: Callable[[], None] | None = None) -> bool:
        """Replace labels as :func:`write_back` does; False if a batch of this name is committed already, which then changes nothing.

        Rows of untouched buckets are neither read nor written. ``before_publish`` runs between the data and the manifest.
        """
        now = self.manifest()
        if batch in now["batches"]:
            return False
        key, count = now["key"], now["buckets"]
        predictions = predictions.withColumn(_BUCKET, _bucket(key, count))
        touched = {r[0] for r in predictions.select(_BUCKET).distinct().collect()} & {int(b) for b in now["data"]}
        version, data = now["version"] + 1, f"{self.path}/data/{now['version'] + 1}-{uuid.uuid4().hex}"
        if touched:
            new = write_back(self._rows(now, touched), predictions.drop(_BUCKET), label, predicted, key)
            new.withColumn(_BUCKET, _bucket(key, count)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(data)
        if before_publish:
            before_publish()
        self._publish({**now, "version": version, "batches": [*now["batches"], batch], "data": {**now["data"], **{str(b): data for b in touched}}})
        return True
