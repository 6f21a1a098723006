"""A store of named Parquet datasets with a manifest, staleness checks and a SQL surface.

Paths go through Hadoop's file system API, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Datasets are {root}/{name}.parquet; {root}/_manifest.json describes them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path_for(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._path(self.path_for(name))))

    def manifest(self) -> dict:
        """Empty if there is none or it isn't valid JSON."""
        where = self._path(f"{self.root}/_manifest.json")
        if not self._fs.exists(where):
            return {}
        stream = self._fs.open(where)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return {}
        finally:
            stream.close()

    def _save(self, manifest: dict) -> None:
        out = self._fs.create(self._path(f"{self.root}/_manifest.json"), True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True, indent=2).encode()))
        out.close()

    def write(self, name: str, df: DataFrame, meta: dict | None = None, partition_by: list[str] | None = None) -> str:
        """Overwrites the dataset; the manifest keeps time, rows and the first 200 columns, and meta."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path_for(name))
        entry = {"written_at": datetime.now(timezone.utc).isoformat(), "rows": self.read(name).count(), "columns": df.columns[:200], **(meta or {})}
        self._save({**self.manifest(), name: entry})
        return self.path_for(name)

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise FileNotFoundError(f"no dataset {name!r} under {self.root}; ingest it first")
        return self.spark.read.parquet(self.path_for(name))

    def load(self, *names: str) -> dict[str, DataFrame | None]:
        """Each dataset, or None where there is none."""
        return {n: self.read(n) if self.exists(n) else None for n in names}

    def age_seconds(self, name: str) -> float | None:
        entry = self.manifest().get(name)
        if not entry or "written_at" not in entry:
            return None
        return (datetime.now(timezone.utc) - datetime.fromisoformat(entry["written_at"])).total_seconds()

    def is_stale(self, name: str, max_age_hours: float) -> bool:
        age = self.age_seconds(name)
        return age is None or age > max_age_hours * 3600

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(f.removesuffix(".parquet") for f in found if f.endswith(".parquet"))

    def sql(self, query: str) -> DataFrame:
        """The query over all datasets, each a view of its name."""
        for n in self.names():
            self.read(n).createOrReplaceTempView(n)
        return self.spark.sql(query)

    def summary(self) -> DataFrame:
        rows = [(n, int(e.get("rows") or 0), round(age / 3600, 2) if (age := self.age_seconds(n)) is not None else None) for n, e in sorted(self.manifest().items())]
        return self.spark.createDataFrame(rows, "dataset string, rows long, age_hours double")

    def missing(self, names: list[str]) -> list[str]:
        """A note for each of the named datasets that there isn't."""
        return [f"{n}: missing" for n in names if not self.exists(n)]

    def export(self, to: str, names: list[str], warn_mb: float = 50, total_mb: float = 100) -> list[str]:
        """Copies the named datasets; returns warnings for large ones, a large total and missing ones."""
        notes, total = [], 0.0
        for n in names:
            if not self.exists(n):
                notes += self.missing([n])
                continue
            self.read(n).write.mode("overwrite").parquet(f"{to.rstrip('/')}/{n}.parquet")
            mb = self._fs.getContentSummary(self._path(self.path_for(n))).getLength() / 1e6
            total += mb
            if mb > warn_mb:
                notes.append(f"{n}: {mb:.0f} MB")
        if total > total_mb:
            notes.append(f"total: {total:.0f} MB")
        return notes
