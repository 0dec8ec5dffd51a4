"""Stored models, their registry, and a log of runs. Models are rows, kept as Parquet next to a JSON table of facts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACTS = "name string, version string, kind string, saved_at double, path string, digest long, rows long, active boolean, metadata map<string,string>"


def _digest(df: DataFrame) -> tuple[int, int]:
    """A number that any order of the same rows gives, and their count."""
    r = df.agg(F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)), F.count("*")).first()
    return int(r[0]), int(r[1])


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _facts(self) -> str:
        return f"{self.path}/facts"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def save(self, model: DataFrame, name: str, version: str, kind: str = "model", metadata: dict | None = None, active: bool = True) -> str:
        """Each version has a folder of its own; a version is saved once."""
        path = f"{self.path}/{name}/{version}"
        model.write.mode("errorifexists").parquet(path)
        digest, n = _digest(self.spark.read.parquet(path))
        row = (name, version, kind, time.time(), path, digest, n, active, {k: str(v) for k, v in (metadata or {}).items()})
        self.spark.createDataFrame([row], FACTS).write.mode("append").json(self._facts())
        return path

    def list(self, kind: str | None = None) -> DataFrame:
        """The latest facts of each version that is still there, newest first."""
        if not self.exists(self._facts()):
            return self.spark.createDataFrame([], FACTS)
        facts = self.spark.read.schema(FACTS).json(self._facts())
        w = Window.partitionBy("name", "version").orderBy(F.desc("saved_at"))
        latest = facts.withColumn("_r", F.row_number().over(w)).where("_r = 1 and path is not null").drop("_r")
        return (latest.where(F.col("kind") == kind) if kind else latest).orderBy(F.desc("saved_at"))

    def latest(self, name: str) -> str | None:
        r = self.list().where(F.col("name") == name).agg(F.max_by("version", F.struct("active", "saved_at"))).first()
        return r[0]

    def load(self, name: str, version: str | None = None, verify: bool = True) -> DataFrame:
        """ValueError if the rows aren't those that were saved, FileNotFoundError if there are none."""
        version = version or self.latest(name)
        fact = self.list().where((F.col("name") == name) & (F.col("version") == version)).first()
        if fact is None or not self.exists(fact["path"]):
            raise FileNotFoundError(f"{name} {version}")
        df = self.spark.read.parquet(fact["path"])
        if verify and _digest(df) != (fact["digest"], fact["rows"]):
            raise ValueError(f"{name} {version} has changed since it was saved")
        return df

    def activate(self, name: str, version: str) -> None:
        rows = [(r["name"], r["version"], r["kind"], time.time(), r["path"], r["digest"], r["rows"], r["version"] == version, r["metadata"]) for r in self.list().where(F.col("name") == name).collect()]
        self.spark.createDataFrame(rows, FACTS).write.mode("append").json(self._facts())

    def delete(self, name: str, version: str) -> None:
        fact = self.list().where((F.col("name") == name) & (F.col("version") == version)).first()
        if fact is not None:
            fs, p = self._fs(fact["path"])
            fs.delete(p, True)
            self.spark.createDataFrame([(name, version, fact["kind"], time.time(), None, None, None, False, {})], FACTS).write.mode("append").json(self._facts())

    def cleanup(self, name: str, keep: int = 3) -> list[str]:
        old = [r["version"] for r in self.list().where(F.col("name") == name).collect()[keep:]]
        for v in old:
            self.delete(name, v)
        return old


class Runs:
    """An append-only table of (experiment, run, key, value): parameters, metrics and tags."""

    SCHEMA = "experiment string, run string, kind string, key string, number double, text string, at double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self, experiment: str, run: str, params: dict | None = None, metrics: dict | None = None) -> None:
        now = time.time()
        rows = [(experiment, run, "param", k, None, str(v), now) for k, v in (params or {}).items()] + [(experiment, run, "metric", k, float(v), None, now) for k, v in (metrics or {}).items()]
        self.spark.createDataFrame(rows, self.SCHEMA).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def best(self, experiment: str, metric: str, ascending: bool = False) -> DataFrame:
        m = self.table().where((F.col("experiment") == experiment) & (F.col("kind") == "metric") & (F.col("key") == metric))
        return m.orderBy(F.col("number") if ascending else F.desc("number"), "run").limit(1).select("run", "number")


def flattened(results: DataFrame, key: str) -> DataFrame:
    """Numeric columns as (key, metric, value) rows."""
    from pyspark.sql.types import NumericType

    numbers = [f.name for f in results.schema.fields if isinstance(f.dataType, NumericType) and f.name != key]
    return results.select(key, *(F.col(c).cast("double").alias(c) for c in numbers)).unpivot(key, numbers, "metric", "value")
