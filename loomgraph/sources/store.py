"""A store of processed files: Parquet in versions, the newest of which counts. Keys are SHA-256 of the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import path_key
from ..operators import nested
from ..schemas import FILE_ENTRIES


def latest(entries: DataFrame, key: str = "path_key", time: str = "processed_at", *ties: str) -> DataFrame:
    """The newest entry of each key; of equally new ones that with the largest of further columns."""
    w = Window.partitionBy(key).orderBy(F.desc(time), *map(F.desc, ties))
    return entries.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def evicted(entries: DataFrame, most: int, time: str) -> DataFrame:
    """What remains of entries if the oldest beyond so many go."""
    return entries.orderBy(F.desc(time)).limit(most)


def up_to_date(found: DataFrame, entries: DataFrame) -> DataFrame:
    """The found files (file_path, file_hash) with a completed entry of the same hash."""
    done = entries.filter("status = 'Completed'").select("file_path", "file_hash")
    return found.join(done, ["file_path", "file_hash"], "left_semi")


def statistics(entries: DataFrame, levels: list[str]) -> DataFrame:
    """Exact counts, size and ages in one row, and for each level how many entries have it."""
    return entries.agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("status") == "Completed").alias("completed"),
        F.count_if(F.col("status") == "Failed").alias("failed"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"),
        F.min("processed_at").alias("oldest"),
        F.max("processed_at").alias("newest"),
        *[F.count_if(F.map_contains_key("level_data", level)).alias(f"n_{level}") for level in levels],
    )


class FileStore:
    """open, upsert, get, invalidate, expire, evict. Each change writes a new version beside the old one, then drops that."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Versions that were written to their end."""
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], FILE_ENTRIES)
        return self.spark.read.schema(FILE_ENTRIES).parquet(f"{self.path}/v{versions[-1]}")

    def _write(self, entries: DataFrame) -> None:
        jvm, _, fs = self._fs()
        versions = self._versions()
        entries.write.mode("overwrite").parquet(f"{self.path}/v{versions[-1] + 1 if versions else 0}")
        for v in versions:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)

    def upsert(self, entries: DataFrame) -> None:
        """Adds entries; of entries of one path the newest stays."""
        keyed = entries.withColumn("path_key", path_key(F.col("file_path")))
        self._write(latest(self.read().unionByName(keyed.select(*self.read().columns)), "path_key", "processed_at", "file_hash", "status"))

    def get(self, file_path: str) -> DataFrame:
        return self.read().filter(F.col("path_key") == F.sha2(F.lit(file_path), 256))

    def invalidate(self, paths: list[str]) -> None:
        gone = self.spark.createDataFrame([(p,) for p in paths], "file_path string").select(path_key(F.col("file_path")).alias("path_key"))
        self._write(self.read().join(gone, "path_key", "left_anti"))

    def expire(self, before) -> None:
        """Drops entries processed before a time."""
        self._write(self.read().filter(F.col("processed_at") >= F.lit(before)))

    def evict(self, most_entries: int, most_bytes: int | None = None) -> None:
        """Drops the oldest entries until no more than so many, of so many bytes, remain."""
        kept = evicted(self.read(), most_entries, "processed_at")
        if most_bytes is not None:
            running = F.sum("file_size").over(Window.orderBy(F.desc("processed_at"), "path_key"))
            kept = kept.withColumn("_b", running).filter(F.col("_b") <= most_bytes).drop("_b")
        self._write(kept)

    def clear(self) -> None:
        _, root, fs = self._fs()
        fs.delete(root, True)

    def statistics(self, levels: list[str]) -> DataFrame:
        return statistics(self.read(), levels)

    def files(self, **predicates) -> DataFrame:
        """Entries that meet the predicates of query_files(); all without any."""
        return nested.query_files(self.read(), **predicates)

    def ast(self, **predicates) -> DataFrame:
        """Elements of the stored ASTs that meet the predicates of query_ast()."""
        return nested.query_ast(nested.ast_rows(nested.readable(self.read(), "Ast")), **predicates)

    def domains(self, **predicates) -> DataFrame:
        """Stored domains that meet the predicates of query_domains()."""
        return nested.query_domains(nested.domain_rows(nested.readable(self.read(), "DomainKeywords")), **predicates)


class ResponseCache:
    """Responses by request key, with a time to live."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, now) -> DataFrame:
        _, root, fs = self._fs()
        if not fs.exists(root):
            return self.spark.createDataFrame([], "request_key string, response string, created_at timestamp, expires_at timestamp")
        return self.spark.read.parquet(self.path).filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now)))

    def append(self, responses: DataFrame, ttl_days: int = 7) -> None:
        """responses: request_key, response, created_at."""
        responses.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(F.lit(ttl_days))).write.mode("append").parquet(self.path)

    def lookup(self, requests: DataFrame, now) -> DataFrame:
        """The requests with the newest response that is still valid, null where there is none."""
        fresh = latest(self.read(now), "request_key", "created_at", "response").select("request_key", "response")
        return requests.join(fresh, "request_key", "left")

    def statistics(self, now) -> DataFrame:
        size = F.coalesce(F.sum(F.length("response")), F.lit(0))
        return self.read(now).agg(F.count("*").alias("file_count"), size.alias("total_size_bytes"), F.round(size / 1048576.0, 2).alias("total_size_mb"), F.lit(self.path).alias("cache_directory"))

    def clear(self) -> None:
        _, root, fs = self._fs()
        fs.delete(root, True)

    def expire(self, now) -> None:
        """Drops responses that are no longer valid, by a table that takes the place of the old one."""
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return
        rest = jvm.org.apache.hadoop.fs.Path(f"{self.path}.rest")
        self.read(now).write.mode("overwrite").parquet(f"{self.path}.rest")
        fs.delete(root, True)
        if not fs.rename(rest, root):
            raise OSError(f"{self.path}.rest holds the valid responses, but could not take the place of {self.path}")
