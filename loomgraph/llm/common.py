"""What the operators share: the folder that all executors see, tables that cut lineage, word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this subpackage.
SPACES = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where that is unset and Spark is local, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table has."""
    return f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"


class Stored:
    """Tables written to the shared folder: each cuts lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            for path in self.paths.pop(name, []):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_parts(rows: int, per_part: int, most: int = 20000) -> int:
    """Partitions for so many rows; row counts come from Parquet footers."""
    return max(1, min(most, -(-rows // per_part)))


def text_or_empty(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (whatever other columns are called), a null text as an empty one."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
