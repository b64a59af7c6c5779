"""Result writers and the folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Takes a table that is used several times and its name; may write it and return the stored copy.
Store = Callable[[DataFrame, str], DataFrame]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Store nothing: every use computes the table again."""
    return df


def write_and_reuse(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and go on from the stored copy."""
    return write_table(df, scratch_folder(df.sparkSession, name))


def write_result(df: DataFrame, path: str) -> None:
    """Qualifying areas as Parquet, one directory per rule."""
    df.write.mode("overwrite").partitionBy("qualifying_criteria").parquet(path)


def write_csv_gz(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, compression="gzip", escape='"').csv(path)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Store a table and continue from the stored copy, which cuts the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class RunStore:
    """A folder for the intermediate tables of one run; leaving it removes them, also after an error.

    Used as ``with RunStore(spark) as store``; ``store(df, name)`` writes a table and goes on from the copy.
    """

    def __init__(self, spark: SparkSession, name: str = "run") -> None:
        self.spark, self.folder = spark, scratch_folder(spark, name)
        self.tables: list[str] = []

    def __enter__(self) -> RunStore:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(name)
        return write_table(df, f"{self.folder}/{len(self.tables):03d}-{name}")

    def __exit__(self, *error: object) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared directory the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="areaqual-")
    return f"{shared.rstrip('/')}/areaqual-{name}-{uuid.uuid4().hex}"
