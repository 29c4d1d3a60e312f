"""What the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.session import ensure_checkpoint_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none.

    All white space becomes blanks first, because a split at one plain character
    costs less than half of a split at a pattern.
    """
    flat = F.coalesce(text, F.lit(""))
    for white in "\t\n\v\f\r":
        flat = F.replace(flat, F.lit(white), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written to the shared folder, so that later steps do not depend on executors that may be lost.

    ``write`` under a name that was used before replaces the older table after
    the new one is complete.  ``drop`` deletes those that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, shared_folder(spark, name), {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if old := self.paths.pop(name, None):
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(old)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
