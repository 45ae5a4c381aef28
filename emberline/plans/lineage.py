"""Cuts long lineages, so that iterative operators keep small plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends, and not when the driver's heap happens to be cleaned.
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run within leave no shuffle files: what they made is written by then."""
    before = spark.conf.get(CLEANS, None)
    spark.conf.set(CLEANS, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANS)
        else:
            spark.conf.set(CLEANS, before)


def _folder(df: DataFrame) -> str:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="emberline-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder that spark.checkpoint.dir names; a folder of its own only where all runs on one machine."""
    _folder(df)
    with cleaning(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own, which is made here


#: Folders that go when the innermost passing() ends.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is held() within goes at the end of it: a result that rests on it has to be written by then."""
    _passing.append([])
    try:
        yield
    finally:
        for folder in _passing.pop():
            _gone(spark, folder)


def _gone(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """As cut, in compressed columns: for what is large, is read in parts, and stays."""
    path = f"{_folder(df).rstrip('/')}/stored-{uuid.uuid4().hex}"
    with cleaning(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """A step on the way: stored as long as passing() lasts, else cut."""
    if not _passing:
        return cut(df)
    out = stored(df)
    _passing[-1] += _folders(out)
    return out


def _folders(df: DataFrame) -> list[str]:
    return [f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]]


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """held() of what make() gives within passing(); its own steps go at once."""
    with passing(spark):
        out = stored(make())
    _passing[-1] += _folders(out)
    return out


def replaced(*frames: DataFrame) -> None:
    """Frames of held() on which nothing rests any more, as others have been written from them, go before passing() ends."""
    for folder in {f for df in frames if _passing for f in _folders(df)} & {*(_passing[-1] if _passing else ())}:
        _passing[-1].remove(folder)
        _gone(frames[0].sparkSession, folder)
