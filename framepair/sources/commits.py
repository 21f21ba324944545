"""Resumable appends by a numbered commit list next to the data.

A run writes its rows to a folder of its own and then takes the next number of the list: a small file
that is renamed to ``_commits/<number>`` only if no other run has taken it. Readers see the
folders on the list and nothing else, so a run that is lost before its commit leaves no rows, and of
two runs side by side the later one drops the keys that the earlier one has committed before it tries
again. On file systems whose rename is not atomic (object stores) let one run write at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from framepair.operators import pairing

LIST, DATA = "_commits", "_batches"


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's path class, its file system and its context for ``path``."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    at = fs.Path(path)
    return fs.Path, at.getFileSystem(conf), fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf)


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed folders, in the order of their commits."""
    to_path, system, _ = _hadoop(spark, path)
    if not system.exists(to_path(f"{path}/{LIST}")):
        return []
    # A commit is one short line.
    found = spark.read.schema("n long, batch string").json(f"{path}/{LIST}").orderBy("n").collect()
    return [r["batch"] for r in found]


def read_committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """All committed rows of ``path``."""
    return _read(spark, path, committed(spark, path), schema)


def _read(spark: SparkSession, path: str, batches: Sequence[str], schema) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{DATA}/{b}" for b in batches])


def _take(spark: SparkSession, path: str, number: int, batch: str) -> bool:
    """Commits ``batch`` as ``number``; False if another run has that number."""
    to_path, system, context = _hadoop(spark, path)
    hidden = to_path(f"{path}/{LIST}/.{uuid.uuid4().hex}")
    out = system.create(hidden, True)
    out.write(bytearray(json.dumps({"n": number, "batch": batch}).encode()))
    out.close()
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        context.rename(hidden, to_path(f"{path}/{LIST}/{number:012d}"), spark.sparkContext._gateway.new_array(kind, 0))
    except Py4JJavaError as e:
        system.delete(hidden, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


class Append:
    """One run's rows, written but not committed."""

    def __init__(self, frames: DataFrame, path: str, keys: Sequence[str]) -> None:
        self.spark, self.path, self.keys, self.schema = frames.sparkSession, path, list(keys), frames.schema
        self.seen = committed(self.spark, path)
        done = _read(self.spark, path, self.seen, self.schema)
        self.batch = self._write(pairing.not_yet_written(frames, done, self.keys))

    def _write(self, rows: DataFrame) -> str:
        batch = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{DATA}/{batch}")
        return batch

    def commit(self) -> int:
        """Takes the next number, dropping keys that other runs have committed meanwhile; the number taken."""
        while not _take(self.spark, self.path, len(self.seen), self.batch):
            now = committed(self.spark, self.path)
            other = _read(self.spark, self.path, now[len(self.seen) :], self.schema)
            mine, self.seen = self.batch, now
            self.batch = self._write(pairing.not_yet_written(_read(self.spark, self.path, [mine], self.schema), other, self.keys))
            to_path, system, _ = _hadoop(self.spark, self.path)
            system.delete(to_path(f"{self.path}/{DATA}/{mine}"), True)
        return len(self.seen)


def append_missing(frames: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the rows whose keys are not committed yet; the commit's number. A NULL key equals no other."""
    return Append(frames, path, keys).commit()
