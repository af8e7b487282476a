"""Versioned generations: immutable Parquet folders and a pointer that moves by compare-and-swap, in any file system that Spark reads."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class StalePointer(RuntimeError):
    pass


class Generations:
    """A dataset's generations under a folder (a URI of Hadoop's). Only the pointer, a few bytes, is driver work.

    The next pointer is written aside and renamed to a name with its number. Renaming never overwrites, so one caller can.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self._path("").getFileSystem(self.conf)
        self.files.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def load(self, name: str, dataset: DataFrame) -> None:
        dataset.write.partitionBy("partition_kind").parquet(f"{self.root}/{name}")

    def pointer(self) -> dict:
        names = [s.getPath().getName() for s in self.files.listStatus(self._path(""))]
        versions = [int(m[1]) for m in map(re.compile(r"pointer-(\d+)\.json").fullmatch, names) if m]
        if not versions:
            return {"version": 0, "generation": None, "previous": None}
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.root}/pointer-{max(versions)}.json").collect()))  # one line

    def promote(self, name: str, expected_version: int) -> dict:
        """Serve a loaded generation if the pointer is still at the expected version."""
        now = self.pointer()
        if now["version"] != expected_version:
            raise StalePointer(f"pointer is at {now['version']}, not {expected_version}")
        if not self.files.exists(self._path(f"{name}/_SUCCESS")):
            raise ValueError(f"generation {name} isn't loaded")
        new = {"version": expected_version + 1, "generation": name, "previous": now["generation"]}
        pending = self._path(f"_{uuid.uuid4().hex}")
        out = self.files.create(pending)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        context = self.hadoop.FileContext.getFileContext(self._path("").toUri(), self.conf)
        try:
            context.rename(pending, self._path(f"pointer-{new['version']}.json"), options)
        except Py4JJavaError as error:
            self.files.delete(pending, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise StalePointer("another promotion was first") from None
            raise
        return new

    def rollback(self, expected_version: int) -> dict:
        previous = self.pointer()["previous"]
        if previous is None:
            raise ValueError("there is no previous generation")
        return self.promote(previous, expected_version)

    def read(self) -> DataFrame:
        """The served generation, fixed when the query begins."""
        return self.spark.read.parquet(f"{self.root}/{self.pointer()['generation']}")
