"""Tables in a folder with versions: every change writes new files and then one small version file, whose name is the pointer.

A version file is created whole and never replaced: of two writers that start from one version, the second fails and may try again. Readers hold the version that
they began with. A change may carry a name; a change of a name that is already in the history is not done again, so a job that is rerun after a lost driver changes nothing twice.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one that the cluster names in spark.checkpoint.dir; a session on one machine that names none gets a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Conflict(Exception):
    """Another writer made the version that this one was about to make."""


class Versions:
    """The versions of a folder: dicts of what belongs to each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{self.path}/{name}")
        self.files = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder = self._at("versions")
        found = self.files.listStatus(folder) if self.files.exists(folder) else []
        return sorted(int(n[:-5]) for f in found if (n := f.getPath().getName()).endswith(".json"))

    def current(self) -> tuple[int, dict]:
        """Number and content of the last version; (0, {}) before the first."""
        known = self.numbers()
        return (known[-1], self.read(known[-1])) if known else (0, {})

    def read(self, number: int) -> dict:
        stream = self.files.open(self._at(f"versions/{number:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, content: dict, name: str | None = None) -> int:
        """Makes version `after` + 1. The file is written under another name and then renamed, which fails if the version exists."""
        done = dict(content, done=[*content.get("done", []), name] if name else content.get("done", []))
        self.files.mkdirs(self._at("versions"))
        draft, final = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{after + 1:010d}.json")
        out = self.files.create(draft, True)
        out.write(bytearray(json.dumps(done).encode()))
        out.close()
        if self.files.exists(final) or not self.files.rename(draft, final):
            self.files.delete(draft, False)
            raise Conflict(f"version {after + 1} of {self.path}")
        return after + 1

    def folder(self, kind: str) -> str:
        """A name for new files."""
        return f"{self.path}/{kind}-{uuid.uuid4().hex}"

    def load(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(folder)

    def clean(self, keep: int = 1) -> None:
        """Deletes all but the last `keep` versions and the folders that only they name."""
        numbers = self.numbers()
        kept = {f for n in numbers[-keep:] for f in _folders(self.read(n))}
        for n in numbers[:-keep]:
            for f in set(_folders(self.read(n))) - kept:
                self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f), True)
            self.files.delete(self._at(f"versions/{n:010d}.json"), False)


def _folders(content: object) -> list[str]:
    """Every string under a key `folder`."""
    if isinstance(content, dict):
        return [v for k, v in content.items() if k == "folder" and v] + [f for v in content.values() for f in _folders(v)]
    return [f for v in content for f in _folders(v)] if isinstance(content, list) else []
