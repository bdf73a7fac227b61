"""Sources and sinks of files: binary documents, CSV and JSON sets, state and label files, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import strip
from spindrift.operators.store import latest

SUFFIXES, LARGEST = (".pdf",), 50 * 1024 * 1024


def binaries(spark: SparkSession, path: str, suffixes: tuple = SUFFIXES, largest: int = LARGEST, pattern: str = "*") -> DataFrame:
    """Files under a path with their content; other suffixes and larger files drop out before their content is read into a row that leaves the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.endswith(F.lower("path"), F.lit(s))
    return files.where(wanted & (F.col("length") <= largest))


def extract(files: DataFrame, extractors: list[Callable[[bytes], list[str]]]) -> DataFrame:
    """(path, method, pages array<struct<page, text>>, error): the first extractor that gives any text wins; failures are rows, not exceptions.

    An extractor is a function of a file's bytes that returns its pages' texts; libraries for formats are the caller's.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"], strict=True):
                method, pages, errors = None, [], []
                for e in extractors:
                    try:
                        found = [(i, (t or "").strip()) for i, t in enumerate(e(bytes(content)), 1)]
                    except Exception as x:  # noqa: BLE001  any failure of a plug-in moves on to the next one
                        errors.append(f"{getattr(e, '__name__', 'extractor')}: {x}")
                        continue
                    if any(t for _, t in found):
                        method, pages = getattr(e, "__name__", "extractor"), found
                        break
                out.append((path, method, [{"page": i, "text": t} for i, t in pages], None if method else "; ".join(errors) or "no text"))
            yield pd.DataFrame(out, columns=["path", "method", "pages", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, method string, pages array<struct<page:int,text:string>>, error string")


def plain_text(content: bytes) -> list[str]:
    """Pages of a UTF-8 text file, which form feeds part."""
    return content.decode("utf-8").split("\f")


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """Training rows of a CSV file with a header: text and label."""
    return spark.read.schema("text string, label string").option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def test_set(spark: SparkSession, path: str, labels: int, most: int | None = None) -> DataFrame:
    """Evaluation rows (text, label) of JSON or CSV: trimmed, not empty, label in range; the first `most`, if given."""
    read = spark.read.schema("text string, label int")
    rows = read.option("multiLine", "true").json(path) if path.endswith(".json") else read.option("header", "true").csv(path)
    kept = rows.withColumn("text", strip(F.col("text"))).where((F.col("text") != "") & F.col("label").between(0, labels - 1))
    return kept.limit(most) if most else kept


def resume(spark: SparkSession, path: str) -> DataFrame:
    """Last state of each file in a JSON-lines log (file, status, ts)."""
    return latest(spark.read.schema("file string, status string, ts string").json(path), ["file"], ["ts"])


def to_do(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose last state is not ok."""
    return files.join(state.where("status = 'ok'").select("file"), "file", "left_anti")


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a text file: trimmed lines that are not blank."""
    return spark.read.text(path).select(strip(F.col("value")).alias("label")).where("label <> ''")


def report(rows: DataFrame, path: str, form: str = "json") -> None:
    """Writes rows as JSON lines, CSV with a header, or Parquet."""
    writer = rows.write.mode("overwrite")
    (writer.option("header", "true") if form == "csv" else writer).format(form).save(path)


def to_vector_store(rows: DataFrame, send: Callable[[list[dict]], None], batch: int = 100) -> None:
    """Sends rows to an external vector index in batches, from the executors. `send` opens its own connection."""

    def run(part) -> None:
        held = []
        for r in part:
            held.append(r.asDict(recursive=True))
            if len(held) >= batch:
                send(held)
                held = []
        if held:
            send(held)

    rows.foreachPartition(run)
