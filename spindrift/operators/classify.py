"""Classification of texts by a plug-in, batch by batch, with a row for every text: a result or an error.

A batch that fails is halved until the failing texts are alone, so one bad text costs a few more calls and not the batch. Null and blank texts are errors without a call. What the plug-in
returns must be as long as what it was given; anything else is a failure like an exception.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that the plug-in is given at once.
BATCH = 64
Classifier = Callable[[list[str]], list[tuple[str, float]]]


def judged(texts: list[str], classifier: Classifier) -> list[tuple[str | None, float | None, str | None]]:
    """(label, confidence, error) of each text."""
    if not texts:
        return []
    try:
        found = [(str(label), float(confidence), None) for label, confidence in classifier(texts)]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return found
    except Exception as x:  # noqa: BLE001  any failure of a plug-in becomes a row
        if len(texts) == 1:
            return [(None, None, f"{type(x).__name__}: {x}")]
        half = len(texts) // 2
        return judged(texts[:half], classifier) + judged(texts[half:], classifier)


def classify(rows: DataFrame, classifier: Classifier, text: str = "text", batch: int = BATCH) -> DataFrame:
    """`rows` with result struct<label, confidence>, null where it failed, and error."""

    def run(texts: pa.Array) -> pa.Array:
        given = texts.to_pylist()
        out: list = [(None, None, "ValueError: empty text")] * len(given)
        full = [i for i, t in enumerate(given) if t is not None and t.strip()]
        for k in range(0, len(full), batch):
            part = full[k : k + batch]
            for i, r in zip(part, judged([given[i] for i in part], classifier), strict=True):
                out[i] = r
        label, confidence, error = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(label, pa.string()), pa.array(confidence, pa.float64()), pa.array(error, pa.string())], names=["label", "confidence", "error"])

    found = rows.withColumn("__found", F.arrow_udf(run, "label string, confidence double, error string")(F.col(text)))
    return found.withColumn("result", F.when(F.col("__found.error").isNull(), F.struct("__found.label", "__found.confidence"))).withColumn("error", F.col("__found.error")).drop("__found")


def summary(classified: DataFrame) -> DataFrame:
    """One row: total, successful, failed, mean confidence, and the number of texts by label."""
    per = classified.groupBy(F.col("result.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed"), F.sum("result.confidence").alias("sum"))
    labels = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n")))))  # a row for each label
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("n") - F.col("failed")), F.lit(0)).alias("successful"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), (F.sum("sum") / F.sum(F.col("n") - F.col("failed"))).alias("mean_confidence"), labels.alias("labels"))
