"""BM25 over postings: made for one call, or kept in a folder and added to.

A kept index is a list of segments. Each has postings (term, id, tf, dl) in folders by a hash of the term, sorted by term and id, so a search reads the folders of its own terms and of
those only the row groups that hold them; a term of very many documents fills several files. Beside them are the documents' lengths and the terms' document counts. The version file holds what scores need of
the whole: documents, their mean length and the least weight of a term. Adding a segment writes its files and sums up the counts of terms; earlier postings stay as they are.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import blocks, graph
from spindrift.sources.versions import Versions

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Folders of postings; terms of a query set that are listed in the scan's filter or broadcast (more are joined by a shuffle); queries that are scored row by row in the JVM (more are scored in blocks).
BUCKETS, LISTED, BROADCAST_TERMS, FEW = 64, 2_000, 200_000, 16
#: Tokens of a segment that one task counts, sorts and writes, about: its memory does not grow with the segment.
TOGETHER = 2_000_000
#: Smallest ids that a segment's entry lists, for queries with fewer hits than wanted.
FIRST = 100
#: Postings and documents, and terms and queries, in a block.
POSTINGS, DOCUMENTS, TERMS, QUERIES = 1 << 15, 1 << 13, 1 << 14, 256


def bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def _buckets(terms: list[str]) -> list[int]:
    return sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})


@dataclass(frozen=True)
class Index:
    """Postings (term, id, tf, dl) and (term, df) with at most one row for each term and segment, ids of all chunks, and the whole in numbers."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    n: int
    mean: float
    floor: float
    by_bucket: bool = False
    first: tuple[int, ...] = ()  #: the smallest ids, if they are known


def _raw_idf(n: int) -> Column:
    return F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _floor(terms: DataFrame, n: int) -> float:
    """A quarter of the mean weight of all terms."""
    return FLOOR * (terms.groupBy("term").agg(F.sum("df").alias("df")).agg(F.avg(_raw_idf(n))).first()[0] or 0.0)


def tokenised(chunks: DataFrame) -> DataFrame:
    """(id, dl, toks) of chunks (id, text); a null text has none."""
    toks = F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>"))
    return chunks.select(F.col("id").cast("long").alias("id"), toks.alias("toks")).withColumn("dl", F.size("toks"))


def over(chunks: DataFrame) -> Index:
    """The index of chunks (id, text) for one call: terms are counted once and checkpointed, as the weights of queries are read more than once; postings are made when they are asked for.

    explode_outer() stands for explode(), which would cut the texts twice, first for a filter on the number of their tokens.
    """
    graph.checkpoint_folder(chunks.sparkSession)
    toks, n = tokenised(chunks), chunks.count()
    each = toks.select("dl", F.posexplode_outer(F.array_distinct("toks")).alias("at", "term")).where("term is not null")
    terms = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("at") == 0, F.col("dl").cast("long"))).alias("tokens")).checkpoint()
    whole = terms.agg(F.avg(_raw_idf(n)), F.sum("tokens")).first()  # one pass over the texts for the counts, the floor and the mean length
    postings = toks.select("id", "dl", F.explode_outer("toks").alias("term")).where("term is not null")
    return Index(postings, terms.select("term", "df"), chunks.select(F.col("id").cast("long").alias("id")), n, (whole[1] or 0) / max(n, 1), FLOOR * (whole[0] or 0.0))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, times) of queries (qid, text)."""
    return queries.select(F.col("qid").cast("long").alias("qid"), F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def _valued(index: Index, postings: DataFrame) -> DataFrame:
    """(term, id, value): what a term of weight 1 adds to a chunk's score."""
    if "tf" not in postings.columns:
        postings = postings.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    value = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(max(index.mean, 1e-9))))
    return postings.select("term", "id", value.alias("value"))


def _of(index: Index, df: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of listed terms; the lists reach the scan."""
    kept = df.where(F.col("term").isin(terms) if terms else F.lit(False))
    return kept.where(F.col("bucket").isin(_buckets(terms))) if index.by_bucket and terms else kept


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k best chunks of each query (qid, text), chunks of score 0 by id where hits are fewer, and negative scores after them.

    A negative weight becomes the floor; a term that a query repeats counts as often. Queries are counted: a few are looked up term by term, more are scored in blocks.
    """
    some = queries.select(F.col("qid").cast("long").alias("qid"), T.tokens(F.col("text")).alias("toks")).limit(FEW + 1).collect()
    terms = sorted({t for r in some for t in r.toks or ()})
    return _few(index, some, terms, k) if len(some) <= FEW and len(terms) <= LISTED else _many(index, queries, k)


def _few(index: Index, queries: list, terms: list[str], k: int) -> DataFrame:
    """Weights of the terms come first, as they are few; then one scan of their postings is added up by query and chunk, together with zeros for the first chunks."""
    df: Counter = Counter()
    for r in _of(index, index.terms, terms).select("term", "df").collect() if terms else ():  # a row for each term and segment
        df[r.term] += r.df
    raw = {t: math.log(index.n - n + 0.5) - math.log(n + 0.5) for t, n in sorted(df.items())}
    weights = {t: index.floor if w < 0 else w for t, w in raw.items()}
    asked = {t: [] for t in weights}
    for r in queries:
        for t, times in sorted(Counter(r.toks or ()).items()):
            if t in weights:
                asked[t].append((r.qid, weights[t] * times))
    spark = index.lengths.sparkSession
    scored = _valued(index, _of(index, index.postings, list(asked)))
    of_term = F.create_map(*(x for t, v in asked.items() for x in (F.lit(t), F.array(*(F.struct(F.lit(q).cast("long").alias("qid"), F.lit(float(w)).alias("w")) for q, w in v))))) if asked else F.create_map().cast("map<string,array<struct<qid:bigint,w:double>>>")
    each = scored.select("id", "value", F.explode(F.element_at(of_term, F.col("term"))).alias("q")).select(F.col("q.qid").alias("qid"), "id", (F.col("q.w") * F.col("value")).alias("score"))
    first = list(index.first[:k]) if len(index.first) >= min(k, index.n) else [r.id for r in index.lengths.select("id").orderBy("id").limit(k).collect()]
    pairs = F.arrays_zip(F.lit([r.qid for r in queries for _ in first]).cast("array<bigint>").alias("qid"), F.lit([i for _ in queries for i in first]).cast("array<bigint>").alias("id"))
    zeros = spark.range(1, numPartitions=1).select(F.explode(pairs).alias("p")).select("p.qid", "p.id", F.lit(0.0).alias("score"))
    return blocks.top(each.unionByName(zeros).groupBy("qid", "id").agg(F.sum("score").alias("score")), k)


def _many(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """Terms are counted: few are listed in the filters of the scans, more are broadcast, most joined. Postings meet the queries in blocks of whole chunks and whole queries."""
    asked = asked_terms(queries)
    terms = asked.select("term").distinct()
    listed = [r.term for r in terms.limit(LISTED + 1).collect()]
    side = F.broadcast if len(listed) <= LISTED or terms.count() <= BROADCAST_TERMS else lambda df: df

    def of_terms(df: DataFrame) -> DataFrame:
        if len(listed) <= LISTED:
            return _of(index, df, listed)
        return df.join(side(terms.withColumn("bucket", bucket(F.col("term")))), ["bucket", "term"]) if index.by_bucket else df.join(side(terms), "term")

    idf = of_terms(index.terms).groupBy("term").agg(F.sum("df").alias("df")).select("term", _raw_idf(index.n).alias("idf"))
    weights = idf.select("term", F.when(F.col("idf") < 0, F.lit(index.floor)).otherwise(F.col("idf")).alias("w"))
    postings = _valued(index, of_terms(index.postings))
    weighted = asked.join(side(weights), "term").select("qid", "term", (F.col("w") * F.col("times")).alias("value"))
    hashed = F.xxhash64("term").alias("term")
    # a term that no text has gives the first k chunks 0 for every query, so those without a hit are there to fill up
    none = F.xxhash64(F.lit("")).alias("term")
    first = index.lengths.select("id").orderBy("id").limit(k).select("id", none, F.lit(0.0).alias("value"))
    every = queries.select(F.col("qid").cast("long").alias("qid"), none, F.lit(1.0).alias("value")).distinct()
    rows = postings.select("id", hashed, "value").unionByName(first).repartition("id").sortWithinPartitions("id")
    sets = weighted.select("qid", hashed, "value").unionByName(every).repartition("qid").sortWithinPartitions("qid")
    return blocks.best(blocks.packed(rows, POSTINGS, whole="id", groups=DOCUMENTS), blocks.packed(sets, TERMS, whole="qid", groups=QUERIES), blocks.sparse(k), k)


class Stored:
    """A BM25 index in a folder."""

    POSTINGS, TERMS, LENGTHS = "term string, id long, tf int, dl int, bucket int", "term string, df long, bucket int", "id long, dl int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)
        self.held: tuple[int, Index] | None = None

    def add(self, chunks: DataFrame, name: str | None = None) -> int:
        """Adds chunks (id, text), whose ids the index has not, as a segment; returns the version. `name` makes a rerun of the same addition do nothing."""
        number, content = self.versions.current()
        if name and name in content.get("done", []):
            return number
        folder = self.versions.folder("segment")
        toks = tokenised(chunks)
        toks.select("id", "dl").write.parquet(f"{folder}/lengths")
        size = self.versions.load(f"{folder}/lengths", self.LENGTHS).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("dl").cast("long")), F.lit(0))).first()
        tasks = -(-size[1] // TOGETHER)
        # texts are dealt, so that their terms are counted where they are and no task counts more than its share
        dealt = toks.repartition(max(tasks, self.spark.sparkContext.defaultParallelism), "id")
        each = dealt.select("id", "dl", F.explode("toks").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        each = each.select("term", "id", "tf", "dl", bucket(F.col("term")).alias("bucket"))
        # by range of (bucket, term, id), so that a term of very many documents is written by several tasks; the session's number of partitions holds for small segments only
        order = ("bucket", "term", "id")
        ranged = each.repartitionByRange(tasks, *order) if tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else each.repartitionByRange(*order)
        ranged.sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{folder}/postings")
        made = self.versions.load(f"{folder}/postings", self.POSTINGS)
        made.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/terms")
        first = [r.id for r in self.versions.load(f"{folder}/lengths", self.LENGTHS).select("id").orderBy("id").limit(FIRST).collect()]
        segments = [*content.get("segments", []), {"folder": folder, "n": size[0], "tokens": size[1], "first": first}]
        n = sum(s["n"] for s in segments)
        whole = {"segments": segments, "floor": _floor(self._read(segments, "terms", self.TERMS), n), "done": content.get("done", [])}
        return self.versions.commit(number, whole, name)

    def _read(self, segments: list[dict], part: str, schema: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        each = [self.versions.load(f"{s['folder']}/{part}", schema) for s in segments]
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out

    def index(self) -> Index:
        """The index at its last version; its listing of files is kept until there is another."""
        number = max(self.versions.numbers(), default=0)
        if self.held is None or self.held[0] != number:
            segments = (content := self.versions.read(number) if number else {}).get("segments", [])
            n = sum(s["n"] for s in segments)
            # the first of all are among the first of each segment
            first = sorted(i for s in segments for i in s["first"])[: min((len(s["first"]) for s in segments if s["n"] > len(s["first"])), default=n)]
            parts = (self._read(segments, *p) for p in (("postings", self.POSTINGS), ("terms", self.TERMS), ("lengths", self.LENGTHS)))
            self.held = number, Index(*parts, n, sum(s["tokens"] for s in segments) / max(n, 1), content.get("floor", 0.0), True, tuple(first))
        return self.held[1]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search(self.index(), queries, k)
