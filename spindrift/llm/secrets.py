"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Base spans come from three patterns. Besides, every base value and every long mixed token is a candidate: its hash is counted
over the whole corpus by distinct owners and repositories. A candidate of few owners that looks random is owner-specific and
gets a span of kind `live`; one that many owners hold is a widely copied example and gets none. Base spans stay in any case.
A value that occurs twice at one place (as base value and as token) is one candidate; spans that start together are in order of kind.
No pattern looks ahead or back, so texts of any length take linear time, runs without a break too.

Positions are code points, end exclusive. A null text is empty: no span. Rows are kept as they are, repeated ones too; a null owner
is an owner of its own. Texts are read once; only hashes and positions are shuffled, pre-aggregated by owner. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.scratch import Scratch

#: Kinds in order, their patterns, the least length and the group that holds the value.
_ANY = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = "(" + "|".join(map(_ANY, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 8, 2), ("access", "AKIA[A-Z0-9]{12,}", 16, 0), ("hex", "[0-9a-f]{32,}", 32, 0))
#: Long tokens that are candidates without a keyword, if they look random; the least number of different characters of a value that does.
TOKEN, DIFFERENT = "[A-Za-z0-9+/_-]{20,}", 8
OWNERS, REPOSITORIES = 1, 3
_CHUNK = 256


def _starts(lengths: Column) -> Column:
    """Running sums before each element, in two levels so that long arrays are not copied for each of their elements."""
    empty = F.array().cast("array<bigint>")
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")), lambda i: F.slice(lengths, i * _CHUNK + 1, F.lit(_CHUNK)))
    run = lambda a: F.aggregate(a, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step)
    each = F.transform(parts, run)
    before = run(F.transform(each, lambda p: p["at"]))["out"]
    return F.flatten(F.zip_with(each, before, lambda p, b: F.transform(p["out"], lambda x: x + b)))


def found(text: Column, pattern: str) -> Column:
    """struct<hit, gaps, lengths>: the leftmost non-overlapping matches, the lengths of what lies before each, and those of both."""
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(hit), F.lit(1))), lambda g: F.length(g).cast("bigint"))
    lengths = F.zip_with(gaps, hit, lambda g, m: g + F.length(m))
    return F.when(F.rlike(text, F.lit(pattern)), F.struct(hit.alias("hit"), gaps.alias("gaps"), lengths.alias("lengths")))


def matches(hit: Column, gaps: Column, lengths: Column) -> Column:
    """array<struct<start, text>> of what was found. Takes columns, as lambdas would compute anything else for each element anew."""
    placed = F.zip_with(F.zip_with(_starts(lengths), gaps, lambda s, g: s + g), hit, lambda s, m: F.struct(s.alias("start"), m.alias("text")))
    return F.coalesce(placed, F.array().cast("array<struct<start:bigint,text:string>>"))


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


def _value(m: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(m["text"], pattern, group) if group else m["text"]


def _kept(column: str, pattern: str, least: int, group: int) -> Column:
    return F.filter(column, lambda m: F.length(_value(m, pattern, group)) >= least)


def _spans(kept: Column, kind: int) -> Column:
    return F.transform(kept, lambda m: _span(kind, m["start"], m["start"] + F.length(m["text"])))


def _values(kept: Column, pattern: str, group: int) -> Column:
    """Values with their places; a value is the end of its match."""
    end = lambda m: m["start"] + F.length(m["text"])
    return F.transform(kept, lambda m: F.struct(_value(m, pattern, group).alias("v"), (end(m) - F.length(_value(m, pattern, group))).alias("start"), end(m).alias("end")))


def looks_random(v: Column) -> Column:
    """Letters and digits both, and many different characters."""
    return F.rlike(v, F.lit("[0-9]")) & F.rlike(v, F.lit("[A-Za-z]")) & (F.size(F.array_distinct(F.split(v, ""))) >= DIFFERENT)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, owner, base spans (start, kind, end) and candidates (hash, start, end) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    columns = {c.lower() for c in docs.columns}
    owner = F.col("source").cast("string") if "source" in columns else F.lit(None).cast("string")
    patterns = {name: pattern for name, pattern, _, _ in KINDS} | {"bare": TOKEN}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), text.alias("t"))
    # exploded, so that what was found is a column and not an expression to be repeated
    rows = rows.select("doc_id", "owner", F.explode(F.array(F.struct(*(found(F.col("t"), p).alias(n) for n, p in patterns.items())))).alias("x"))
    rows = rows.select("doc_id", "owner", *(matches(F.col(f"x.{n}.hit"), F.col(f"x.{n}.gaps"), F.col(f"x.{n}.lengths")).alias(n) for n in patterns))
    kept = [_kept(name, pattern, least, group) for name, pattern, least, group in KINDS]
    base = [_spans(k, i) for i, k in enumerate(kept)]
    values = [_values(k, pattern, group) for k, (_, pattern, _, group) in zip(kept, KINDS, strict=True)] + [_values(F.col("bare"), TOKEN, 0)]
    looked = F.transform(F.filter(F.concat(*values), lambda c: looks_random(c["v"])), lambda c: F.struct(F.xxhash64(c["v"]).alias("hash"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.select("doc_id", "owner", F.sort_array(F.concat(*base)).alias("base"), F.array_distinct(looked).alias("candidates"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate, a repository being a document of an owner. Pre-aggregated by owner, so a hot hash meets few rows."""
    each = found.select(F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("owner"), "doc_id", F.explode("candidates.hash").alias("hash"))
    per = each.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.sum("one").alias("documents"))
    return per.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("documents").alias("repositories"))


def secrets(docs: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """doc_id, owner, base and live spans (start, kind, end) of each row."""
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.save(scan(docs).withColumn("row", F.monotonically_increasing_id()))
    few = ownership(found).where((F.col("owners") <= owners) & (F.col("repositories") <= repositories)).select("hash")
    each = found.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    live = each.join(few, "hash").groupBy("row").agg(F.collect_set(_span(len(KINDS), F.col("start"), F.col("end"))).alias("live"))  # of one document
    return found.join(live, "row", "left").select("doc_id", "owner", "base", F.coalesce("live", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("live"))


def spell(spans: Column) -> Column:
    """Spans as kind:start:end by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit("live"))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
