"""From files to stamped chunks: probe, readers in turn, cleaning, checks, language and chunks, with one row for each file that fails. One scan and no shuffle.

A reader is a name and a function of a file's bytes that returns `Opened`, or raises. Readers of formats that need a library are the caller's; here are those for plain text and for HTML.
"""

from __future__ import annotations

import html.parser
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import chunking as C

#: Pages that the probe looks at for text.
PROBED = 3


class Opened(NamedTuple):
    """Texts of a file's pages; a locked file has none."""

    pages: Sequence[str]
    encrypted: bool = False


Reader = tuple[str, Callable[[bytes], Opened]]


def plain(content: bytes) -> Opened:
    """UTF-8 text, whose pages form feeds part."""
    return Opened(content.decode("utf-8").split("\f"))


class _Visible(html.parser.HTMLParser):
    """Text outside of scripts and styles; block elements part it."""

    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in ("p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def markup(content: bytes) -> Opened:
    """One page of an HTML file's visible text; what does not begin with a mark is not HTML."""
    text = content.decode("utf-8")
    if not text.lstrip().startswith("<"):
        raise ValueError("no markup")
    parser = _Visible()
    parser.feed(text)
    parser.close()
    return Opened(["".join(parser.out)])


READERS: list[Reader] = [("html", markup), ("text", plain)]


def opened(content: bytes | None, readers: list[Reader]) -> tuple:
    """(page_count, encrypted, has_text, method, pages, error): the first reader that gives any text wins. A locked file ends the search: no other reader could open it."""
    count, locked, errors = None, False, []
    for name, read in readers if content is not None else ():
        try:
            found = read(bytes(content))
        except Exception as x:  # noqa: BLE001  any failure of a reader moves on to the next one
            errors.append(f"{name}: {type(x).__name__}")
            continue
        if found.encrypted:
            return len(found.pages) or count, True, False, None, [], "encrypted"
        pages = [(i, t or "") for i, t in enumerate(found.pages, 1)]
        count = max(count or 0, len(pages))
        if any(t.strip() for _, t in pages):
            early = any(t.strip() for _, t in pages[:PROBED])
            return len(pages), False, early, name, [{"page": i, "text": t} for i, t in pages], None
        errors.append(f"{name}: no text")
    return count, locked, False, None, [], "; ".join(errors) or "no content"


def read(files: DataFrame, readers: list[Reader] | None = None) -> DataFrame:
    """(path, doc_id, page_count, encrypted, has_text, method, pages, error) of files (path, content): a row for each file, and no exception. `has_text`: on the first pages.

    doc_id follows from the path, so a rerun gives the same. A null content is a failure.
    """
    used = READERS if readers is None else readers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(path, *opened(content, used)) for path, content in zip(f["path"], f["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "page_count", "encrypted", "has_text", "method", "pages", "error"]).astype({"page_count": "Int64"})

    kind = "path string, page_count int, encrypted boolean, has_text boolean, method string, pages array<struct<page:int,text:string>>, error string"
    return files.select("path", "content").mapInPandas(run, kind).withColumn("doc_id", F.md5(F.coalesce("path", F.lit(""))))


def chunks(found: DataFrame, tenant: str | None = None, most: int = 480, overlap: int = 1, ingested_at: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(path, doc_id, chunk_id, n, page_start, page_end, text, tokens, language, meta, error, also..) of `read`'s rows: the chunks of a good file, or one row with an error.

    Pages are cleaned, a file without ten letters or digits fails, and a chunk may run over pages. Every chunk carries its file's source, tenant, method, page count and the time given.
    """
    keep = ["path", "doc_id", "page_count", "method", "error", *(c for c in also if c not in ("page_count", "method"))]
    cleaned = F.transform("pages", lambda p: F.struct(p["page"].alias("page"), T.clean(p["text"]).alias("text")))
    # an explode of one element binds a value that several expressions use
    once = found.select(*keep, F.explode(F.array(cleaned)).alias("p")).select(*keep, "p", F.explode(F.array(F.array_join("p.text", " "))).alias("whole"))
    failed = F.when(F.col("error").isNull() & ~T.meaningful(F.col("whole")), F.lit("no meaningful text")).otherwise(F.col("error"))
    checked = once.withColumn("error", failed).withColumn("language", F.when(F.col("error").isNull(), T.language(F.col("whole")))).drop("whole")
    sentences = F.flatten(F.transform("p", lambda p: F.transform(T.sentences(p["text"]), lambda s: F.struct(p["page"].alias("page"), s.alias("s")))))
    cut = checked.select(*keep, "language", F.explode(F.array(F.when(F.col("error").isNull(), sentences))).alias("s"))
    cut = cut.select(*keep, "language", "s", F.explode(F.array(F.transform("s", lambda x: T.approx_tokens(x["s"])))).alias("costs"))
    spans = cut.select(*keep, "language", "s", "costs", F.posexplode_outer(C.token_spans(F.col("costs"), most, overlap)).alias("n", "x"))
    part = lambda of: F.slice(of, F.col("x.a") + 1, F.col("x.b") - F.col("x.a"))
    out = spans.select(*keep, "language", "n", F.explode(F.array(F.when(F.col("x").isNotNull(), part("s")))).alias("s"), part("costs").alias("costs"))
    meta = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in {
        "source_url": F.col("path"), "tenant": F.lit(tenant), "extraction_method": F.col("method"), "page_count": F.col("page_count"), "ingested_at": F.lit(ingested_at),
    }.items())), lambda e: e["value"].isNotNull()))
    good = lambda v: F.when(F.col("error").isNull(), v)
    return out.select(
        "path", "doc_id", good(F.concat_ws("_chunk_", "doc_id", F.col("n").cast("string"))).alias("chunk_id"), "n", F.array_min("s.page").alias("page_start"), F.array_max("s.page").alias("page_end"),
        F.array_join("s.s", " ").alias("text"), F.aggregate("costs", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tokens"), "language", meta.alias("meta"), "error", *also,
    )


def records(chunked: DataFrame) -> DataFrame:
    """(text, page, section, meta) of chunk rows, as a store takes them: the page is the first one, and everything else that a chunk has goes into meta as text, nulls left out."""
    own = [c for c in chunked.columns if c not in ("text", "section", "meta", "error")]
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in own)), lambda e: e["value"].isNotNull())
    given = F.coalesce(F.col("meta"), F.create_map().cast("map<string,string>")) if "meta" in chunked.columns else F.create_map().cast("map<string,string>")
    meta = F.map_concat(F.map_filter(F.map_from_entries(pairs), lambda k, v: ~F.map_contains_key(given, k)), given)
    rows = chunked.where("error is null") if "error" in chunked.columns else chunked
    column = lambda name, kind: (F.col(name) if name in chunked.columns else F.lit(None)).cast(kind)
    return rows.select("text", column("page_start", "int").alias("page"), column("section", "string").alias("section"), meta.alias("meta"))
