"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its elements, each named by the chain of containers it stands in, and its text blocks. A token's
occurrence vector has its count in each page of a host; tokens of equal vectors are an equivalence class. Vectors are
not gathered: a class is found by page count, total count and two sums of hashed (page, count) pairs, which partial
aggregation adds up. Classes of two tokens or more that hold once in nearly every page of the host are valid; their containers nest
into the template. What stands directly in a container is its slot. A slot is content if its text is mostly outside links, varies
over the pages that have it, and is prose or not small. The main container is the deepest one of the template that holds all content slots, or the
article or main element around it; with its siblings in page order, what it holds in a page is that page's text. A page without its host's main container takes the
one deduced over all hosts. A block that nearly all pages of a host repeat, by the lower bound of that share, is template too, if the pages differ; inside a main
container that holds for short lines only, as a sentence that every article holds is still the article's.

The lists of telling names (APART, ROLES, NAMES) are a last resort beside the template: they drop what no count tells from an article, as reader comments, and what
surrounds the text where a host has one page only. They have no part in finding the template, and inside a main container a name alone drops nothing that the template calls content.

A null or empty html has an empty text, as a page without main text has. A null url has host ''. Repeated rows keep their rows and count as pages. An
unclosed comment or script hides what follows it, as in a browser. Containers that tie go by weight, then depth, then hash. Very long, deep or broken pages take time and
memory in proportion to their length. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.arrow import lean
from spindrift.llm.scratch import Scratch
from spindrift.llm.urlrep import host_of

# Elements of HTML by what they mean here.
RAW = frozenset("script style noscript template iframe xmp noembed noframes title textarea svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd figcaption caption summary legend address".split())
CONTAINERS = frozenset(
    "html body div section article main table tbody thead tfoot tr th td center blockquote nav header footer aside form ul ol dl menu figure fieldset details dialog search hgroup".split()
)
BLOCKS = CONTAINERS | PROSE | frozenset("hr head option".split())
ARTICLES, TOPS = frozenset("article main".split()), frozenset("html body".split())
APART = frozenset("nav footer aside form button select dialog menu object audio video canvas head search label datalist".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner sponsor sponsored promo promotion comment comments disqus replies respond "
    "sidebar menu menus nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "signup share sharing social related recommended footer masthead widget widgets toolbar skip pagination pager login".split()
)
#: Those of them that name what readers write; no count tells that from an article.
READERS = frozenset("comment comments disqus replies respond".split())
#: An end tag that these start tags imply, and the elements that it doesn't reach beyond.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
#: Share of a host's pages that a template token is in; part of the distinct texts that pages would have if all differed, from which a slot varies; size of the largest slot under which one without prose is small.
SUPPORT, VARIES, SMALL = 0.6, 0.5, 0.2
#: A block is template if the lower bound (one-sided, 95 %) of its share of the pages reaches this.
REPEATED, Z = 0.85, 1.645
#: Inside a main container only a line of so few words that ends no sentence can be template by repetition: a sentence that every article holds is still the article's.
LINE = re.compile(r"(?:\S+ ){0,3}\S*[^\s.!?:;,…。！？\"'»”)\]]")
ANY = "*"
#: What a row of `tokens` counts: the page, a text block, an element, and containers: any, article or main, html or body.
PAGE, BLOCK, ELEMENT, CONTAINER, ARTICLE, TOP = -2, -1, 0, 1, 2, 3
_BITS = 64


def _hash(parent: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), parent) >> 1


class Page:
    """What parsing gives: a tree of containers (node 0: outside of all) with their tokens, text blocks with their node, and counts of elements."""

    def __init__(self) -> None:
        self.parent, self.token, self.kind = array("q", [0]), array("q", [0]), array("b", [TOP])
        self.blocks: list[tuple[int, str, bool, bool, int]] = []  # node, text, linked, prose, apart: 1 by a name alone, 2 by its element, role or readers' names
        self.counts: dict[int, int] = defaultdict(int)

    def add(self, parent: int, token: int, kind: int) -> int:
        self.parent.append(parent)
        self.token.append(token)
        self.kind.append(kind)
        return len(self.parent) - 1


def _apart(name: str, attributes: dict[str, str], inside_article: bool) -> int:
    """Whether an element is boilerplate by its kind, role or readers' names (2), or by another name in its class or id only (1)."""
    if name in APART or (name == "header" and not inside_article) or attributes.get("role") in ROLES:
        return 2
    if name in TOPS or name in ARTICLES:
        return 0
    told = {w for k in ("class", "id") if k in attributes for w in re.split(r"[\s_-]+", attributes[k])} & NAMES
    return 2 if told & READERS else int(bool(told))


def parse(source: str | None) -> Page:
    """One pass over the tags, in time proportional to the page."""
    page = Page()
    if not source:
        return page
    stack: list[tuple[str, int, int]] = []  # name, apart, node before
    places: dict[str, list[int]] = defaultdict(list)  # of open elements by name
    block_at: list[int] = []  # places of open block elements
    node, apart, muted, buffer = 0, [0, 0, 0], 0, []  # apart: open elements by level; muted: inside an inline element that is apart

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                prose = bool(block_at) and stack[block_at[-1]][0] in PROSE
                page.blocks.append((node, text, bool(places["a"]), prose, 2 if apart[2] else int(apart[1] > 0)))

    def close(to: int) -> None:
        nonlocal node, muted
        while len(stack) > to:
            name, named, before = stack[-1]
            if name in BLOCKS:
                flush()
                block_at.pop()
                apart[named] -= 1
            else:
                muted -= named > 0
            stack.pop()
            places[name].pop()
            node = before

    nearest = lambda names: max((places[n][-1] for n in names if places[n]), default=-1)
    at, size = 0, len(source)
    last_gt = source.rfind(">")
    lower = None
    while at < size:
        lt = source.find("<", at)
        if lt < 0 or lt > last_gt:  # no tag ends any more
            if not muted:
                buffer.append(re.split("<[!?]", source[at:], maxsplit=1)[0])
            break
        if lt > at and not muted:
            buffer.append(source[at:lt])
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 2)
            at = size if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), lt):
            at = source.find(">", lt) + 1
            continue
        m = _TAG.match(source, lt)
        if not m:
            if not muted:
                buffer.append("<")
            at = lt + 1
            continue
        ending, name, attrs = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        at = m.end()
        if ending:
            if places[name]:
                close(places[name][-1])
            elif name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            if block_at and stack[block_at[-1]][0] == "p":
                close(block_at[-1])
            flush()
        if name in CLOSES:
            found = nearest(CLOSES[name])
            if found > nearest(LIMITS[name]):
                close(found)
        if name not in CONTAINERS:
            page.counts[_hash(page.token[node], name)] += 1
        if name in RAW:
            lower = lower if lower is not None else source.lower()
            if len(lower) != size:  # a character changed its length: search without case folding
                lower = re.sub("[A-Z]+", lambda x: x[0].lower(), source)
            end = lower.find(f"</{name}", at) if not attrs.endswith("/") or name not in ("svg", "math") else at
            at = size if end < 0 else end
            continue
        if name == "br" or name == "hr":
            if not muted:
                buffer.append(" ")
            continue
        if name in VOID:
            continue
        attributes = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if attrs else {}
        named = _apart(name, attributes, bool(places["article"] or places["main"]))
        before = node
        if name in CONTAINERS:
            token = _hash(page.token[node], f"{name}.{'.'.join(sorted(attributes.get('class', '').split()))}")
            node = page.add(node, token, ARTICLE if name in ARTICLES else TOP if name in TOPS else CONTAINER)
        if name in BLOCKS:
            block_at.append(len(stack))
            apart[named] += 1
        else:
            muted += named > 0
        places[name].append(len(stack))
        stack.append((name, named, before))
    close(0)
    flush()
    return page


def main_text(page: Page, mains: tuple[int, ...] = (), repeated: frozenset[int] = frozenset(), names: bool = True, content: frozenset[int] = frozenset()) -> str:
    """Blocks inside the first of the main containers that the page has, or all blocks; with `names` without those apart by their names.

    Where the page has a main container, the template comes before the lists: a name alone does not drop a slot that the template calls content, and of repeated blocks only short lines go.
    """
    have = set(page.token)
    main = next((m for m in mains if m in have), None)
    inside = bytearray(len(page.parent))
    for i, (up, token) in enumerate(zip(page.parent, page.token, strict=True)):
        inside[i] = main is None or token == main or (i > 0 and inside[up])

    def stays(node: int, text: str, apart: int) -> bool:
        if names and (apart == 2 or (apart == 1 and (main is None or page.token[node] not in content))):
            return False
        return not repeated or (main is not None and not LINE.fullmatch(text)) or block_token(text) not in repeated

    return "\n\n".join(text for node, text, _, _, apart in page.blocks if inside[node] and stays(node, text, apart))


def block_token(text: str) -> int:
    return _hash(1, text)


def slots(page: Page) -> dict[int, tuple[int, int, int, int, int, int, int]]:
    """Of each container token: times it occurs, kind, parent's token, characters directly in it outside and inside links, and in prose, and a bit for its text."""
    n = len(page.parent)
    own, linked, prose, told = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text, is_link, is_prose, _ in page.blocks:
        if is_link:
            linked[node] += len(text)
        else:
            own[node] += len(text)
            prose[node] += len(text) if is_prose else 0
            told[node] = told[node] * 31 + block_token(text) & (1 << 62) - 1
    out: dict[int, tuple] = {}
    for i in range(1, n):
        had = out.get(page.token[i], (0, 0, 0, 0, 0, 0, 0))
        bit = 1 << (told[i] ^ told[i] >> 17) % _BITS if own[i] else 0
        out[page.token[i]] = (had[0] + 1, page.kind[i], page.token[page.parent[i]], had[3] + own[i], had[4] + linked[i], had[5] + prose[i], had[6] | bit)
    return out


_SUMS = ("pages", "total", "s1", "s2", "own", "linked", "prose")
_KEY = ("token", "kind", "parent")


def tokens(pages: DataFrame) -> DataFrame:
    """(host, token, kind, parent, pages, total, s1, s2, own, linked, prose, bits): tokens of the pages (host, html), added up within tasks."""
    most = 200_000
    names = ["host", *_KEY, *_SUMS, "bits"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), *[pa.int64()] * len(_SUMS), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*k, *v[:-1], v[-1] - (1 << 64) if v[-1] >> 63 else v[-1]) for k, v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = parse(source)
                key = xxhash.xxh64_intdigest((source or "").encode("utf-8", "replace"))
                found = {(host, t, ELEMENT, 0): (n, 0, 0, 0, 0) for t, n in page.counts.items()}
                found |= {(host, t, kind, up): (n, *x) for t, (n, kind, up, *x) in slots(page).items()}
                found |= {(host, block_token(text), BLOCK, 0): (1, 0, 0, 0, 0) for _, text, _, _, _ in page.blocks}
                found[host, -1, PAGE, 0] = (1, 0, 0, 0, 0)
                for k, (n, own, linked, prose, bits) in found.items():
                    mark = _hash(key, str(n))
                    row = sums.setdefault(k, [0] * (len(_SUMS) + 1))
                    for i, x in enumerate((1, n, mark & 0x7FFFFFFF, mark >> 31 & 0x7FFFFFFF, own, linked, prose)):
                        row[i] += x
                    row[-1] |= bits
                if len(sums) >= most:
                    yield flush()
        if sums:
            yield flush()

    schema = "host string, token long, kind int, parent long, " + ", ".join(f"{x} long" for x in (*_SUMS, "bits"))
    return _added(pages.mapInArrow(lean(run), schema), "host")


def _added(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by, *_KEY).agg(*(F.sum(x).alias(x) for x in _SUMS), F.bit_or("bits").alias("bits"))


def content_of(rows: list[dict]) -> set[int]:
    """Slots of a host that are content, from its frequent containers: mostly outside links, varying, and prose or not small."""
    by = {r["token"]: r for r in rows}
    alike = lambda n: _BITS * -math.expm1(n * math.log1p(-1 / _BITS))  # noqa: E731  bits that n different texts set
    varied = [t for t in by if by[t]["own"] > 0 and by[t]["own"] >= by[t]["linked"] and (by[t]["bits"] & (1 << _BITS) - 1).bit_count() >= VARIES * alike(by[t]["pages"])]
    largest = max((by[t]["own"] for t in varied), default=0)
    return {t for t in varied if 2 * by[t]["prose"] >= by[t]["own"] or by[t]["own"] >= SMALL * largest}


def main_of(rows: list[dict]) -> int | None:
    """The main container of a host, from its frequent containers: token, parent, kind, valid, pages, own, linked, prose, bits; None if that is the whole page."""
    by = {r["token"]: r for r in rows}
    depth: dict[int, int] = {}
    for r in rows:
        way, t = [], r["token"]
        while t in by and t not in depth:
            way.append(t)
            t = by[t]["parent"]
        for k, x in enumerate(reversed(way), depth.get(t, 0) + 1):
            depth[x] = k
    order = sorted(by, key=lambda t: (depth[t], t))
    content = content_of(rows)

    def sums(of: set[int]) -> tuple[dict[int, int], dict[int, int]]:
        count, weight = {t: int(t in of) for t in order}, {t: by[t]["own"] * (t in of) for t in order}
        for t in reversed(order):
            if by[t]["parent"] in by:
                count[by[t]["parent"]] += count[t]
                weight[by[t]["parent"]] += weight[t]
        return count, weight

    count, weight = sums(content)
    whole = sum(by[t]["own"] for t in content)
    articles = [t for t in order if by[t]["valid"] and by[t]["kind"] == ARTICLE and whole and 2 * weight[t] >= whole]
    if articles:  # what stands around an article that holds most of the content is none
        scope = min(articles, key=lambda t: (-weight[t], depth[t], t))
        inside: set[int] = set()
        for t in order:
            if t == scope or by[t]["parent"] in inside:
                inside.add(t)
        content &= inside
        count, weight = sums(content)
    holds = [t for t in order if by[t]["valid"] and content and count[t] == len(content)]
    if not holds:
        return None
    main = up = max(holds, key=lambda t: (depth[t], t))
    while up in by and by[up]["kind"] != ARTICLE:
        up = by[up]["parent"]
    main = up if up in by else main
    return None if by[main]["kind"] == TOP else main


def lower_bound(k: Column, n: Column, z: float = Z) -> Column:
    """Lower bound (Wilson) of the share of which k of n were seen."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def templates(found: DataFrame) -> DataFrame:
    """(host, main, repeated, content) of each host: its main container, its repeated blocks and its content slots.

    A host's tokens are aggregated and joined; gathered are its frequent containers only, at most 1 / SUPPORT times as many as a page has, and
    its repeated blocks, 1 / REPEATED times.
    """
    per = found.where(F.col("kind") == PAGE).select("host", F.col("pages").alias("n"))
    fewest = math.ceil(Z * Z * REPEATED / (1 - REPEATED))  # a block on fewer pages can't reach the bound
    known = found.where((F.col("kind") >= ELEMENT) | ((F.col("kind") == BLOCK) & (F.col("pages") >= fewest))).join(per, "host")
    once = (F.col("pages") == F.col("total")) & (F.col("kind") >= ELEMENT)
    frequent = known.where((F.col("kind") >= ELEMENT) & (F.col("pages") >= F.col("n") * SUPPORT))
    classes = frequent.where(once).groupBy("host", "pages", "s1", "s2").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    nested = frequent.where(F.col("kind") >= CONTAINER).join(classes, ["host", "pages", "s1", "s2"], "left").withColumn("valid", once & F.col("members").isNotNull())

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        rows = f.to_dict("records")
        # one page tells nothing about what varies
        content = sorted(content_of(rows)) if f["pages"].max() > 1 else []
        return pd.DataFrame({"host": f["host"].iloc[:1].to_list(), "main": pd.array([main_of(rows)], "Int64"), "content": [content]})

    mains = nested.select("host", *_KEY, "pages", "own", "linked", "prose", "bits", "valid").groupBy("host").applyInPandas(choose, "host string, main long, content array<bigint>")
    differing = found.where(F.col("kind") == BLOCK).groupBy("host").agg(F.count(F.lit(1)).alias("different"))
    repeated = known.where((F.col("kind") == BLOCK) & (lower_bound(F.col("pages"), F.col("n")) >= REPEATED)).join(differing, "host").where("different >= n")
    repeated = repeated.groupBy("host").agg(F.collect_set("token").alias("repeated"))
    return per.join(mains, "host", "left").join(repeated, "host", "left").select("host", "main", "repeated", "content")


def extract(pages: DataFrame, broadcast_hosts: int = 20_000, names: bool = True) -> DataFrame:
    """page_id, url and text of every page. Hosts' templates are broadcast if at most `broadcast_hosts`, else joined by a shuffle. Without `names` the template alone decides."""
    scratch = Scratch(pages.sparkSession, "htmltext")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    found = scratch.save(tokens(rows.select("host", "html")))
    common = templates(_added(found).withColumn("host", F.lit(ANY))).first()
    shared = F.lit(common.main if common else None).cast("long")
    known = scratch.save(templates(found)).select("host", F.array_compact(F.array("main", shared)).alias("mains"), "repeated", "content")
    joined = rows.join(F.broadcast(known) if known.count() <= broadcast_hosts else known, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(parse(s), tuple(m or ()), frozenset(r or ()), names, frozenset(c or ())) for s, m, r, c in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "mains", "repeated", "content").mapInArrow(lean(run), "page_id long, url string, text string")
