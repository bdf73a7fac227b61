"""Text columns: cleaning, tokens, sentences, languages, headings. All are JVM expressions except where they say otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters to drop (tab, line feed and carriage return stay).
CONTROL = r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\u009F]"
#: Words whose presence speaks for a language.
GERMAN = ("der", "die", "das", "und", "ist", "ein", "eine", "nicht", "ich", "auf")
ENGLISH = ("the", "and", "is", "a", "an", "not", "i", "on", "to", "of")
#: Roman section numbers that become Arabic.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV")
#: Content types and the parts of other names that stand for one.
CONTENT_TYPES = ("legal_text", "technical", "technical_spec", "table_heavy", "table", "list", "narrative", "mixed", "unknown")
WORD = r"[\p{L}\p{N}_]+"
NUMBERED = r"(?i)^((?:[0-9IVXLC]+(?:\.[0-9IVXLC]+)*)\.?)\s+(.{1,120})$"
CAPITALS = r"^[A-Z0-9][A-Z0-9\s\-:,()]{3,80}$"


def strip(text: Column) -> Column:
    """White space gone at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts of the text that end with . ! or ? before white space, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(strip(text), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def approx_tokens(text: Column) -> Column:
    """Words / 1.3, rounded, at least 1."""
    return F.greatest(F.lit(1), F.round(F.size(words(text)) / 1.3)).cast("bigint")


def chat_tokens(text: Column) -> Column:
    """Words * 1.3, cut off: the other approximation, of chat messages."""
    return F.floor(F.size(words(text)) * 1.3).cast("bigint")


def clean(text: Column) -> Column:
    """Control characters gone, spaces after joined sentences and inside joined words, white space collapsed. Takes NFC text; see `nfc`."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, "")
    out = F.regexp_replace(out, "([a-z])([A-Z])", "$1 $2")
    out = F.regexp_replace(out, "([.!?])([A-Z])", "$1 $2")
    return strip(F.regexp_replace(out, r"\s+", " "))


def nfc(text: Column) -> Column:
    """Unicode NFC, for which Spark has no function: Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else None)

    return F.pandas_udf(run, "string")(text)


def language(text: Column) -> Column:
    """de or en by which has more of its telling words between blanks; unknown if equal or under 50 characters."""
    low = F.lower(text)
    count = lambda known: sum((F.contains(low, F.lit(f" {w} ")).cast("int") for w in known), F.lit(0))
    de, en = count(GERMAN), count(ENGLISH)
    return F.when(text.isNull() | (F.length(text) < 50), "unknown").when(de > en, "de").when(en > de, "en").otherwise("unknown")


def meaningful(text: Column) -> Column:
    """At least ten ASCII letters and digits."""
    return F.length(F.regexp_replace(text, "[^A-Za-z0-9]+", "")) >= 10


def extracted_ok(text: Column, least: int = 10) -> Column:
    """Trimmed length of at least `least`, and 70 % printable characters (line breaks are not)."""
    printable = F.length(F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp} ]", ""))
    return (F.length(strip(text)) >= least) & (printable >= 0.7 * F.length(text))


def preview(text: Column, n: int) -> Column:
    """The first n characters, and dots if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def content_type(name: Column) -> Column:
    """A content type's own name, else the one its parts suggest, else mixed."""
    n = F.lower(strip(F.coalesce(name, F.lit(""))))
    return (
        F.when(n.isin(*CONTENT_TYPES), n)
        .when(F.contains(n, F.lit("table")), F.when(F.contains(n, F.lit("heavy")), "table_heavy").otherwise("table"))
        .when(F.contains(n, F.lit("tech")), F.when(F.contains(n, F.lit("spec")), "technical_spec").otherwise("technical"))
        .when(F.contains(n, F.lit("legal")), "legal_text").when(F.contains(n, F.lit("narr")), "narrative").when(F.contains(n, F.lit("list")), "list").otherwise("mixed")
    )


def normalise(text: Column) -> Column:
    """Lower case, words and . , ! ? % - only, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"[^\p{L}\p{N}_\s.,!?%-]", " "), r"\s+", " ")


def same_key(text: Column) -> Column:
    """Key under which sentences are the same: trimmed, collapsed, lower case."""
    return F.lower(F.regexp_replace(strip(text), r"\s+", " "))


def slug(name: Column) -> Column:
    """Namespace of a name: lower case, blanks and underscores as dashes, 50 characters."""
    return F.left(F.translate(F.lower(name), " _", "--"), F.lit(50))


def section_number(number: Column) -> Column:
    """Without dots at its end; Roman numbers to XV as Arabic."""
    bare = F.regexp_replace(F.coalesce(number, F.lit("")), r"\.+$", "")
    at = F.array_position(F.array(*map(F.lit, ROMAN)), F.upper(bare))
    return F.when(at > 0, at.cast("string")).otherwise(bare)


def around(text: Column, offset: Column, most: int = 200) -> Column:
    """Up to `most` characters each side of an offset (from 0), without words cut in half, trimmed."""
    start, end = F.greatest(F.lit(0), offset - most), F.least(F.length(text), offset + most)
    part = F.substring(text, start + 1, end - start)
    head = (start > 0) & ~F.rlike(F.substring(text, start + 1, F.lit(1)), F.lit(r"\s")) & (F.instr(part, " ") > 0)
    part = F.when(head, F.regexp_replace(part, r"^[^ ]* ", "")).otherwise(part)
    tail = (end < F.length(text)) & ~F.rlike(F.substring(text, end, F.lit(1)), F.lit(r"\s")) & (F.instr(part, " ") > 0)
    return strip(F.when(tail, F.regexp_replace(part, r"(?s) [^ ]*$", "")).otherwise(part))


def title_case(text: Column) -> Column:
    """First letter of every run of letters upper, others lower."""
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}']+|[^\p{L}']+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 10**6)))), "")


def headings(page: Column) -> Column:
    """array<struct<offset, number, title>> of numbered lines and of short lines in capitals; offsets from 0."""
    lines = F.split(page, "\n")
    step = lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x.alias("line")))).alias("out"))
    placed = F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,line:string>>").alias("out")), step)["out"]

    def heading(p: Column) -> Column:
        raw = strip(p["line"])
        numbered = F.rlike(raw, F.lit(NUMBERED))
        capitals = F.rlike(raw, F.lit(CAPITALS)) & (F.size(words(raw)) <= 12)
        number = F.regexp_replace(F.regexp_extract(raw, NUMBERED, 1), r"\.+$", "")
        title = strip(F.regexp_extract(raw, NUMBERED, 2))
        return F.when(numbered, F.struct(p["at"].alias("offset"), number.alias("number"), title.alias("title"))).when(capitals, F.struct(p["at"].alias("offset"), F.lit("").alias("number"), title_case(raw).alias("title")))

    return F.array_compact(F.transform(placed, heading))


def hierarchy(heads: Column) -> Column:
    """array<struct<offset, number, title, path>>: each heading under those of lower depth; an unnumbered one starts anew, gaps are empty."""

    def step(acc, h):
        depth = F.size(F.filter(F.split(h["number"], r"\."), lambda p: p != ""))
        base = F.slice(acc["path"], 1, F.greatest(F.lit(0), depth - 1))
        gaps = F.array_repeat(F.lit(""), F.greatest(F.lit(0), depth - 1 - F.size(acc["path"])))
        path = F.when(h["number"] == "", F.array(h["title"])).otherwise(F.concat(base, gaps, F.array(h["title"])))
        return F.struct(path.alias("path"), F.concat(acc["out"], F.array(F.struct(h["offset"].alias("offset"), h["number"].alias("number"), h["title"].alias("title"), path.alias("path")))).alias("out"))

    kind = "array<struct<offset:int,number:string,title:string,path:array<string>>>"
    return F.aggregate(heads, F.struct(F.array().cast("array<string>").alias("path"), F.array().cast(kind).alias("out")), step)["out"]
