"""Chat formatting with offset-aligned loss masks.

A conversation's turns, in order, are rendered into one string and encoded once with offsets. Control marks are
added tokens of the tokenizer, so no token reaches over a turn's border. The mask of a
token comes from the sorted spans of the assistant's texts by binary search over the token offsets.

Template of a turn: <|turn|>role<|says|>text<|end|>. Inside roles and texts a backslash is doubled and every control
string gets a backslash after its first character; `unescape` reverses it.

Null roles and texts are empty. Rows of equal turn go by role, then text; repeated rows are repeated turns. A null conv_id
is a conversation of its own. A conversation is one row, whatever its length, so memory holds the longest one with its tokens, and a value's limit of
2 GB is a conversation's. The tokenizer takes it in pieces that end between turns, where a control mark parts tokens anyway. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.arrow import lean

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings of this template and of common others; texts may hold any of them.
CONTROL = (TURN, SAYS, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_MARKED = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_TURNS = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}", re.DOTALL)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters that the tokenizer takes at once, and those of the conversations in one Arrow batch, but for the last turn or conversation.
PIECE, BATCH = 1 << 20, 1 << 20


def escape(text: str) -> str:
    """`text` without any control string."""
    return _MARKED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    """What `escape` was given."""
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string, and the sorted spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted string."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURNS.finditer(formatted)]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens inside a span: the span that begins last at or before a token's start is found by binary search."""
    if not spans:
        return np.zeros(len(starts), bool)
    low, high = np.array(spans, np.int64).T
    at = np.searchsorted(low, starts, "right") - 1
    return (at >= 0) & (ends <= high[at]) & (ends > starts)


def tokenizer(vocabulary: str):
    """Tokenizer from the text of its file, with the control strings as whole tokens and untrimmed offsets."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_str(vocabulary)
    t.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROL])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def encode(t, formatted: str, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids, starts and ends of a formatted string, as `t` gives them for the whole."""
    found, at = [], 0
    while at < len(formatted):
        cut = formatted.find(END + TURN, at + piece) + len(END)
        to = cut if cut >= len(END) else len(formatted)
        coded = t.encode(formatted[at:to], add_special_tokens=False)
        spans = np.fromiter(chain.from_iterable(coded.offsets), np.int64, 2 * len(coded.ids)).reshape(-1, 2) + at
        found.append((np.array(coded.ids, np.int32), spans[:, 0], spans[:, 1]))
        at = to
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


SCHEMA = "conv_id long, n_turns int, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), kind))


def format_chats(turns: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """A row (SCHEMA) for each conversation, sorted by it within partitions.

    One shuffle by conversation; the vocabulary file is read on the driver and broadcast (a few MB).
    """
    spark = turns.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = tokenizer(shared.value)
        key, held, done, chars = None, [], [], 0

        def finish() -> int:
            formatted, spans = render(held)
            ids, starts, ends = encode(t, formatted)
            done.append((key[0], len(held), formatted, ids, starts, ends, mask(starts, ends, spans)))
            held.clear()
            return len(formatted)

        def flush() -> pa.RecordBatch:
            conv, n, formatted, *tokens = zip(*done, strict=True)
            lists = [_lists(x, pa.bool_() if i == 3 else pa.int32()) for i, x in enumerate(tokens)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(n, pa.int32()), pa.array(formatted, pa.string()), *lists], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and key != (conv,):
                    chars += finish()
                    if chars >= BATCH:
                        yield flush()
                        chars = 0
                key = (conv,)
                held.append((role, text))
        if held:
            finish()
        if done:
            yield flush()

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(lean(run), SCHEMA)


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> Iterator[str]:
    """The unescaped text under the mask, one piece for each run of masked tokens that touch."""
    begin, end = np.asarray(starts)[np.asarray(loss, bool)], np.asarray(ends)[np.asarray(loss, bool)]
    if len(begin):
        first = np.concatenate([[True], begin[1:] > np.maximum.accumulate(end)[:-1]])
        at = np.flatnonzero(first)
        for s, e in zip(begin[at].tolist(), np.maximum.reduceat(end, at).tolist(), strict=True):
            yield unescape(formatted[s:e])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """DIGEST of each conversation, read back from what `format_chats` returns, in one pass without a shuffle."""

    def one(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> tuple:
        said, under, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
        for role, text in parse(formatted):
            n += 1
            said.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        for piece in masked_text(formatted, starts, ends, loss):
            chars += len(piece)
            under.update(piece.encode("utf-8", "replace"))
        return n, said.hexdigest(), chars, under.hexdigest(), len(formatted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            if b.num_rows:
                cells = zip(*(b.column(c) for c in ("formatted", "token_starts", "token_ends", "loss_mask")), strict=True)
                rows = [one(text.as_py(), *(x.values.to_numpy(zero_copy_only=False) for x in spans)) for text, *spans in cells]
                yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return formatted.mapInArrow(lean(run), DIGEST)
