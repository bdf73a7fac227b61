"""LM scoring with a subword lattice: the probability of a text is the sum over all its segmentations into pieces of an existing vocabulary.

The pieces and their scores are a public tokenizer's and stay as they are (`vocabulary`). Its scores are ranks, so a piece of rank r has the prior weight 1 / (r + 2.7), after Zipf. Weights
are the prior together with the expected uses of the pieces in the training texts: rounds of forward-backward over all segmentations, in which the words of the corpus count as often as
they occur. No piece joins the vocabulary or leaves it. A character that is no piece is spelled by the vocabulary's byte pieces, so every text has a probability above zero.

A text is lower-cased (A-Z), cut into words at white space and closed by one end mark. Pieces do not cross words (a word starts with the vocabulary's word mark), so the marginal of a text
is the product of its words' marginals and the end's. Each is found by a forward recursion in log space, over a batch of words at once: arcs come from walking a trie of the pieces
from all positions together, and lengths of words do not matter.

Beside it stands an add-one unigram over whole words (`base`). Words are counted over all training texts. Words that hold more than 1/`HOT` of all tokens are sent to the tasks that read
the texts: there can be no more than `HOT` of them. All others meet the texts' counts by a join on the word, where none of them is a hot key.

A null text is empty: one end mark. A row with null id is trained on. Repeated rows count as often as they occur and get equal scores. Long texts are read in blocks; the arcs of a word
of any length are held in memory, as the word is. With nothing to train on all base counts are 0 and weights are the prior. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.arrow import lean
from spindrift.llm.scratch import Scratch
from spindrift.llm.words import word_blocks

#: Vocabulary; what a rank is raised by; uses that the prior is worth; rounds of forward-backward.
VOCABULARY, ZIPF, PRIOR, ROUNDS = "/opt/tokenizers/piece_bpe_32k.model", 2.7, 10_000.0, 2
#: Words sent to the tasks at most; different words counted in a task before they are handed on; characters in a lattice at once; longer words are walked alone.
HOT, HELD, LATTICE, LONG = 100_000, 200_000, 1 << 17, 256
MARK = "▁"
_BITS = 21
#: A word's own mark characters are no word marks: they stand as a code point that no piece has.
_NO_PIECE = (1 << _BITS) - 1
LN10 = math.log(10)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as strings, then 256 bytes, then the end mark; their prior weights; and the trie of the strings."""

    pieces: tuple[str, ...]
    prior: np.ndarray
    edges: np.ndarray
    nodes: np.ndarray
    ends: np.ndarray

    @property
    def first_byte(self) -> int:
        return len(self.pieces)

    @property
    def end(self) -> int:
        return len(self.pieces) + 256


def _trie(pieces: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted edges (node and code point in one number), the nodes that they lead to, and the piece that ends at each node or -1."""
    edges: dict[int, int] = {}
    ends = [-1]
    for i, piece in enumerate(pieces):
        at = 0
        for c in piece:
            key = at << _BITS | ord(c)
            if key not in edges:
                edges[key] = len(ends)
                ends.append(-1)
            at = edges[key]
        ends[at] = i
    keys = np.array(sorted(edges), np.int64)
    return keys, np.array([edges[k] for k in keys.tolist()], np.int64), np.array(ends, np.int64)


def build(scored: list[tuple[str, float]]) -> Vocabulary:
    """A vocabulary of pieces with scores of minus their ranks. Pieces that no lower-cased word can hold have no share in the weights and are left out."""
    can = [(p, -s) for p, s in scored if p and MARK not in p[1:] and not any("A" <= c <= "Z" for c in p)]
    pieces = tuple(p for p, _ in can)
    last = max((r for _, r in can), default=0.0)
    weight = np.array([1 / (max(r, 0) + ZIPF) for _, r in can] + [1 / (last + ZIPF)] * 256 + [1 / ZIPF])
    return Vocabulary(pieces, weight / weight.sum(), *_trie(pieces))


@cache
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a sentencepiece model file: its ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return build([(model.id_to_piece(i), model.get_score(i)) for i in plain])


@dataclass
class Arcs:
    """Arcs over a stream of words: from position `start` to `end`, with the log weight of each and its word. Arc positions count a place before each word."""

    start: np.ndarray
    end: np.ndarray
    weight: np.ndarray
    piece: np.ndarray  #: -1: a character in bytes
    first: np.ndarray  #: of each word, the position where it starts
    last: np.ndarray
    code: np.ndarray  #: code points by position


def arcs(words: list[bytes], vocab: Vocabulary, log_weight: np.ndarray) -> Arcs:
    """All pieces of all words, and bytes for characters that are no piece."""
    texts = [w.decode("utf-8", "replace") for w in words]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    last = first + sizes
    stream = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    stream[stream == ord(MARK)] = _NO_PIECE
    stream[first] = ord(MARK)
    stream[last] = -1  # on no edge
    at = np.flatnonzero(stream >= 0)
    node = np.zeros(len(at), np.int64)
    starts, ends, pieces = [], [], []
    inside, step = at, 0
    while len(at):
        key = node << _BITS | stream[at + step]
        place = np.minimum(np.searchsorted(vocab.edges, key), len(vocab.edges) - 1)
        on = vocab.edges[place] == key if len(vocab.edges) else np.zeros(len(at), bool)
        at, node, step = at[on], vocab.nodes[place[on]] if len(vocab.edges) else node[on], step + 1
        held = vocab.ends[node]
        full = held >= 0
        starts.append(at[full])
        ends.append(at[full] + step)
        pieces.append(held[full])
    start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, pieces))
    single = np.zeros(len(stream), bool)
    single[start[end == start + 1]] = True
    spelt = inside[~single[inside]]
    points = np.where(stream[spelt] == _NO_PIECE, ord(MARK), stream[spelt])
    weight = np.concatenate([log_weight[piece], _in_bytes(points, vocab, log_weight)])
    piece = np.concatenate([piece, np.full(len(spelt), -1)])
    return Arcs(np.concatenate([start, spelt]), np.concatenate([end, spelt + 1]), weight, piece, first, last, stream)


def _in_bytes(points: np.ndarray, vocab: Vocabulary, log_weight: np.ndarray) -> np.ndarray:
    """Log weights of characters spelled in bytes."""
    different, place = np.unique(points, return_inverse=True)
    each = [sum(log_weight[vocab.first_byte + b] for b in chr(c).encode("utf-8", "replace")) for c in different.tolist()]
    return np.array(each)[place] if len(points) else np.zeros(0)


def _recursion(a: Arcs, backward: bool = False) -> np.ndarray:
    """Log of the sum over all paths from a word's start to each position; backward: from each position to the word's end."""
    total = np.full(len(a.code) + 1, -np.inf)
    goes, comes = (a.end, a.start) if backward else (a.start, a.end)
    edge, size = (a.last, a.first) if backward else (a.first, a.last)
    total[edge] = 0.0
    of = np.searchsorted(a.first, comes, "right") - 1
    away = np.abs(comes - edge[of])  # places between the recursion's start and where the arc leads
    order = np.lexsort((comes, away))
    goes, comes, weight = goes[order], comes[order], a.weight[order]
    if len(a.first) == 1 and len(a.code) > LONG:
        return _one_by_one(total, goes, comes, weight)
    cuts = np.searchsorted(away[order], np.arange(1, int(np.abs(size - edge).max(initial=0)) + 2))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if lo < hi:
            to = comes[lo:hi]
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            total[to[heads]] = np.logaddexp.reduceat(total[goes[lo:hi]] + weight[lo:hi], heads)
    return total


def _one_by_one(total: np.ndarray, goes: np.ndarray, comes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The recursion of one long word, where no two arcs can be taken at once."""
    held = total.tolist()
    for g, c, w in zip(goes.tolist(), comes.tolist(), weight.tolist(), strict=True):
        x, y = held[g] + w, held[c]
        held[c] = x if y == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
    return np.array(held)


def marginals(words: list[bytes], vocab: Vocabulary, log_weight: np.ndarray) -> np.ndarray:
    """Natural log of the sum over all segmentations of each word."""
    out = np.zeros(len(words))
    for lo, hi in _batches(words):
        a = arcs(words[lo:hi], vocab, log_weight)
        out[lo:hi] = _recursion(a)[a.last]
    return out


def _batches(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of words for a lattice each; long words alone."""
    lo = held = 0
    for i, w in enumerate(words):
        if i > lo and (held + len(w) > LATTICE or len(w) > LONG or len(words[i - 1]) > LONG):
            yield lo, i
            lo, held = i, 0
        held += len(w) + 2
    if words:
        yield lo, len(words)


def uses(words: list[bytes], counts: np.ndarray, vocab: Vocabulary, log_weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (and byte) in words that occur so often."""
    out = np.zeros(vocab.end + 1)
    for lo, hi in _batches(words):
        a = arcs(words[lo:hi], vocab, log_weight)
        ahead, behind = _recursion(a), _recursion(a, backward=True)
        of = np.searchsorted(a.first, a.start, "right") - 1
        share = np.exp(ahead[a.start] + a.weight + behind[a.end] - ahead[a.last][of]) * counts[lo:hi][of]
        plain = a.piece >= 0
        out += np.bincount(a.piece[plain], share[plain], len(out))
        for at, n in zip(a.start[~plain].tolist(), share[~plain].tolist(), strict=True):
            point = int(a.code[at])
            for b in chr(ord(MARK) if point == _NO_PIECE else point).encode("utf-8", "replace"):
                out[vocab.first_byte + b] += n
    return out


def held_out(doc_id: Column) -> Column:
    """True for the documents that are not learned from: crc32 of the id as text leaves 2 when divided by 7. Null: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text.alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, total, train): how often each word occurs in all texts and in those that are trained on. Tasks add up before words are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(seen[0] | seen[1])
            held, train = ([c[w] for w in words] for c in seen)
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([h + t for h, t in zip(held, train, strict=True)], pa.int64()), pa.array(train, pa.int64())], names=["word", "total", "train"])

        for b in batches:
            for out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for words in word_blocks(text):
                    seen[not out].update(words)
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield flush()
        yield flush()

    each = _rows(docs).select("held_out", "text").mapInArrow(lean(run), "word binary, total long, train long")
    return each.groupBy("word").agg(F.sum("total").alias("total"), F.sum("train").alias("train"))


@dataclass(frozen=True)
class Model:
    """Weights of pieces (natural logs), and the base model's numbers: training tokens, different ones, training texts (ends), and all tokens."""

    log_weight: np.ndarray
    tokens: int
    types: int
    texts: int
    all_tokens: int


def base(count: np.ndarray, whole: int) -> np.ndarray:
    """log10 of the add-one probability of tokens with these training counts; `whole`: training tokens, different ones and one."""
    return np.log10((np.asarray(count, np.float64) + 1) / whole)


def train(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The model of counted words. What reaches the driver is a number for each piece of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # some MB
    ends = _rows(docs).groupBy("held_out").count().collect()
    texts, rows = sum(r["count"] for r in ends if not r.held_out), sum(r["count"] for r in ends)
    sizes = counts.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.when(F.col("train") > 0, 1)), F.coalesce(F.sum("total"), F.lit(0))).first()
    log_weight = np.log(vocab.prior)
    for _ in range(rounds):
        now = log_weight

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            known = shared.value
            total = np.zeros(known.end + 1)
            for b in batches:
                total += uses(b.column(0).to_pylist(), b.column(1).to_numpy(), known, now)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "n"])

        seen = counts.where("train > 0").select("word", "train").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        expected = np.zeros(vocab.end + 1)
        for r in seen.collect():
            expected[r.piece] = r.n
        expected[vocab.end] = texts
        log_weight = np.round(np.log((expected + PRIOR * vocab.prior) / (expected.sum() + PRIOR)), 12)
    return Model(log_weight, sizes[0] + texts, sizes[1] + (texts > 0), texts, sizes[2] + rows)


def scored(counts: DataFrame, model: Model, vocab: Vocabulary) -> DataFrame:
    """(word, total, known, base, lattice) of each counted word: log10 scores of one occurrence."""
    log_weight, whole = model.log_weight, model.tokens + model.types + 1
    shared = counts.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            train = b.column(2).to_numpy()
            values = [pa.array(train > 0), pa.array(base(train, whole)), pa.array(marginals(b.column(0).to_pylist(), known, log_weight) / LN10)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *values], names=["word", "total", "known", "base", "lattice"])

    return counts.mapInArrow(run, "word binary, total long, known boolean, base double, lattice double")


def score(docs: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document, scores in log10."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    counts = scratch.save(word_counts(docs))
    vocab = vocabulary(path)
    model = train(docs, counts, vocab, rounds)
    words = scratch.save(scored(counts, model, vocab))
    often = F.col("total") * hot > model.all_tokens
    table = words.where(often).collect()  # fewer than `hot` words
    shared = spark.sparkContext.broadcast({bytes(r.word): (r.known, r.base, r.lattice) for r in table})
    end = (model.texts > 0, float(base(np.array(model.texts), model.tokens + model.types + 1)), float(model.log_weight[vocab.end]) / LN10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            rows, rest = [], []
            for text in b.column(2).to_pylist():
                seen: Counter = Counter()
                for part in word_blocks(text):
                    seen.update(part)
                tokens, n_known, base, lattice, cold = 1, int(end[0]), [end[1]], [end[2]], []
                for w, n in seen.items():
                    tokens += n
                    if w in known:
                        k, x, y = known[w]
                        n_known += n * k
                        base.append(n * x)
                        lattice.append(n * y)
                    else:
                        cold.append((w, n))
                rows.append((tokens, n_known, math.fsum(base), math.fsum(lattice)))
                rest.append([{"word": w, "n": n} for w, n in cold])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, pa.array(rest, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "lattice", "rest"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, lattice double, rest array<struct<word: binary, n: bigint>>"
    read = scratch.save(_rows(docs).mapInArrow(lean(run), schema).withColumn("row", F.monotonically_increasing_id()))
    each = read.select("row", F.explode("rest").alias("c")).select("row", "c.word", "c.n")
    met = each.join(words.where(~often).select("word", "known", F.col("base").alias("b"), F.col("lattice").alias("l")), "word")
    more = met.groupBy("row").agg(F.sum(F.col("n") * F.col("known").cast("int")).alias("k"), F.sum(F.col("n") * F.col("b")).alias("b"), F.sum(F.col("n") * F.col("l")).alias("l"))
    full = read.drop("rest").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return full.select("doc_id", "held_out", "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), F.round(plus("base", "b"), 9).alias("base_score"), F.round(plus("lattice", "l"), 9).alias("score"))
