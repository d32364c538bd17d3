"""Language-model scores of whole texts over a lattice of lines, words and subword pieces.

The probability of a text sums over all its segmentations. A line of at least two words is drawn
whole from the lines of the training texts, or word by word; a word is drawn whole from the
training words, or spelled in pieces; a spelling sums over all segmentations into pieces of an
existing public vocabulary, by a forward recursion in log space over the matches that an
Aho-Corasick automaton finds. As lines and words meet only at their ends, the lattice of a text is
a chain of lattices, and the sums factor:

    P(text) = product over lines of [a * P(line) + (1 - a)^n * product of P(word)] * (1 - a) * P(end)
    P(word) = (max(c - D, 0) + (D * V + 1) * spell(word)) / (N + 1.5)
    spell(word) = sum over segmentations of product of q(piece) * q(stop) / (1 - q(stop))

c counts the word in training tokens; D is the absolute discount n1 / (n1 + 2 n2) of words met once
and twice; a is the share of units that are lines met more than once. The vocabulary's scores (its
ranks, as p ~ 1 / (rank + 10)) weigh the segmentations of all distinct training words once, and the
expected counts of pieces, smoothed by those scores, become q. All counts cover all training texts.

Counting is one pass with partial sums in tasks. For scoring, the `HEAD` most frequent words (a
bound on what is sent to tasks; at most 64 bytes each) are looked up in tasks; the other words of each
line go through a join with all counts, so scores are exact whatever the bound.

Defined results: a null text is empty and has its end only; a null id is in training; rows are kept
one to one; equal rows have equal scores; an empty table gives an empty table, and without training
texts all words are spelled. Columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerstack.llm.common import stored

HEAD, HEAD_BYTES = 200_000, 64
#: Entries of a task's partial counts before they are handed on, and documents scored at once.
PARTIAL, SLICE = 250_000, 500
#: A line is frequent if it is this part of all lines; there are at most twice as many such lines.
HOT_LINES = 1000
#: Weight of the vocabulary's own scores beside the expected counts.
PRIOR_SHARE = 0.02
SPACE = b" \t\n\r\x0b\x0c"
#: Offset of sums per byte, longest word summed relative to it, and smallest such sum.
LOG_BYTE, SHORT, SMALLEST = math.log(20.0), 64, 1e-250
LOG_TEN = math.log(10)


@functools.cache
def read_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces without outer white space (bytes as characters 0-255) and their probabilities."""
    best: dict[str, int] = {}
    with open(path, "rb") as f:
        for line in f:
            piece, rank = line.split()
            piece = base64.b64decode(piece).strip(SPACE)
            if piece and not any(b in SPACE for b in piece):
                best.setdefault(piece.decode("latin-1"), int(rank))
    for b in set(range(256)) - set(SPACE):  # every word can be spelled
        best.setdefault(chr(b), 1_000_000)
    p = 1 / (np.array(list(best.values()), float) + 10)
    return list(best), p / p.sum()


@functools.cache
def automaton(path: str) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, piece in enumerate(read_pieces(path)[0]):
        found.add_word(piece, (len(piece), i))
    found.make_automaton()
    return found


class Pieces:
    """Scores of the vocabulary's pieces, for sums over segmentations.

    A word's sum is kept relative to BYTE ** n, with each piece's weight multiplied by BYTE per
    byte, which keeps it within the range of numbers for words of usual length; where it leaves
    that range, and for long words, the recursion runs on logarithms throughout.
    """

    def __init__(self, path: str, log_q: list[float], log_stop: float = 0.0):
        self.log_q, self.log_stop = log_q, log_stop
        lengths = np.array([len(p) for p in read_pieces(path)[0]])
        self.weights = np.exp(np.array(log_q) + lengths * LOG_BYTE).tolist()
        self.find = automaton(path).iter

    def log_sum(self, word: bytes) -> float:
        """Log of the summed weight of all segmentations."""
        n = len(word)
        if n <= SHORT:
            weights, alpha = self.weights, [1.0] + [0.0] * n
            for end, (m, i) in self.find(word.decode("latin-1")):
                alpha[end + 1] += alpha[end + 1 - m] * weights[i]
            if alpha[n] > SMALLEST:
                return math.log(alpha[n]) - n * LOG_BYTE
        return forward(word, self.find, self.log_q)[-1]

    def spell(self, word: bytes) -> float:
        """Log10 of the probability of a spelling, its end included."""
        return (self.log_sum(word) + self.log_stop) / LOG_TEN

    def add_expected(self, word: bytes, into: list[float]) -> float:
        """Add the expected number of uses of each piece; returns the expected number of pieces."""
        n = len(word)
        matches = list(self.find(word.decode("latin-1")))
        if n > SHORT:
            return expected_counts(word, matches, self.log_q, into)
        weights, alpha, beta = self.weights, [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for end, (m, i) in matches:
            alpha[end + 1] += alpha[end + 1 - m] * weights[i]
        total, used = alpha[n], 0.0
        if total <= SMALLEST:
            return expected_counts(word, matches, self.log_q, into)
        for end, (m, i) in reversed(matches):
            x = weights[i] * beta[end + 1]
            begin = end + 1 - m
            beta[begin] += x
            share = alpha[begin] * x / total
            into[i] += share
            used += share
        return used


def forward(word: bytes, matches, log_q: list[float]) -> list[float]:
    """Log of the summed weight of all segmentations of each prefix."""
    n = len(word)
    terms: list[list[float] | None] = [None] * (n + 1)
    alpha = [0.0] * (n + 1)
    at = 0
    for end, (m, i) in matches(word.decode("latin-1")):
        end += 1
        while at < end - 1:  # every end has a match of one byte, so earlier ones are complete
            at += 1
            alpha[at] = _log_sum(terms[at])
            terms[at] = None
        x = alpha[end - m] + log_q[i]
        if terms[end] is None:
            terms[end] = [x]
        else:
            terms[end].append(x)
    while at < n:
        at += 1
        alpha[at] = _log_sum(terms[at])
    return alpha


def _log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    top = max(terms)
    exp = math.exp
    return top + math.log(sum([exp(x - top) for x in terms]))


def expected_counts(word: bytes, matches: list, log_q: list[float], into: list[float]) -> float:
    """As Pieces.add_expected, on logarithms throughout."""
    alpha = forward(word, lambda _: matches, log_q)
    n = len(word)
    total = alpha[n]
    terms: list[list[float]] = [[] for _ in range(n + 1)]
    beta = [0.0] * (n + 1)
    at, used = n, 0.0
    for end, (m, i) in reversed(matches):
        end += 1
        while at > end:
            at -= 1
            beta[at] = _log_sum(terms[at])
        x = log_q[i] + beta[end]
        terms[end - m].append(x)
        share = math.exp(alpha[end - m] + x - total)
        into[i] += share
        used += share
    return used


@dataclass
class LatticeModel:
    """What scoring needs: the pieces' scores, global figures, and the counts as a table."""

    vocabulary: str
    log_q: np.ndarray
    log_stop: float
    discount: float
    words: int  # distinct words
    tokens: int  # N, ends included
    texts: int
    line_share: float
    line_mass: float
    line_discount: float
    counts: DataFrame  # word (null for lines), line, c
    head: dict[bytes, int]  # word: c

    def pieces(self) -> Pieces:
        return Pieces(self.vocabulary, self.log_q, self.log_stop)

    def spell(self, word: bytes) -> float:
        """Log10 of the spelling's probability."""
        return self.pieces().spell(word)

    def word_log10(self, count, spelled):
        """Log10 of P(word), in numbers or arrays."""
        rest = self.discount * self.words + 1
        seen = np.maximum(count - self.discount, 0) + rest * np.power(10.0, spelled)
        with np.errstate(divide="ignore"):
            value = np.where(count > 0, np.log10(seen), math.log10(rest) + spelled)
        return value - math.log10(self.tokens + 1.5)


def words_of(text: str | None) -> list[list[bytes]]:
    """The words of each line that has any."""
    lines = (line.split() for line in (text or "").encode().lower().split(b"\n"))
    return [words for words in lines if words]


def line_key(words: list[bytes]) -> int:
    """A signed 64-bit name of a line of words."""
    h = xxhash.xxh3_64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of words and of lines of two words or more, in one pass: word, line, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        lines: Counter[int] = Counter()

        def flush() -> pa.RecordBatch:
            n, m = len(words), len(lines)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([*words, *repeat(None, m)], pa.binary()).cast(pa.string()),
                    pa.array([*repeat(None, n), *lines], pa.int64()),
                    pa.array([*words.values(), *lines.values()], pa.int64()),
                ],
                names=["word", "line", "n"],
            )
            words.clear()
            lines.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                rows = words_of(t)
                for row in rows:
                    words.update(row)
                lines.update([line_key(row) for row in rows if len(row) > 1])
                if len(words) + len(lines) > PARTIAL:
                    yield flush()
        yield flush()

    parts = docs.select(text).mapInArrow(run, "word string, line long, n long")
    return parts.groupBy("word", "line").agg(F.sum("n").alias("c"))


def fit(docs: DataFrame, vocabulary: str, text: str = "text", head: int = HEAD) -> LatticeModel:
    """Learn from all given documents."""
    spark = docs.sparkSession
    counts = stored(count(docs, text), "lm-counts")
    is_word = F.col("word").isNotNull()
    figures = counts.agg(
        F.count_if(is_word).alias("words"),
        F.coalesce(F.sum(F.when(is_word, F.col("c"))), F.lit(0)).alias("tokens"),
        F.count_if(is_word & (F.col("c") == 1)).alias("n1"),
        F.count_if(is_word & (F.col("c") == 2)).alias("n2"),
        F.count_if(~is_word).alias("lines"),
        F.coalesce(F.sum(F.when(~is_word, F.col("c"))), F.lit(0)).alias("line_tokens"),
        F.coalesce(F.sum(F.when(~is_word & (F.col("c") > 1), F.col("c"))), F.lit(0)).alias("again"),
    ).first()
    texts = docs.count()

    names, prior = read_pieces(vocabulary)
    stop = 0.25
    log_q = np.log(prior * (1 - stop)).tolist()

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, pieces, n = [0.0] * len(log_q), Pieces(vocabulary, log_q), 0
        for batch in batches:
            for word in batch.column(0).cast(pa.binary()).to_pylist():
                pieces.add_expected(word, sums)
                n += 1
        values = np.array([*sums, n])
        at = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(values[at])], names=["piece", "v"]
        )

    parts = counts.where(is_word).select("word").mapInArrow(expect, "piece long, v double")
    # As many rows as the vocabulary has pieces. Sums in order, so that reruns agree.
    rows = parts.groupBy("piece").agg(F.sum("v").alias("v")).collect()
    expected = np.zeros(len(names) + 1)
    for r in rows:
        expected[r["piece"]] = r["v"]
    n_words, used = expected[-1], expected[:-1].sum()
    if used:
        q = (1 - PRIOR_SHARE) * expected[:-1] / used + PRIOR_SHARE * prior
        stop = n_words / (n_words + used)
        log_q = np.log(q * (1 - stop)).tolist()

    frequent = _frequent(counts.where(is_word & (F.octet_length("word") <= HEAD_BYTES)), head)
    line_tokens, lines, again = figures["line_tokens"], figures["lines"], figures["again"]
    units = again + figures["tokens"] + texts
    line_discount = 0.5
    return LatticeModel(
        vocabulary=vocabulary,
        log_q=log_q,
        log_stop=math.log(stop / (1 - stop)),
        discount=figures["n1"] / max(1, figures["n1"] + 2 * figures["n2"]),
        words=figures["words"],
        tokens=figures["tokens"] + texts,
        texts=texts,
        line_share=again / units if units else 0.0,
        line_mass=line_tokens - line_discount * lines,
        line_discount=line_discount,
        counts=counts,
        head=frequent,
    )


def _frequent(words: DataFrame, most: int) -> dict[bytes, int]:
    """At most `most` words: all those from the lowest count at which there are no more."""
    step = F.floor(F.log2("c") * 8)
    rows = words.groupBy(step.alias("step")).count().collect()  # eight rows for each power of two
    total, low = 0, None
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        low = r["step"]
    if low is None:
        return {}
    table = words.where(step >= low).select(F.col("word").cast("binary"), "c").toArrow()
    return dict(zip(table["word"].to_pylist(), table["c"].to_pylist()))


def score(
    df: DataFrame, model: LatticeModel, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = df.sparkSession
    head_words = list(model.head)
    counts = np.array([model.head[w] for w in head_words], float)
    pieces = model.pieces()
    spelled = np.array([pieces.spell(w) for w in head_words])
    vectors = (np.log10(counts + 1), model.word_log10(counts, spelled)) if head_words else None
    head = spark.sparkContext.broadcast(
        ({w: i for i, w in enumerate(head_words)}, vectors, model.log_q, model.log_stop)
    )
    vocabulary = model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, vectors, log_q, log_stop = head.value
        log_c, log_p = vectors if vectors else (np.zeros(1), np.zeros(1))
        pieces = Pieces(vocabulary, log_q, log_stop)
        known: dict[bytes, float] = {}
        # Deterministic: the same rows come in the same order when a task is run again.
        key = (TaskContext.get().partitionId() << 40) - 1
        get = index.get

        def spell(word: bytes) -> float:
            value = known.get(word)
            if value is None:
                value = pieces.spell(word)
                if len(word) <= HEAD_BYTES:
                    if len(known) > PARTIAL:
                        known.clear()
                    known[word] = value
            return value

        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            docs: list[tuple] = []
            lines: list[tuple] = []
            tails: list[tuple] = []
            line_ends, tail_ends = [0], [0]
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key += 1
                rows = words_of(t)
                flat = [w for row in rows for w in row]
                n = len(flat)
                at = np.fromiter(map(get, flat, repeat(-1)), np.int64, n)
                hit = at >= 0
                hits = int(hit.sum())
                value = np.where(hit, log_p[at], 0.0)
                starts = np.cumsum([0, *map(len, rows)])
                sums = np.add.reduceat(value, starts[:-1]).tolist() if n else []
                docs.append((key, doc, n, hits, float(np.where(hit, log_c[at], 0.0).sum())))
                missed = np.flatnonzero(~hit)
                cuts = np.searchsorted(missed, starts).tolist()
                missed = missed.tolist()
                for row, s, i, j in zip(rows, sums, cuts, cuts[1:]):
                    lines.append((line_key(row), len(row), s))
                    if i < j:
                        rest = Counter([flat[x] for x in missed[i:j]])
                        tails += [(w.decode(), k, spell(w)) for w, k in rest.items()]
                    tail_ends.append(len(tails))
                line_ends.append(len(lines))
            tail = _struct(tails, _TAIL)
            tail = pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), tail)
            line = _struct(lines, pa.struct(list(_LINE)[:3]))
            line = pa.StructArray.from_arrays([*line.flatten(), tail], fields=list(_LINE))
            columns = [*_struct(docs, pa.struct(list(ARROW)[:5])).flatten()]
            columns.append(pa.ListArray.from_arrays(pa.array(line_ends, pa.int32()), line))
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW)

    scanned = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`"))
    scanned = stored(scanned.mapInArrow(run, SCHEMA), "lm-lines")
    lines = scanned.select(
        "key", F.posexplode("lines").alias("at", "l")
    ).select("key", "at", "l.line", "l.words", "l.known")
    tails = scanned.select("key", F.posexplode("lines").alias("at", "l")).select(
        "key", "at", F.explode("l.tail").alias("t")
    ).select("key", "at", "t.word", "t.n", "t.spelled")

    words = model.counts.where("word IS NOT NULL").select("word", "c")
    c = F.coalesce("c", F.lit(0)).cast("double")
    rest = model.discount * model.words + 1
    log10_word = F.when(
        c > 0, F.log10(c - model.discount + rest * F.pow(F.lit(10.0), F.col("spelled")))
    ).otherwise(F.col("spelled") + math.log10(rest)) - math.log10(model.tokens + 1.5)
    tails = tails.join(words, "word", "left").groupBy("key", "at").agg(
        F.sum(F.col("n") * log10_word).alias("tail_p"),
        F.sum(F.col("n") * F.log10(c + 1)).alias("tail_base"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"),
    )
    seen = model.counts.where("word IS NULL").select("line", F.col("c").alias("line_c"))
    share = model.line_share
    by_word = F.col("known") + F.coalesce("tail_p", F.lit(0.0))
    by_word = by_word + F.col("words") * math.log10(1 - share)
    # Frequent lines get their counts from a broadcast; in the join they are dealt out as if each were another.
    hot = seen.where(F.col("line_c") >= max(2.0, model.line_mass / HOT_LINES))
    lines = lines.join(tails, ["key", "at"], "left").join(
        F.broadcast(hot.withColumnRenamed("line_c", "hot_c")), "line", "left"
    )
    lines = lines.withColumn(
        "by", F.when(F.col("hot_c").isNull(), F.col("line")).otherwise(F.xxhash64("key", "at"))
    )
    lines = lines.join(seen.withColumnRenamed("line", "by"), "by", "left").withColumn(
        "line_c", F.coalesce("hot_c", "line_c")
    )
    if share > 0:
        whole = F.log10((F.col("line_c") - model.line_discount) * (share / model.line_mass))
        top = F.greatest(whole, by_word)
        value = F.when(
            F.col("line_c").isNull(), by_word
        ).otherwise(
            top + F.log10(F.pow(F.lit(10.0), whole - top) + F.pow(F.lit(10.0), by_word - top))
        )
    else:
        value = by_word
    totals = lines.groupBy("key").agg(
        F.sum(value).alias("p"),
        F.sum("tail_base").alias("tail_base"),
        F.sum("tail_known").alias("tail_known"),
    )
    end = math.log10((model.texts + 0.5) / (model.tokens + 1.5)) + math.log10(1 - share)
    types = model.words + (model.texts > 0)
    unit = math.log10(model.tokens + 1 * (types + 1))
    zero = F.lit(0.0)
    n_tokens = F.col("n_words") + 1
    return scanned.select("key", "doc_id", "n_words", "hits", "base").join(
        totals, "key", "left"
    ).select(
        "doc_id",
        n_tokens.alias("n_tokens"),
        (
            F.col("hits") + F.coalesce("tail_known", F.lit(0)) + (1 if model.texts else 0)
        ).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (
            F.col("base") + F.coalesce("tail_base", zero) + math.log10(model.texts + 1)
            - n_tokens * unit
        ).alias("base_score"),
        (F.coalesce("p", zero) + end).alias("score"),
    )


def _struct(rows: list[tuple], kind: pa.StructType) -> pa.StructArray:
    columns = list(zip(*rows)) or [()] * kind.num_fields
    fields = list(kind)
    return pa.StructArray.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields
    )


SCHEMA = (
    "key long, doc_id long, n_words long, hits long, base double, lines array<struct<line: long, "
    "words: long, known: double, tail: array<struct<word: string, n: long, spelled: double>>>>"
)
_TAIL = pa.struct([("word", pa.string()), ("n", pa.int64()), ("spelled", pa.float64())])
_LINE = pa.struct(
    [("line", pa.int64()), ("words", pa.int64()), ("known", pa.float64()), ("tail", pa.list_(_TAIL))]
)
ARROW = pa.schema(
    [
        ("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("hits", pa.int64()), ("base", pa.float64()), ("lines", pa.list_(_LINE)),
    ]
)


def fold(doc_id, folds: int):
    """Fold of an id: crc32 of its text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
