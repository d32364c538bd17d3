"""Spelling variants: words within one edit of a much commoner word, by a trie of frequency vectors.

A word's frequency vector counts its characters in `GROUPS` letter groups (code point modulo `GROUPS`). One replaced
character adds one to at most one count and takes one from at most one other; an inserted one adds one. So two
words can only be near if their vectors differ by a surplus of at most one and a deficit of at most one.

Words are arranged in a trie by length and then by successive counts. Its upper levels are Spark's: a word
lives at the node of its length and its first counts (`levels` of them), and visits the nodes that a budget of
one surplus and one deficit reaches. Of two neighbours only one visits the other, the shorter one or the one whose
first differing count is smaller, so a word goes to 3 + 2 * levels + levels * (levels - 1) / 2 nodes at most. levels is the smallest
number that keeps all nodes to `NODE_WORDS` words; where even whole vectors do not, a node is dealt
out in blocks, and its visitors go to each of them.

Below, a task builds the rest of a node's trie and searches it depth first with all visitors at once: at
each child, those go on whose budget still covers the child's count. A subtrie of few words is a leaf, whose
words are first held against the visitors' whole budgets and then verified by their characters.

Occurrences are counted in the tasks that read the texts, in a table of bounded size, and added up by Spark; a
very frequent word is one row from each such table. Forms are followed to their roots by pointer jumping.

Defined results: null and empty texts have no words; a null id is written as nothing where ids count; equal rows
count as often as they occur; very long runs of letters are words like others; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerstack.llm.common import stored

#: In UTF-8 that has been lower-cased A-Z: runs of a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Words of a task's table before it is handed on.
TABLE_WORDS = 200_000
#: Texts beyond this are not read into a list of all their words at once.
LIST_BYTES = 1_000_000
GROUPS = 16
#: Words at a node of the upper trie, at a leaf, and cells of comparisons at once.
NODE_WORDS, LEAF_WORDS, CELLS = 20_000, 12, 4_000_000
FIRST_LEVELS = 2

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2


def occurrences(data: bytes, prefix: int | None, spoil: int | None) -> Counter:
    """Words of a lower-cased text and how often each occurs.

    With spoil, a word loses a character where spoil divides its checksum, which goes on from prefix.
    """
    found = RUN.findall(data) if len(data) <= LIST_BYTES else (m[0] for m in RUN.finditer(data))
    counts = Counter(found)
    if spoil is None:
        return counts
    out: Counter = Counter()
    for word, n in counts.items():
        h = zlib.crc32(word, prefix)
        if h % spoil == 0:
            letters = word.decode()
            at = h % len(letters)
            word = (letters[:at] + letters[at + 1 :]).encode()
        out[word] += n
    return out


def count_words(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    spoil: int | None = None,
) -> DataFrame:
    """word and n: words of all texts with enough characters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def table() -> pa.RecordBatch:
            long = [(w, n) for w, n in held.items() if len(w) - w.count(b"\xc3") >= min_length]
            held.clear()
            words = pa.array([w for w, _ in long], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [words, pa.array([n for _, n in long], pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    prefix = zlib.crc32(f"{'' if i is None else i}:".encode())
                    held.update(occurrences(t.encode().lower(), prefix, spoil))
                    if len(held) >= TABLE_WORDS:
                        yield table()
        if held:
            yield table()

    rows = df.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`"))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


def vectors(words: list[str]) -> np.ndarray:
    """Frequency vectors, a row for each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    cells = owner * GROUPS + points % GROUPS
    return np.bincount(cells, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def visits(levels: int) -> list[tuple[int, tuple[int, ...]]]:
    """Steps (in length, in the first counts) to the nodes that a word visits, its own first."""
    unit = lambda *signs: tuple(dict(signs).get(i, 0) for i in range(levels))
    same = [unit()] + [unit((i, 1)) for i in range(levels)]
    same += [unit((i, 1), (j, -1)) for i, j in combinations(range(levels), 2)]
    longer = [unit()] + [unit((i, 1)) for i in range(levels)]
    return [(0, s) for s in same] + [(1, s) for s in longer]


def search(
    words: list[str], homes: np.ndarray, guests: np.ndarray, levels: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of a home (all of one length) and a guest (of that length or one less), as places in words.

    levels counts of all of them are known to fit.
    """
    counts = vectors(words)
    order = homes[np.lexsort(counts[homes].T[::-1])]
    rows = counts[order]
    letters = [w.encode("utf-32-le") for w in words]
    home_length = len(words[homes[0]])

    def leaf(low: int, high: int, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, CELLS // ((high - low) * GROUPS))
        for at in range(0, len(who), step):
            some = who[at : at + step]
            apart = counts[some][:, None, :] - rows[None, low:high, :]
            more, less = np.maximum(apart, 0).sum(2), np.maximum(-apart, 0).sum(2)
            g, h = np.nonzero((more <= 1) & (less <= 1))
            yield some[g], order[low + h]

    def down(level: int, low: int, high: int, who: np.ndarray, more: np.ndarray, less: np.ndarray):
        if high - low <= LEAF_WORDS or level == GROUPS:
            yield from leaf(low, high, who)
            return
        column = rows[low:high, level]
        cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), high - low]
        mine = counts[who, level]
        for a, b in zip(cuts, cuts[1:]):
            apart = mine - column[a]
            more_then, less_then = more + np.maximum(apart, 0), less + np.maximum(-apart, 0)
            on = (more_then <= 1) & (less_then <= 1)
            if on.any():
                yield from down(level + 1, low + a, low + b, who[on], more_then[on], less_then[on])

    zeros = np.zeros(len(guests), np.int32)
    # The upper levels are walked too, as they spend the budget; each has few children here.
    for guest, home in down(0, 0, len(order), guests, zeros, zeros):
        step = max(1, CELLS // max(1, home_length))
        for at in range(0, len(guest), step):
            g, h = guest[at : at + step], home[at : at + step]
            yield from _verified(letters, g, h, home_length)


def _matrix(letters: list[bytes], which: np.ndarray, length: int) -> np.ndarray:
    distinct, place = np.unique(which, return_inverse=True)
    data = b"".join(letters[i] for i in distinct.tolist())
    return np.frombuffer(data, np.uint32).reshape(-1, length)[place]


def _verified(
    letters: list[bytes], guest: np.ndarray, home: np.ndarray, length: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that differ by exactly one replaced or inserted character."""
    sizes = np.fromiter((len(letters[g]) // 4 for g in guest.tolist()), np.int64, len(guest))
    for size in (length, length - 1):
        own = sizes == size
        if not own.any():
            continue
        g, h = guest[own], home[own]
        mine, theirs = _matrix(letters, g, size), _matrix(letters, h, length)
        if size == length:
            near = (mine != theirs).sum(1) == 1
        else:
            # Equal up to some place, and from there on moved by one.
            ahead = np.cumprod(mine == theirs[:, :-1], axis=1, dtype=bool).sum(1)
            behind = np.cumprod((mine == theirs[:, 1:])[:, ::-1], axis=1, dtype=bool).sum(1)
            near = ahead + behind >= size
        yield g[near], h[near]


def _node_sizes(words: DataFrame, levels: int) -> DataFrame:
    return words.groupBy("length", F.slice("vector", 1, levels).alias("node")).count()


def near_words(words: DataFrame, node_words: int = NODE_WORDS) -> DataFrame:
    """word, n_near, form, form_n: how many words are near, and the commonest of them (ties: the smallest).

    words has word and n, each word once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vectors(batch.column(0).to_pylist())
            ends = pa.array(np.arange(len(own) + 1) * GROUPS, pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(own.ravel(), pa.int32()))
            lengths = pa.array(own.sum(1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lengths, lists], names=["word", "n", "length", "vector"]
            )

    schema = "word string, n long, length int, vector array<int>"
    words = stored(words.select("word", "n").mapInArrow(count, schema), "variants-words")
    levels = FIRST_LEVELS
    while True:
        sizes = _node_sizes(words, levels)
        most = sizes.agg(F.max("count")).first()[0] or 0
        if most <= node_words or levels == GROUPS:
            break
        levels += 1
    sizes = sizes.withColumn("blocks", F.ceil(F.col("count") / node_words).cast("int")).drop("count")

    steps = F.array(*[
        F.struct(
            F.lit(longer).alias("longer"), F.array(*map(F.lit, step)).alias("step"), F.lit(i == 0).alias("own")
        )
        for i, (longer, step) in enumerate(visits(levels))
    ])
    routes = words.select("word", "n", "length", F.slice("vector", 1, levels).alias("first"), F.explode(steps).alias("s"))
    routes = routes.select(
        "word", "n", "s.own", (F.col("length") + F.col("s.longer")).alias("length"),
        F.zip_with("first", F.col("s.step"), lambda a, b: a + b).alias("node"),
    )
    # Nodes without words of their own are dropped here. Homes go to one block, guests to all.
    routes = routes.join(sizes, ["length", "node"])
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    routes = routes.withColumns(
        {
            "home": F.when(F.col("own"), block),
            "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)),
        }
    )

    def pairs(table: pa.Table) -> pa.Table:
        names, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        own = table.column("own").to_numpy()
        home, here = table.column("home").to_numpy(), table.column("block").to_numpy()
        homes = np.flatnonzero(own & (home == here))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(homes):
            for g, h in search(names, homes, np.arange(len(names)), levels):
                # Two words of one node meet twice.
                once = [not o or names[a] < names[b] for a, b, o in zip(g.tolist(), h.tolist(), own[g].tolist())]
                found.append((g[once], h[once]))
        g = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        h = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
        left, right = np.concatenate([g, h]), np.concatenate([h, g])
        texts = table.column("word")
        return pa.table(
            {"word": texts.take(pa.array(left)), "near": texts.take(pa.array(right)), "near_n": pa.array(n[right])}
        )

    found = routes.select("length", "node", "block", "word", "n", "own", "home").groupBy(
        "length", "node", "block"
    ).applyInArrow(pairs, "word string, near string, near_n long")
    return found.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    ).select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word and root, the end of its chain of forms, from links (word, form) that have no circles."""
    ends = stored(links.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = ends.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        step = stored(step, "variants-roots")
        ends = step.select("word", "root")
        if step.where("moved").isEmpty():
            return ends


def group_variants(words: DataFrame, ratio: int = RATIO, node_words: int = NODE_WORDS) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    form is the commonest near word if it occurs at least ratio times as often (ratio is above 1, so forms
    have no circles); root is the end of the chain of forms, the word itself if it has none.
    """
    if ratio <= 1:
        raise ValueError("ratio is above 1")
    words = stored(words.select("word", "n"), "variants-counts")
    near = near_words(words, node_words)
    strong = F.col("form_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n"),
    )
    joined = stored(joined, "variants-forms")
    ends = roots(joined.where("form IS NOT NULL").select("word", "form"))
    return joined.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
