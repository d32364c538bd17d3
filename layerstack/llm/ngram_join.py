"""Documents whose sets of word n-grams have a Jaccard similarity of at least 0.8, by a prefix-tree join.

1. Sets. A document's set holds the hashes of its distinct 5-word shingles. One pass over packs of
   documents counts in how many sets each shingle occurs; the sets are ordered rarest first, the
   same for all. Only the first |x| - ceil(0.8 |x|) + 1 shingles of a set (its prefix) need be looked
   at: similar sets share one there. Where they occur in no other set, the document is alone.
2. Candidates. Equal sets are one class. Classes that share a prefix shingle and are of like length
   are chained (through the smallest class of each shingle and length band, so a shingle of a third of
   all sets makes no more links than sets), and chains are followed to candidate components.
3. Join. Where a component is too large for one task, each set is first compared with one other, the one
   that shares most of its prefix; mostly this links the whole component, as copies of one text are, and it is
   done. Each other component's sets go to a task together, large ones in blocks by a hash, each
   pair of blocks in a task. There the sets form a trie: sorted by their ordered shingles, with the depths
   at which neighbours branch. A probe goes down the branches that hold a set sharing a
   prefix shingle, keeps the overlap of the path shared with the branch before, and leaves
   a subtree as soon as the shingles that remain cannot make up the overlap needed. Sets already linked,
   directly or not, are not compared again, so links span the components and no pairs are
   listed.
4. Components of the links give every document the smallest id it can reach.

Shingles are named by 64 bits of a hash within sets, sets by 128 bits. Counts for the order use fewer
bits; a mistaken count only changes the order, which stays one order for all.

Defined results: a null text is empty; documents without words are linked with nothing, and their
component is their own id; with fewer than five words the whole sequence is the one shingle; rows are
kept one to one; a component with ids takes the smallest (null ids are passed over), one without has a null
component_id; only id and text are read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerstack.llm.common import WordHashes, gram_hashes, let_go, stored
from layerstack.llm.links import components
from layerstack.llm.packs import Answers, Pack, ask, join_answers, pack, split_words

SHINGLE = 5
#: Sets, and shingles in them, that a block has on average at most.
BLOCK_SETS, BLOCK_SHINGLES = 2000, 2_000_000
#: Bytes by which shingles are named for counting, beside the bucket.
COUNT_BYTES = 5


def needed(length: int) -> int:
    """Shingles that a set of this length shares with any set similar to it."""
    return (80 * length + 99) // 100


def similar(overlap: int, a: int, b: int) -> bool:
    """Whether 100 * intersection >= 80 * union."""
    return 180 * overlap >= 80 * (a + b)


def document_sets(p: Pack) -> list[np.ndarray]:
    """Distinct shingles of each document, ascending."""
    grams = gram_hashes(p.words, SHINGLE)
    out = []
    for begin, end in zip(p.starts.tolist(), p.ends.tolist()):
        n = end - begin
        if n >= SHINGLE:
            out.append(np.unique(grams[begin : end - SHINGLE + 1]))
        elif n:  # salted by their number, so that short sequences are no shingles of others
            out.append(gram_hashes(p.words[begin:end], n, salt=100 + n))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def text_hash(text: str | None) -> int:
    """The text's xxhash64 as Spark gives it; null as empty."""
    h = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def _entries(sets: list[np.ndarray], keys: list[bytes]):
    """Distinct shingles of a pack and in how many different sets they are."""
    different = list({k: s for k, s in zip(keys, sets)}.values())
    if not different:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(np.concatenate(different), return_counts=True)


def _commonness(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 for shingles of one set; then steps of the logarithm of the number of sets."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.diff(hashes[order]) != 0
    total = np.add.reduceat(counts[order], np.flatnonzero(new))
    level = np.where(total > 1, 2 + np.floor(4 * np.log2(total)), 1)
    out = np.empty(len(order), np.uint8)
    out[order] = np.minimum(level, 255)[np.cumsum(new) - 1]
    return out


def ordered_sets(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, text_hash (Spark's xxhash64), n (size), key, prefix and shingles.

    prefix holds the prefix shingles that other sets have too; shingles the whole ordered set
    (8 bytes each) where there are any and the pack has not given this set before.
    """
    packs = pack(df, doc_id, text)
    memory = WordHashes()

    def entries(ids, texts):
        sets = document_sets(split_words(ids, texts, memory, True)[0])
        return _entries(sets, [set_key(s) for s in sets])

    answers = ask(packs, entries, _commonness, COUNT_BYTES)

    def make(ids, texts, answers: Answers) -> pa.RecordBatch:
        sets = document_sets(split_words(ids, texts, memory, True)[0])
        keys = [set_key(s) for s in sets]
        distinct, _ = _entries(sets, keys)
        level = answers.to(distinct)
        prefixes, wholes, given = [], [], set()
        for s, key in zip(sets, keys):
            own = level[np.searchsorted(distinct, s)] if len(s) else np.empty(0, np.uint8)
            order = np.argsort(own, kind="stable")  # by level, then by hash
            first = order[: len(s) - needed(len(s)) + 1] if len(s) else order
            shared = s[first[own[first] > 1]]
            prefixes.append(shared.view(np.int64) if key not in given else shared.view(np.int64)[:0])
            wholes.append(s[order].tobytes() if len(shared) and key not in given else None)
            given.add(key)
        ends = np.cumsum([0, *map(len, prefixes)])
        flat = np.concatenate([np.empty(0, np.int64), *prefixes])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(map(text_hash, texts), pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                pa.array(wholes, pa.binary()),
            ],
            names=["doc_id", "text_hash", "n", "key", "prefix", "shingles"],
        )

    schema = (
        "doc_id long, text_hash long, n long, key binary, prefix array<long>, shingles binary"
    )
    return join_answers(packs, answers, schema, make)


class Trie:
    """Ordered sets as an implicit trie: sorted, with the depth at which each leaves the one before."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        names, flat = np.unique(flat, return_inverse=True)
        flat = flat.astype(np.int32)
        ends = np.cumsum([len(s) for s in sets])
        sets = np.split(flat, ends[:-1])
        #: order[i] is the given place of the i-th set of the trie.
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.depth = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.depth[i] = differ[0] if len(differ) else n
        self.mark = np.zeros(len(names), bool)
        prefixes = [s[: len(s) - needed(len(s)) + 1] for s in self.sets]
        tokens = np.concatenate(prefixes)
        owners = np.repeat(np.arange(len(sets)), [len(p) for p in prefixes])
        by_token = np.argsort(tokens, kind="stable")
        self.owners = owners[by_token]
        self.bounds = np.searchsorted(tokens[by_token], np.arange(len(names) + 1))
        self.prefixes = prefixes

    def sharing(self, x: int) -> np.ndarray:
        """Sets that share a prefix shingle with set x, in order of the trie."""
        lists = [self.owners[self.bounds[t] : self.bounds[t + 1]] for t in self.prefixes[x].tolist()]
        return np.unique(np.concatenate(lists))

    def similar_to(self, x: int, among: np.ndarray) -> Iterator[int]:
        """Those of the sets `among` (ascending) that are similar to set x."""
        own, mark = self.sets[x], self.mark
        n = len(own)
        mark[own] = True
        path = np.zeros(1, np.int64)  # path[d]: overlap of x with the first d shingles of the branch
        last = -1
        try:
            for y in among.tolist():
                m = int(self.sizes[y])
                least = (4 * (n + m) + 8) // 9
                shared = 0
                if last >= 0:
                    shared = int(self.depth[last + 1 : y + 1].min())
                    shared = min(shared, len(path) - 1)
                last, path = y, path[: shared + 1]
                # The subtree below the shared path: what remains cannot make up the overlap.
                if path[shared] + min(m - shared, n - path[shared]) < least:
                    continue
                while shared < m:
                    step = self.sets[y][shared : shared + 64]
                    grown = path[-1] + np.cumsum(mark[step])
                    path = np.concatenate([path, grown])
                    shared += len(step)
                    if path[-1] + min(m - shared, n - path[-1]) < least:
                        break
                if shared == m and similar(int(path[-1]), n, m):
                    yield y
        finally:
            mark[own] = False


def spanning_links(
    sets: list[np.ndarray], sides: list[int], linked: list[int] | None = None
) -> list[tuple[int, int]]:
    """Links that span the components of similar sets, as places in the list.

    With two sides, only sets of different sides are compared. Sets of equal `linked` are linked already.
    """
    if linked is not None and len(set(linked)) == 1:
        return []
    trie = Trie(sets)
    side = np.array([sides[i] for i in trie.order])
    two = len(set(sides)) > 1
    root = np.arange(len(sets))
    if linked is not None:
        root = np.unique([linked[i] for i in trie.order], return_inverse=True)[1]
    out = []
    for x in range(len(sets)):
        low, high = trie.sizes[x] * 4, trie.sizes[x] * 5
        open_ = (root != root[x]) & (trie.sizes * 5 >= low) & (trie.sizes * 4 <= high)
        open_[:x] = False
        if two:
            open_ &= side != side[x]
        if not open_.any():
            continue
        among = trie.sharing(x)
        among = among[open_[among]]
        for y in trie.similar_to(x, among):
            if root[y] != root[x]:
                out.append((trie.order[x], trie.order[y]))
                root[root == root[y]] = root[x]
    return out


def _postings(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, band, shingle) for the prefix shingles of all classes, and the least class of each."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))
    postings = classes.select("cls", band.alias("band"), F.explode("prefix").alias("shingle"))
    return postings, postings.groupBy("shingle", "band").agg(F.min("cls").alias("least"))


def candidate_links(classes: DataFrame) -> DataFrame:
    """Chains (a, b) of classes that share a prefix shingle and whose lengths may be similar."""
    postings, least = _postings(classes)
    within = postings.join(least, ["shingle", "band"]).where("cls <> least")
    above = least.select("shingle", (F.col("band") - 1).alias("band"), F.col("least").alias("next"))
    across = least.join(above, ["shingle", "band"])
    return within.select(F.col("cls").alias("a"), F.col("least").alias("b")).union(
        across.select(F.col("least").alias("a"), F.col("next").alias("b"))
    )


def first_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) of similar classes, one pair tried for each class.

    A class is tried against the least class with which it shares most of its prefix shingles. Copies of one text
    are mostly linked by this alone, with as many comparisons as there are copies.
    """
    postings, least = _postings(classes)
    shared = postings.join(least, ["shingle", "band"]).where("cls <> least")
    shared = shared.groupBy(F.col("cls").alias("a"), F.col("least").alias("b")).count()
    best = shared.groupBy("a").agg(F.max(F.struct("count", (-F.col("b")).alias("least"))).alias("best"))
    pairs = best.select("a", (-F.col("best.least")).alias("b"))
    for side in "ab":
        own = classes.select(F.col("cls").alias(side), F.col("shingles").alias(f"of_{side}"))
        pairs = pairs.join(own, side)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                overlap = len(np.intersect1d(one, two, assume_unique=True))
                good.append(similar(overlap, len(one), len(two)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(verify, "a long, b long")


def verified_links(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (a, b) of similar classes that span the components within candidate components.

    Components that need more than one block are linked by `first_links` before; those that are one
    component then are done, and in the others blocks know what is linked.
    """
    named = roots.select(F.col("node").alias("cls"), "root")
    sizes = named.join(classes.select("cls", "n"), "cls").groupBy("root").agg(
        F.count("*").alias("sets"), F.sum("n").alias("total")
    )
    sizes = sizes.select(
        "root",
        F.greatest(
            F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)
        ).alias("blocks"),
    )
    members = stored(named.join(sizes, "root"), "join-members")
    large = members.where("blocks > 1").select("cls")
    members, first = members.withColumn("star", F.col("cls")), None
    if not large.isEmpty():
        first = stored(first_links(classes.join(large, "cls", "left_semi")), "join-first")
        stars = components(first).select(F.col("node").alias("cls"), F.col("root").alias("centre"))
        members = members.join(stars, "cls", "left").withColumn("star", F.coalesce("centre", "star"))
    several = members.groupBy("root").agg((F.min("star") < F.max("star")).alias("several"))
    members = members.join(several.where("several").select("root"), "root").join(
        classes.select("cls", "shingles"), "cls"
    )
    members = members.withColumn("block", F.expr("pmod(xxhash64(cls), blocks)"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    members = members.select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "cls", "block", "star", "shingles",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def settle() -> pa.RecordBatch:
            sets = [np.frombuffer(r[3], np.uint64) for r in held]
            links = []
            if len(held) > 1:
                links = spanning_links(sets, [r[1] for r in held], [r[2] for r in held])
            ends = [[held[link[k]][0] for link in links] for k in (0, 1)]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(e, pa.int64()) for e in ends], names=["a", "b"]
            )

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for root, low, high, *row in zip(*columns):
                if group != (root, low, high):
                    if held:
                        yield settle()
                    group = (root, low, high)
                held.append(row)
        if held:
            yield settle()
        let_go()

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(parts, "root", "low", "high")
    dealt = dealt.sortWithinPartitions("root", "low", "high", "cls")
    links = dealt.mapInArrow(run, "a long, b long")
    return links if first is None else links.unionByName(first)


def _grouped(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per document: doc_id, text_hash, n, and its group: root, or the key of its set if alone."""
    sets = stored(ordered_sets(df, doc_id, text), "join-sets")
    classes = sets.where("shingles IS NOT NULL").dropDuplicates(["key"])
    classes = stored(
        classes.select(F.monotonically_increasing_id().alias("cls"), "key", "n", "prefix", "shingles"),
        "join-classes",
    )
    roots = components(candidate_links(classes))
    found = components(verified_links(classes, roots))
    named = found.join(classes.select(F.col("cls").alias("node"), "key"), "node")
    grouped = sets.select("doc_id", "text_hash", "n", "key").join(
        named.select("key", "root"), "key", "left"
    )
    return grouped.select(
        "doc_id", "text_hash", "n", "root",
        F.when(F.col("root").isNull(), F.col("key")).alias("alone"),
    )


def join_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles and component_id (smallest id reachable by links)."""
    docs = _grouped(df, doc_id, text)
    least = docs.where("n > 0").groupBy("root", "alone").agg(F.min("doc_id").alias("component"))
    least = least.select(F.col("root").alias("r"), F.col("alone").alias("k"), "component")
    linked = docs.where("n > 0 AND root IS NOT NULL").join(
        least.where("r IS NOT NULL").select(F.col("r").alias("root"), "component"), "root"
    )
    single = docs.where("n > 0 AND root IS NULL").join(
        least.where("r IS NULL").select(F.col("k").alias("alone"), "component"), "alone"
    )
    empty = docs.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = linked.select("doc_id", "n", "component").union(
        single.select("doc_id", "n", "component")
    ).union(empty)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id (null last), with all its columns.

    Documents without words are in no component and stay.
    """
    docs = _grouped(df, doc_id, text)
    null = F.col("doc_id").isNull()
    first = docs.where("n > 0").groupBy("root", "alone").agg(
        F.min(F.struct(null.alias("null"), "doc_id", "text_hash")).alias("first")
    ).select("first.doc_id", "first.text_hash", F.lit(True).alias("_once"))
    empty = docs.where("n = 0").select("doc_id", "text_hash", F.lit(False).alias("_once")).distinct()
    stays = first.union(empty).select(
        F.coalesce("doc_id", F.lit(0)).alias("_id"), null.alias("_null"),
        F.col("text_hash").alias("_hash"), "_once",
    )
    own = F.col(f"`{doc_id}`").cast("long")
    keyed = df.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)],
        F.coalesce(own, F.lit(0)).alias("_id"), own.isNull().alias("_null"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_hash"),
    )
    keys = ["_id", "_null", "_hash"]
    kept = keyed.join(stays, keys)
    # Equal rows are one component; the join has brought them together already.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    kept = kept.withColumn("_place", place).where("_place = 1 OR NOT _once")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)])
