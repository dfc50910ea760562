"""Operator 12: the best documents for each query by branch and bound over tries of restricted documents.

One scan of the corpus keeps, of every document, its number of terms and the terms that occur in a query, with
their counts. Each task sorts its documents by these terms, most frequent first, so that documents with the
same frequent terms share the paths of a trie (an FP-tree); small subtrees end in one leaf. A node knows, for
every term below it, the largest count, and the least length factor m. Both bound the score of any document
below, as a score rises with the counts and falls with m. Per query, the tree is walked depth first, best
bound first, and a subtree is left out when its bound is below the last of the best documents so far.

The vocabulary goes to every task: queries are taken in blocks of about ``PAIRS`` pairs of query and term, so
its size is bounded; each block scans the corpus once.

Null texts and texts without terms are not counted and never found. Rows are documents: repeated rows are
ranked one by one; null doc_ids come last among equal scores. Query rows that share an id are one query with
the terms of all; null query texts have none, a null item_id is a query of its own. Other columns are left
aside, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taxlake.llm.shared import _mix, _odd, only, slices, stored, text_buffers

#: Pairs of query and term of one block.
PAIRS = 1_000_000
#: Documents, or terms of documents, of one tree; documents of a leaf.
TREE_DOCS, TREE_TERMS, LEAF = 32_768, 4_000_000, 32
#: Ways that the rows of one query are dealt before its last ranking.
WAYS = 32

NO_TERM = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- terms

_IS_TERM = np.zeros(256, dtype=bool)
_IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def _byte_values(seed: int) -> np.ndarray:
    values = _odd(seed, 256)
    values[65:91] = values[97:123]  # A-Z as a-z
    values[~_IS_TERM] = 0
    return values


_BYTES = (_byte_values(41), _byte_values(43))


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two independent hashes of every term, number of terms before each text)."""
    inside = _IS_TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, offsets)
    if not len(starts):
        none = np.zeros(0, dtype=np.uint64)
        return none, none, before
    within = np.arange(len(data)) - np.concatenate([[0], starts])[np.cumsum(first)]
    longest = int(np.max(np.diff(np.append(starts, len(data)))))
    hashes = []
    for values, base in zip(_BYTES, _BASES):
        power = np.cumprod(np.full(longest + 1, base, dtype=np.uint64))
        hashes.append(_mix(np.add.reduceat(values[data] * power[np.minimum(within, longest)], starts)))
    return hashes[0], hashes[1], before


class Vocabulary:
    """Terms with a number each; found by one hash, verified by another."""

    def __init__(self, terms: list[str]):
        data, offsets = text_buffers(pa.array(terms, pa.large_string()))
        first, second, _ = term_hashes(data, offsets)
        self.order = np.argsort(first).astype(np.int32)
        self.first, self.second = first[self.order], second[self.order]

    def numbers(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each term, -1 where it has none."""
        if not len(self.first):
            return np.full(len(first), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        known = (self.first[at] == first) & (self.second[at] == second)
        return np.where(known, self.order[at], np.int32(-1))


def _restrict(vocabulary: Vocabulary, size: int):
    """(doc_id, n, terms, counts) of each text with terms; only terms of the vocabulary are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for start, end in slices(offsets):
                at = offsets[start : end + 1]
                first, second, before = term_hashes(data[at[0] : at[-1]], at - at[0])
                number = vocabulary.numbers(first, second).astype(np.int64)
                doc = np.repeat(np.arange(end - start), np.diff(before))
                pair, count = np.unique((doc * size + number)[number >= 0], return_counts=True)
                n = np.diff(before)
                has = np.flatnonzero(n)
                ends = np.searchsorted(pair // max(size, 1), np.arange(end - start), side="right")
                width = np.diff(np.concatenate([[0], ends]))[has]  # texts without terms have no pairs
                lists = pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start).take(pa.array(has)),
                        pa.array(n[has].astype(np.int64)),
                        pa.ListArray.from_arrays(lists, pa.array((pair % max(size, 1)).astype(np.int32))),
                        pa.ListArray.from_arrays(lists, pa.array(count.astype(np.int32))),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return run


# ---------------------------------------------------------------- trees


def parts_of_score(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds per unit of its weight."""
    return (1_000_000_000 * count) // (1000 * count + 20 * m)


class Tree:
    """The documents of a block in the order of a trie over their terms, most frequent first."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, rank: np.ndarray):
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.lexsort((rank[terms], doc))
        terms, counts = terms[order], counts[order]
        paths = rank[terms].astype(">u4").tobytes()
        self.paths = [paths[4 * (e - s) : 4 * e] for s, e in zip(sizes, ends)]
        by_path = sorted(range(len(ids)), key=self.paths.__getitem__)
        self.paths = [self.paths[i] for i in by_path]
        by_path = np.array(by_path, dtype=np.int64)
        self.ids, self.null, self.m = ids[by_path], null[by_path], m[by_path]
        sizes = sizes[by_path]
        begins = (ends[by_path] - sizes)
        take = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        self.terms, counts = terms[take].astype(np.int64), counts[take].astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.parts = parts_of_score(counts, np.repeat(self.m, sizes))
        self._nodes()
        self._bounds(counts)

    def _nodes(self) -> None:
        """Nodes as ranges of documents: (low, high, children). Children come behind their parent."""
        self.low, self.high, self.children = [0], [len(self.ids)], [[]]
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            # past the terms that all documents below share: their path has one node
            shared = _common(self.paths[low], self.paths[high - 1], depth)
            cuts = [low]
            at = low
            while at < high:  # one child a next term; documents that end here are one of them
                step = self.paths[at][4 * shared : 4 * shared + 4]
                at = _behind(self.paths, at, high, self.paths[at][: 4 * shared] + step, bool(step))
                cuts.append(at)
            if len(cuts) == 2:  # equal documents throughout: dealt by number
                cuts = [*range(low, high, LEAF), high]
            # small neighbours share a leaf
            groups, start = [], cuts[0]
            for before, cut in zip(cuts, cuts[1:]):
                if cut - start > LEAF and before > start:
                    groups.append((start, before))
                    start = before
            groups.append((start, cuts[-1]))
            if len(groups) == 1:
                middle = (low + high) // 2
                groups = [(low, middle), (middle, high)]
            for start, end in groups:
                child = len(self.low)
                self.low.append(start)
                self.high.append(end)
                self.children.append([])
                self.children[node].append(child)
                if end - start > LEAF:
                    todo.append((child, shared))

    def _bounds(self, counts: np.ndarray) -> None:
        """Per term, the nodes that hold it below them and its largest part of a score there."""
        nodes, low = len(self.low), np.array(self.low)
        term, node, most = [], [], []
        leaves = np.flatnonzero([not c for c in self.children])
        leaves = leaves[np.argsort(low[leaves])]
        self.least_m = np.full(nodes, np.iinfo(np.int64).max)
        self.least_m[leaves] = np.minimum.reduceat(self.m, low[leaves])
        # a leaf's terms with their largest counts, then upwards: parents come before their children
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        edges = np.concatenate([self.starts[low[leaves]], [len(self.terms)]])
        for i, leaf_node in enumerate(leaves):
            held[int(leaf_node)] = _largest(self.terms[edges[i] : edges[i + 1]], counts[edges[i] : edges[i + 1]])
        for parent in range(nodes - 1, -1, -1):
            if self.children[parent]:
                below = [held[c] for c in self.children[parent]]
                held[parent] = _largest(np.concatenate([t for t, _ in below]), np.concatenate([c for _, c in below]))
                self.least_m[parent] = min(self.least_m[c] for c in self.children[parent])
        for n, (t, c) in held.items():
            term.append(t)
            node.append(np.full(len(t), n, dtype=np.int64))
            most.append(c)
        term, node, most = np.concatenate(term), np.concatenate(node), np.concatenate(most)
        order = np.argsort(term, kind="stable")
        self.node_terms, self.term_nodes = term[order], node[order]
        self.term_parts = parts_of_score(most[order], self.least_m[self.term_nodes])

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: "Best") -> None:
        """Offer ``best`` every document that its threshold can't rule out. ``dense`` is a row of zeros over all terms."""
        bound = np.zeros(len(self.low), dtype=np.int64)
        begin, end = np.searchsorted(self.node_terms, terms), np.searchsorted(self.node_terms, terms, side="right")
        for b, e, w in zip(begin, end, weights):
            bound[self.term_nodes[b:e]] += w * self.term_parts[b:e]
        dense[terms] = weights
        stack = [0]
        while stack:
            node = stack.pop()
            if bound[node] < best.least:
                continue
            if self.children[node]:
                open_ = [c for c in self.children[node] if bound[c] >= best.least]
                stack.extend(sorted(open_, key=bound.__getitem__))
                continue
            low, high = self.low[node], self.high[node]
            start = self.starts[low]
            added = np.concatenate([[0], np.cumsum(dense[self.terms[start : self.starts[high]]] * self.parts[start : self.starts[high]])])
            score = added[self.starts[low + 1 : high + 1] - start] - added[self.starts[low:high] - start]
            good = np.flatnonzero(score >= best.least)
            if len(good):
                best.offer(score[good], self.ids[low + good], self.null[low + good])
        dense[terms] = 0


def _common(a: bytes, b: bytes, depth: int) -> int:
    """Number of leading terms that two paths share, from ``depth`` on."""
    most = min(len(a), len(b)) // 4
    while depth < most and a[4 * depth : 4 * depth + 4] == b[4 * depth : 4 * depth + 4]:
        depth += 1
    return depth


def _behind(paths: list[bytes], low: int, high: int, prefix: bytes, open_end: bool) -> int:
    """First place from ``low`` on whose path doesn't start with ``prefix``, or isn't equal to it."""
    while low < high:
        middle = (low + high) // 2
        if paths[middle][: len(prefix)] == prefix if open_end else paths[middle] == prefix:
            low = middle + 1
        else:
            high = middle
    return low


def _largest(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every term once, with its largest count."""
    if not len(terms):
        return terms, counts
    order = np.argsort(terms, kind="stable")
    terms, counts = terms[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    return terms[first], np.maximum.reduceat(counts, first)


class Best:
    """The best documents of one query so far; ``least`` is what a new one must reach."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.concatenate([self.score, score]), np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        if len(score) > self.k:
            first = np.lexsort((ids, null, -score))[: self.k]
            score, ids, null = score[first], ids[first], null[first]
        self.score, self.ids, self.null = score, ids, null
        if len(score) == self.k:
            self.least = max(self.least, int(score.min()))


def _search(items: list[np.ndarray], weights: np.ndarray, rank: np.ndarray, n_docs: int, n_terms: int, k: int):
    """(item, doc_id, score): the best documents of each query among those of a task."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
        kept, docs, terms = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                piece = batch.slice(start, 4096)
                size = len(piece.column(2).flatten())
                if kept and (docs + piece.num_rows > TREE_DOCS or terms + size > TREE_TERMS):
                    yield tree(kept)
                    kept, docs, terms = [], 0, 0
                kept.append(piece)
                docs, terms = docs + piece.num_rows, terms + size
        if kept:
            yield tree(kept)

    def tree(batches: list[pa.RecordBatch]) -> Tree:
        table = pa.Table.from_batches(batches).combine_chunks()
        column = {name: table[name].combine_chunks() if table[name].num_chunks != 1 else table[name].chunk(0) for name in table.column_names}
        n = column["n"].to_numpy().astype(np.int64)
        if 50 * int(n.max()) * n_docs < 2**63:
            m = 50 + (50 * n * n_docs) // n_terms
        else:
            m = np.array([50 + (50 * int(x) * n_docs) // n_terms for x in n], dtype=np.int64)
        null = column["doc_id"].is_null().to_numpy(zero_copy_only=False)
        ids = column["doc_id"].fill_null(0).to_numpy().astype(np.int64)
        return Tree(
            ids, null, m, column["terms"].value_lengths().to_numpy().astype(np.int64),
            column["terms"].flatten().to_numpy().astype(np.int64), column["counts"].flatten().to_numpy().astype(np.int64), rank,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        dense = np.zeros(len(rank), dtype=np.int64)
        for t in trees(batches):
            for terms, found in zip(items, best):
                t.search(terms, weights[terms], dense, found)
        for start in range(0, len(items), 256):
            some = best[start : start + 256]
            number = np.repeat(np.arange(start, start + len(some)), [len(b.score) for b in some])
            ids = pa.array(np.concatenate([b.ids for b in some]), mask=np.concatenate([b.null for b in some]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int64()), ids, pa.array(np.concatenate([b.score for b in some]))], names=["item", "doc_id", "score"]
            )

    return run


# ---------------------------------------------------------------- jobs


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Results of the queries of ``pairs`` (item_id, term)."""
    spark = docs.sparkSession
    table = pairs.orderBy(F.asc_nulls_last("item_id"), "term").toArrow()  # bounded by the size of a block
    words = table["term"].unique().to_pylist()
    number = {w: i for i, w in enumerate(words)}
    term = np.array([number[w] for w in table["term"].to_pylist()], dtype=np.int64)
    item_ids = table["item_id"].to_pylist()
    cuts = [0, *(i for i in range(1, len(item_ids)) if item_ids[i] != item_ids[i - 1]), len(item_ids)]
    items = [np.sort(term[a:b]) for a, b in zip(cuts, cuts[1:])]

    restricted = stored(docs.mapInArrow(
        _restrict(Vocabulary(words), len(words)), "doc_id long, n long, terms array<int>, counts array<int>"
    ))
    n_docs, n_terms = restricted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    names = spark.createDataFrame(
        pa.table({"item": pa.array(range(len(items)), pa.int64()), "item_id": pa.array([item_ids[a] for a in cuts[:-1]], pa.int64())})
    )
    if not n_docs:
        return names.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    df = np.zeros(len(words), dtype=np.int64)
    counted = restricted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # one row a term of the block
    df[counted["term"].to_numpy()] = counted["count"].to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(words))
    found = restricted.mapInArrow(_search(items, weights, rank, n_docs, n_terms, k), "item long, doc_id long, score long")
    near = _first(found.withColumn("way", F.pmod(F.xxhash64("doc_id"), F.lit(WAYS))), k, "item", "way")
    return _first(near.drop("rank", "way"), k, "item").join(names, "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms = F.split(F.translate("text", UPPER, LOWER), NO_TERM)
    wanted = (
        only(items, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms).alias("term"))
        .where("term <> ''").distinct()
    )
    wanted = stored(wanted)
    size = wanted.count()
    blocks = math.ceil(size / pairs)
    out = None
    for block in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else wanted
        if blocks > 1 and own.isEmpty():
            continue
        found = _block(texts, own, k)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
