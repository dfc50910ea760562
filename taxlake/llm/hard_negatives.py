"""Operator 13: hard negatives by a threshold join over integer vectors.

A pass scores a block of anchors against all rows. Every task turns its rows into blocks with an index in the
manner of L2AP: dimensions in ascending weight, and of each row only the dimensions behind the longest
prefix whose norm, times the largest anchor norm, stays below the least threshold of the pass. A query adds
up the indexed dimensions from the heaviest on, drops a row as soon as its partial score plus the product of
the norms that remain is below the anchor's threshold, and adds the prefix of the survivors.

A list (an anchor's positives, or one of its windows) starts with a high threshold, which a bounded pilot of
rows suggests. Lists that do not fill are asked again with a lower one, down to the least score that they
allow, so the result never depends on the pilot.

Rows without id, label or vector, or with a null or non-finite component, take no part. Vectors of different
length count as padded with zeros; scaled components beyond 2**25 in size count as 2**25. Rows that share an
id count once in a list, with the best score that the list allows; of anchors that share an id, the one with
the least label and vector counts. Other columns are left aside, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taxlake.llm.shared import only, stored

#: Anchors of a pass, sent to every task: at most about a megabyte of 64 dimensions.
ANCHORS = 4_096
#: Rows that suggest the first thresholds.
PILOT = 2_048
#: Rows of an index block, and dimensions between two looks at the bound.
BLOCK, CHUNK = 16_384, 16
#: Scaled components beyond this size are cut.
LARGEST = 1 << 25
#: Rows that a first threshold aims at, as a multiple of what a list needs, and the step from round to round.
AIM, WIDER = 4, 16

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scaled(rows: DataFrame, factor: int = 256) -> DataFrame:
    """(id, label, v): the rows of ``rows`` (vec_id, label, embedding) that take part, in whole numbers."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    whole = F.transform(
        x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * factor), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    )
    return (
        only(rows, "vec_id", "label", "embedding")
        .where("vec_id is not null and label is not null and embedding is not null")
        .where(finite)
        .select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("v"))
    )


# ---------------------------------------------------------------- numpy, inside a task


def matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """The lists of ``vectors`` as rows of a matrix; short ones padded with zeros, up to the longest or ``width``."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    longest = max(int(lengths.max(initial=0)), width or 0)
    out = np.zeros((len(lengths), longest), dtype=np.float64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def prefix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of the first 0, 1, ... dimensions of each row, rounded up a little."""
    squares = np.zeros((len(x), x.shape[1] + 1))
    np.cumsum(x * x, axis=1, out=squares[:, 1:])
    return np.sqrt(squares) * (1 + 1e-9)


class Index:
    """Rows indexed behind the prefix that alone can't reach ``least`` with an anchor of norm ``norm``."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, least: float, norm: float):
        norms = prefix_norms(x)
        cut = (norms * norm < least).sum(axis=1) - 1  # the longest prefix below the least threshold; -1 means none is
        cut = np.maximum(cut, 0)
        order = np.flatnonzero(cut < x.shape[1]) if least > 0 else np.arange(len(x))
        order = order[np.argsort(cut[order], kind="stable")]
        self.ids, self.labels, self.cut = ids[order], labels[order], cut[order]
        x, self.norms = x[order], norms[order]
        head = np.arange(x.shape[1])[None, :] < self.cut[:, None]
        self.prefix = np.where(head, x, 0)
        # one column a dimension; its postings are the first rows, as rows come in the order of their cuts
        self.postings = np.asfortranarray(np.where(head, 0, x))
        self.exact = x if len(x) and self.norms[:, -1].max() * norm >= 2**52 else None

    def search(self, q: np.ndarray, q_norms: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all rows whose score with ``q`` is ``least`` or more."""
        rows, score = np.arange(len(self.ids)), np.zeros(len(self.ids))
        for start in range((len(q) - 1) // CHUNK * CHUNK, -1, -CHUNK):
            if not len(rows):
                break
            part = slice(start, start + CHUNK)
            members = int(np.searchsorted(self.cut, min(start + CHUNK, len(q)), side="left"))
            inside = int(np.searchsorted(rows, members))  # rows behind it have no posting in these dimensions
            taken = slice(0, members) if inside == members else rows[:inside]
            score[:inside] += self.postings[taken, part] @ q[part]
            left = np.maximum(self.cut[rows], start)
            alive = score + self.norms[rows, left] * q_norms[left] + 1e-6 * (1 + abs(least)) >= least
            rows, score = rows[alive], score[alive]
        if self.exact is not None:
            score = self.exact[rows].astype(np.int64) @ q.astype(np.int64)
        else:
            score = np.rint(score + self.prefix[rows] @ q).astype(np.int64)
        good = score >= least
        return rows[good], score[good]


@dataclass
class Lists:
    """Open lists, in the order of their anchors: what to look for, and the anchors themselves."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    need: int
    same: bool
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    dims: np.ndarray


def best(scores: np.ndarray, ids: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``need`` different ids by score, then id."""
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    if len(ids) > 1:
        _, first = np.unique(ids, return_index=True)
        first.sort()
        scores, ids = scores[first], ids[first]
    return scores[:need], ids[:need]


def _search(asked: Lists):
    dims = asked.dims
    q = asked.vectors[:, dims]
    q_norms = prefix_norms(q)
    anchors, starts = np.unique(asked.anchor, return_index=True)
    ends = np.append(starts[1:], len(asked.anchor))

    def block(ids, labels, x, found, low) -> None:
        pool = Index(ids, labels, x, float(low.min()), float(q_norms[anchors, -1].max()))
        for a, start, end in zip(anchors, starts, ends):
            if asked.same and asked.labels[a] != labels[0]:
                continue
            rows, score = pool.search(q[a], q_norms[a], float(low[start:end].min()))
            other = pool.ids[rows] != asked.ids[a] if asked.same else pool.labels[rows] != asked.labels[a]
            rows, score = rows[other], score[other]
            for i in range(start, end):
                fits = (score >= low[i]) & (score <= asked.high[i])
                if not fits.any():
                    continue
                had = found.get(i, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                found[i] = best(
                    np.concatenate([had[0], score[fits]]), np.concatenate([had[1], pool.ids[rows[fits]]]), asked.need
                )
                if len(found[i][0]) == asked.need:
                    low[i] = max(low[i], found[i][0][-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        low = asked.low.copy()
        for ids, labels, x in _blocks(batches, len(dims)):
            x = x[:, dims]
            if not asked.same:
                block(ids, labels, x, found, low)
                continue
            for label in np.intersect1d(labels, asked.labels[anchors]):
                own = np.flatnonzero(labels == label)
                block(ids[own], labels[own], x[own], found, low)
        number = [np.full(len(s), i, dtype=np.int64) for i, (s, _) in found.items()]
        if number:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(number)),
                    pa.array(np.concatenate([i for _, i in found.values()])),
                    pa.array(np.concatenate([s for s, _ in found.values()])),
                ],
                names=["list", "id", "score"],
            )

    return run


def _blocks(batches: Iterator[pa.RecordBatch], width: int):
    """(ids, labels, vectors) of at most ``BLOCK`` rows. Dimensions that no anchor has don't count."""
    kept, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(start, BLOCK)
            if n + piece.num_rows > BLOCK and kept:
                yield _joined(kept, width)
                kept, n = [], 0
            kept.append(piece)
            n += piece.num_rows
    if n:
        yield _joined(kept, width)


def _joined(batches: list[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches)
    x = matrix(table["v"], width)[:, :width]
    return table["id"].to_numpy().astype(np.int64), table["label"].to_numpy().astype(np.int64), x


# ---------------------------------------------------------------- rounds


def _ranked(rows: DataFrame, asked: Lists) -> DataFrame:
    """(list, id, score, rank): the first rows of each list over all tasks."""
    found = rows.mapInArrow(_search(asked), "list long, id long, score long")
    once = found.groupBy("list", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= asked.need)


class _Guess:
    """Normal fits of the pilot's scores, per anchor: where a list must start to hold about so many rows."""

    def __init__(self, score: np.ndarray, use: np.ndarray, n_rows: int, n_pilot: int):
        count = np.maximum(use.sum(axis=1), 1)
        self.mean = np.where(use, score, 0).sum(axis=1) / count
        spread = np.where(use, score - self.mean[:, None], 0)
        self.deviation = np.sqrt((spread**2).sum(axis=1) / count) + 1e-9
        self.rows = np.maximum(count * n_rows / max(n_pilot, 1), 1)

    def start(self, a: int, high: float, rows: float) -> float:
        fit = NormalDist(self.mean[a], self.deviation[a])
        above = 1.0 if math.isinf(high) else fit.cdf(high)
        share = above - rows / self.rows[a]
        return fit.inv_cdf(share) if 0 < share < 1 else -math.inf


def _filled(rows: DataFrame, asked: Lists, floor: np.ndarray, guess: _Guess) -> DataFrame:
    """(list, id, score, rank) of all lists; thresholds fall until a list is full or at its ``floor``."""
    todo, aim, parts = np.arange(len(asked.anchor)), float(AIM * asked.need), []
    while len(todo):
        start = [guess.start(asked.anchor[i], asked.high[i], aim) for i in todo]
        low = np.maximum(np.floor(start), floor[todo])
        now = Lists(
            asked.anchor[todo], low, asked.high[todo], asked.need, asked.same, asked.ids, asked.labels, asked.vectors, asked.dims
        )
        got = stored(_ranked(rows, now))
        full = np.zeros(len(todo), dtype=np.int64)
        for r in got.groupBy("list").count().collect():  # one row a list of this block
            full[r[0]] = r[1]
        done = (full >= asked.need) | (low <= floor[todo])
        names = rows.sparkSession.createDataFrame(
            pa.table({"list": np.flatnonzero(done).astype(np.int64), "number": todo[done].astype(np.int64)})
        )
        parts.append(got.join(names, "list").select(F.col("number").alias("list"), "id", "score", "rank"))
        todo, aim = todo[~done], aim * WIDER
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def _block_result(rows, ids, labels, vectors, pilot, n_rows, positives, window, low, high) -> DataFrame | None:
    spark = rows.sparkSession
    pilot_ids, pilot_labels, pilot_x = pilot
    # light dimensions first: prefixes without postings get longer
    dims = np.argsort((np.abs(pilot_x[:, : vectors.shape[1]]).sum(axis=0) + 1) * (np.abs(vectors).sum(axis=0) + 1), kind="stable")
    score = vectors @ pilot_x[:, : vectors.shape[1]].T
    alike = labels[:, None] == pilot_labels[None, :]
    other = ids[:, None] != pilot_ids[None, :]

    n = len(ids)
    asked = Lists(
        np.arange(n), np.full(n, -math.inf), np.full(n, math.inf), positives, True, ids, labels, vectors, dims
    )
    near = _filled(rows, asked, np.full(n, -math.inf), _Guess(score, alike & other, n_rows, len(pilot_ids)))
    found = near.where("score >= 0").orderBy("list", "rank").toArrow()  # at most `positives` rows an anchor
    if not found.num_rows:
        return None
    anchor, positive = found["list"].to_numpy().astype(np.int64), found["score"].to_numpy().astype(np.int64)
    floor, top = -(-low * positive // 100), high * positive // 100
    possible = floor <= top
    anchor, positive, floor, top = anchor[possible], positive[possible], floor[possible], top[possible]
    if not len(anchor):
        return None
    asked = Lists(
        anchor, floor.astype(float), top.astype(float), window, False, ids, labels, vectors, dims
    )
    far = _filled(rows, asked, floor.astype(float), _Guess(score, ~alike, n_rows, len(pilot_ids)))
    lists = spark.createDataFrame(
        pa.table(
            {
                "list": np.arange(len(anchor), dtype=np.int64), "anchor_id": ids[anchor],
                "positive_id": found["id"].to_numpy().astype(np.int64)[possible], "positive_score": positive,
            }
        )
    )
    return far.join(lists, "list").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, window: int = 10, low: int = 30, high: int = 90,
    block: int = ANCHORS, pilot: int = PILOT,
) -> DataFrame:
    """Per anchor and positive, the first ``window`` rows of other labels within the window of scores.

    ``rows`` and ``anchors`` are (id, label, v) as from ``scaled``, anchors among the rows. The positives are
    the first rows of the anchor's label; a window is ``low`` to ``high`` percent of a positive's score.
    Anchors pass through the driver in blocks of about ``block``.
    """
    spark = rows.sparkSession
    rows = stored(rows)
    first = F.min_by(F.struct("label", "v"), F.struct("label", "v"))
    once = anchors.groupBy("id").agg(first.alias("of")).select("id", "of.label", "of.v")
    n_rows, n_anchors = rows.count(), once.count()
    empty = spark.createDataFrame([], RESULT)
    if not n_anchors:
        return empty
    once = stored(once.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(math.ceil(n_anchors / block)))))
    sample = rows.orderBy(F.xxhash64("id"), "id", "label", "v").limit(pilot).toArrow()
    width = rows.agg(F.max(F.size("v"))).first()[0]
    sampled = sample["id"].to_numpy().astype(np.int64), sample["label"].to_numpy().astype(np.int64), matrix(sample["v"], width)
    out = empty
    for part in range(math.ceil(n_anchors / block)):
        own = once.where(F.col("part") == part).orderBy("id").toArrow()
        if own.num_rows:
            found = _block_result(
                rows, own["id"].to_numpy().astype(np.int64), own["label"].to_numpy().astype(np.int64), matrix(own["v"], width),
                sampled, n_rows, positives, window, low, high,
            )
            out = out if found is None else out.union(found)
    return out


def mined(rows: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100; where it is divisible by 7 the label moves on by one."""
    whole = scaled(rows)
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = whole.withColumn("label", moved)
    return hard_negatives(whole, whole.where("id % 100 = 0"))
