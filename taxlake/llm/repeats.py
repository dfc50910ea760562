"""Long repeats by a run-length suffix index (operator 4).

Every byte covered by a ``LENGTH``-byte string that also starts somewhere else is removed.

1. Windows of ``LENGTH`` bytes are anchored at their least ``GRAM``-byte gram; equal windows have equal
   anchors. Runs of windows with one anchor are segments, about three times the text in all, of which
   only (hash, place) travel. Segments whose anchor is found once in the corpus are unique and go.
2. What is left is cut from the texts and collapsed: a segment with copies repeats as a whole. Only
   anchors with several different segments need an index, so copies cost nothing there.
3. Segments of an anchor come together in one task, whole anchors to blocks of about ``BLOCK`` bytes.
   A block is indexed: suffix order, run-compressed Burrows-Wheeler transform, and for every run
   end the sampled place, its neighbour and their common length. From these samples alone the matching
   statistics of all places are streamed in text order, because between two samples the neighbour
   moves along with the place and the common length falls by one a step. A place repeats when the
   statistics towards its smaller or its larger neighbour reach ``LENGTH``.
4. An anchor with more than ``HOT`` different segments isn't gathered in a task: its windows are counted
   by a 128-bit hash in a grouped count instead, which is exact up to hash collisions.
5. Ranges go back to all copies and documents, are merged per document, and the rest is hashed.

Defined results: a null or empty text has 0 bytes and the digest of nothing; texts shorter than a window
keep all; rows that repeat a text, with the same doc_id or not, are copies of each other and lose what
copies lose; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxlake.llm.shared import _mix, _odd, only, text_buffers

LENGTH = 200
GRAM = 24
BLOCK = 1 << 19
HOT = 8_192
#: A run's place is its first start times ``WIDE`` plus its width; runs are narrower than that.
WIDE = 256
#: Bytes of a text that are looked at in one piece.
PIECE = 1 << 20
_BYTE = _odd(101, 256)
_BASE = 0x9E3779B97F4A7C15 | 1


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position on."""
    h, width = _BYTE[data], 1
    eight = None
    while width < 16:
        h = h[: len(h) - width] * _power(width) + h[width:]
        width *= 2
        if width == 8:
            eight = h
    h = h[: len(data) - GRAM + 1] * _power(8) + eight[16 : 16 + len(data) - GRAM + 1]
    return _mix(h)


def segments(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start) of runs of windows that share their anchor.

    A window of ``length`` bytes is anchored at the least of its grams, the leftmost of equal ones, so
    equal windows have equal anchors. Windows that follow each other and share the anchor are one run.
    """
    windows = len(data) - length + 1
    if windows <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    hashes = gram_hashes(data)
    least = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[:windows], least[span - width : span - width + windows])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:] - 1, windows - 1)
    return hashes[anchor[first]], first, last


# ---------------------------------------------------------------- the index of a block

_SYMBOLS, _BITS = 7, 9  # symbols in a packed word: bytes plus one, 0 ends a segment


class RunLengthIndex:
    """Run-compressed transform of some segments, with samples at both ends of every run."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        text = np.zeros(int(self.begins[-1]) + 1, dtype=np.int64)
        joined = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8).astype(np.int64) + 1
        joined[self.begins[1:] - 1] = 0
        text[:-1] = joined
        self.text, self.longest = text, int(sizes.max())
        packed = np.zeros(len(text), dtype=np.int64)
        for j in range(_SYMBOLS):
            packed[: len(text) - j] |= text[j:] << (_BITS * (_SYMBOLS - 1 - j))
        self.packed = packed
        order = self._order()
        # runs of the transform; a run also ends where the neighbour doesn't move along
        before = text[order - 1]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        lower = np.where(place > 0, order[place - 1], -1)
        upper = np.where(place < len(order) - 1, order[np.minimum(place + 1, len(order) - 1)], -1)
        ends = np.flatnonzero(np.append(before[1:] != before[:-1], True))
        self.run_symbols, self.run_lengths = before[ends], np.diff(np.concatenate([[-1], ends]))
        self.samples = [self._sample(lower), self._sample(upper)]

    def _order(self) -> np.ndarray:
        """Places by the text that follows, to the length of the longest segment, by doubling."""
        n = len(self.text)
        order = np.argsort(self.packed, kind="stable")
        key = self.packed[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        width = _SYMBOLS
        open_ = ~(new & np.append(new[1:], True))  # places of groups that aren't told apart yet
        slots = np.flatnonzero(open_)
        while len(slots) and width < self.longest:
            who = order[slots]
            after = np.where(who + width < n, rank[np.minimum(who + width, n - 1)], -1)
            by = rank[who] * (n + 1) + after + 1
            inner = np.argsort(by, kind="stable")
            who, by = who[inner], by[inner]
            order[slots] = who
            new = np.concatenate([[True], by[1:] != by[:-1]])
            rank[who] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            keep = ~(new & np.append(new[1:], True))
            slots = slots[keep]
            width *= 2
        return order

    def _sample(self, neighbour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, common length with the neighbour) of every run end, by place."""
        sampled = np.concatenate([[True], neighbour[1:] != neighbour[:-1] + 1])
        sampled[self.begins[:-1]] = True  # common lengths are only followed to the end of a segment
        at = np.flatnonzero(sampled)
        other = neighbour[at]
        common = np.zeros(len(at), dtype=np.int64)
        active = np.flatnonzero(other >= 0)
        last = len(self.text) - 1
        while len(active):
            a, b = at[active] + common[active], other[active] + common[active]
            diff = self.packed[np.minimum(a, last)] ^ self.packed[np.minimum(b, last)]
            same = diff == 0
            bits = np.frexp(np.maximum(diff, 1).astype(np.float64))[1]
            # frexp may round a long word up to the next power of two
            bits -= (bits > 1) & ((diff >> np.maximum(bits - 1, 0)) == 0)
            common[active] += np.where(same, _SYMBOLS, _SYMBOLS - 1 - (bits - 1) // _BITS)
            active = active[same & (common[active] <= self.longest) & (a < last) & (b < last)]
        return at, common

    def statistics(self) -> np.ndarray:
        """Length of the longest match of every place with another place, streamed from the samples."""
        places = np.arange(len(self.text))
        best = np.zeros(len(places), dtype=np.int64)
        for at, common in self.samples:
            last = np.searchsorted(at, places, side="right") - 1
            best = np.maximum(best, common[last] - (places - at[last]))
        return best

    def repeated(self, length: int) -> np.ndarray:
        """Whether a match of ``length`` inside its segment begins at each place."""
        rest = np.repeat(self.begins[1:] - 1, np.diff(self.begins)) - np.arange(self.begins[-1])
        return (self.statistics()[: len(rest)] >= length) & (rest >= length)


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


# ---------------------------------------------------------------- tasks


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column("text"))
            rows: list[tuple[np.ndarray, ...]] = []
            for i in range(len(uid)):
                a, b = int(offsets[i]), int(offsets[i + 1])
                for start in range(a, max(b - length + 1, a), PIECE):
                    h, first, last = segments(data[start : min(b, start + PIECE + length - 1)], length)
                    rows.append((h, np.full(len(h), uid[i]), first + (start - a), last + (start - a)))
            if rows:
                h, u, first, last = (np.concatenate(c) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(u), pa.array(first * WIDE + last - first)],
                    names=["anchor", "uid", "place"],
                )

    return run


def _cut(length: int, with_bytes: bool):
    """Segments of the texts: their content's hash or, with it, the content itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column("text"))
            lists = batch.column("places")
            of = np.repeat(np.arange(len(uid)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            place, anchor = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("place", "anchor"))
            first, last = place // WIDE, place // WIDE + place % WIDE
            step = 20_000
            for k in range(0, len(of), step):
                rows = range(k, min(k + step, len(of)))
                parts = [
                    data[int(offsets[of[j]]) + int(first[j]) : int(offsets[of[j]]) + int(last[j]) + length].tobytes()
                    for j in rows
                ]
                marks = np.array([xxhash.xxh3_64_intdigest(p) for p in parts], dtype=np.uint64).view(np.int64)
                columns = [pa.array(anchor[k : k + step]), pa.array(marks)]
                if with_bytes:
                    columns.append(pa.array(parts, pa.binary()))
                    names = ["anchor", "mark", "content"]
                else:
                    columns += [pa.array(uid[of[k : k + step]]), pa.array(place[k : k + step])]
                    names = ["anchor", "mark", "uid", "place"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_FOUND = "anchor long, mark long, ranges array<struct<low:long,high:long>>"
_RANGES = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def _indexed(length: int, block: int):
    """Ranges of repeated windows of every segment; rows come sorted by anchor, whole anchors a task."""

    def found(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        index = RunLengthIndex([r[2] for r in rows])
        flags = index.repeated(length)
        ranges = [
            [{"low": a, "high": b} for a, b in _ranges(flags[index.begins[i] : index.begins[i + 1] - 1])]
            for i in range(len(rows))
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(ranges, _RANGES)],
            names=["anchor", "mark", "ranges"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("anchor", "mark", "content"))):
                if size >= block and row[0] != rows[-1][0]:
                    yield found(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield found(rows)

    return run


def _windows(length: int):
    """A 128-bit hash of every window of a segment, for anchors too frequent to be gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, mark, content in zip(*(batch.column(n).to_pylist() for n in ("anchor", "mark", "content"))):
                n = len(content) - length + 1
                digests = [xxhash.xxh3_128_digest(content[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * n, pa.int64()), pa.array([mark] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(digests, pa.binary())],
                    names=["anchor", "mark", "at", "window"],
                )

    return run


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            lists, rows = batch.column("ranges").to_pylist(), []
            for i, ranges in enumerate(lists):
                text = data[offsets[i] : offsets[i + 1]]
                digest, at, spans = hashlib.sha256(), 0, []
                for r in sorted(ranges or (), key=lambda r: r["low"]):
                    low, high = r["low"], min(r["high"] + length, len(text))
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                for low, high in spans:
                    digest.update(text[at:low].tobytes())
                    at = high
                digest.update(text[at:].tobytes())
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"low": a, "high": b} for a, b in spans]))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), _RANGES]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


# ---------------------------------------------------------------- the operator


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of ``docs`` (doc_id, text).

    spans are the removed [low, high) byte ranges of the text.
    """
    if length - GRAM + 1 > WIDE:
        raise ValueError(f"length can be {WIDE + GRAM - 1} at most")
    # the texts are dealt by uid once; all joins below ask for the same columns, so the exchange is reused
    rows = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("uid")
    )
    anchors = rows.select("uid", "text").mapInArrow(_anchors(length), "anchor long, uid long, place long")
    repeated = anchors.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor")
    places = (
        anchors.join(repeated, "anchor").groupBy("uid").agg(F.collect_set(F.struct("place", "anchor")).alias("places"))
    )
    placed = rows.join(places, "uid").select("doc_id", "uid", "text", "places")
    cut = placed.mapInArrow(_cut(length, False), "anchor long, mark long, uid long, place long")
    contents = cut.groupBy("anchor", "mark").agg(
        F.count("*").alias("copies"), F.min(F.struct("uid", "place")).alias("one")
    )
    kinds = contents.groupBy("anchor").agg(F.count("*").alias("kinds"))
    contents = contents.join(kinds, "anchor")
    width = (F.col("one.place") % WIDE).alias("high")
    copied = contents.where("copies > 1").select(
        "anchor", "mark", F.array(F.struct(F.lit(0).cast("long").alias("low"), width)).alias("ranges")
    )
    several = (
        contents.where("kinds > 1")
        .groupBy(F.col("one.uid").alias("uid"))
        .agg(F.collect_set(F.struct(F.col("one.place").alias("place"), "anchor", "kinds")).alias("places"))
    )

    def taken(condition) -> DataFrame:
        some = several.select("uid", F.filter("places", condition).alias("places")).where(F.size("places") > 0)
        return (
            rows.join(some, "uid")
            .select("doc_id", "uid", "text", "places")
            .mapInArrow(_cut(length, True), "anchor long, mark long, content binary")
        )

    indexed = (
        taken(lambda p: p["kinds"] <= hot)
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_indexed(length, block), _FOUND)
        .where(F.size("ranges") > 0)
    )
    windows = taken(lambda p: p["kinds"] > hot).mapInArrow(_windows(length), "anchor long, mark long, at long, window binary")
    twice = windows.groupBy("window").agg(F.count("*").alias("times")).where("times > 1").select("window")
    counted = (
        windows.join(twice, "window")
        .groupBy("anchor", "mark")
        .agg(F.collect_set(F.struct(F.col("at").alias("low"), F.col("at").alias("high"))).alias("ranges"))
    )
    ranges = (
        cut.join(copied.unionByName(indexed).unionByName(counted), ["anchor", "mark"])
        .select("uid", F.expr(f"place div {WIDE}").alias("first"), F.explode("ranges").alias("r"))
        .select("uid", (F.col("first") + F.col("r.low")).alias("low"), (F.col("first") + F.col("r.high")).alias("high"))
        .groupBy("uid")
        .agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    )
    return (
        rows.join(ranges, "uid", "left")
        .select("doc_id", "uid", "text", "ranges")
        .mapInArrow(
            _kept(length),
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low:long,high:long>>",
        )
    )
