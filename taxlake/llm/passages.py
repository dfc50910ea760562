"""Quality classifier by attention over passages (operator 9): multiple-instance learning.

A document is a bag of passages of ``WORDS`` words. A passage is encoded by hashed counts of byte
trigrams (A-Z lowered, digits alike) and a few shares of characters, and a learned layer makes h of it.
Gated attention a = softmax(w . (tanh(V h) * sigmoid(U h))) weighs the passages of the bag, and the
document's score is the logistic of a linear form of the weighted sum of h. Only document labels are
used; the weights say which passage decided.

Training takes at most ``SAMPLE`` labelled documents, the first by a hash of their doc_id, in one task:
the bound is a parameter and the only place where rows are left aside. Scoring covers every row and
every passage; a text of any length is encoded piece by piece, and the softmax is carried along.

Defined results: a null or empty text is a bag of one empty passage; documents without a label or with a
null label aren't trained on; of several labels of a doc_id the largest counts; without labels at all
every score is 0.5; repeated rows get equal scores; an empty table gives an empty result; other columns
are ignored, and neither language, source nor id is an input.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxlake.llm.shared import _IS_WORD, only, text_buffers

WORDS = 64
BUCKETS = 256
HIDDEN, GATES = 24, 12
SAMPLE = 4_000
EPOCHS, BATCH, RATE = 40, 64, 0.01
CUT = 0.7
#: Bytes that are encoded in one piece; longer texts go piece by piece.
PIECE = 1 << 21

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] = _FOLD[97:123]
_FOLD[48:58] = 48
_CLASSES = np.zeros((256, 6), dtype=np.float32)
_CLASSES[list(b"#*$%&|<>{}[]=_~^@\\/"), 0] = 1
_CLASSES[48:58, 1] = 1
_CLASSES[65:91, 2] = 1
_CLASSES[10, 3] = 1
_CLASSES[list(b".,;:!?'\"()-"), 4] = 1
_CLASSES[list(b" \t"), 5] = 1
FEATURES = BUCKETS + _CLASSES.shape[1] + 2


def passages(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Features of passages that begin at ``begins`` (the first at 0), a row each."""
    n = len(begins)
    out = np.zeros((n, FEATURES), dtype=np.float32)
    if not len(data):
        return out
    sizes = np.diff(np.append(begins, len(data)))
    of = np.repeat(np.arange(n), sizes)
    folded = _FOLD[data]
    # trigrams end with their passage
    grams = folded.copy()
    grams[:-1] += folded[1:] * np.uint32(257) * (of[1:] == of[:-1])
    grams[:-2] += folded[2:] * np.uint32(66_049) * (of[2:] == of[:-2])
    bucket = ((grams * np.uint32(2_654_435_761)) >> np.uint32(24)).astype(np.int64)
    counts = np.bincount(of * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, :BUCKETS] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    for j in range(_CLASSES.shape[1]):
        out[:, BUCKETS + j] = np.bincount(of, _CLASSES[data, j], minlength=n) / np.maximum(sizes, 1)
    out[:, -2] = (counts > 0).mean(axis=1)
    out[:, -1] = np.log1p(sizes) / 8
    return out


def passage_begins(data: np.ndarray) -> np.ndarray:
    """Where the passages of one text begin: at 0 and at every ``WORDS``-th word after it."""
    word = _IS_WORD[data]
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    begins = starts[::WORDS].copy()
    if not len(begins):
        return np.zeros(1, dtype=np.int64)
    begins[0] = 0
    return begins


class AttentionModel:
    """The layers, their gradients and an Adam step, in numpy."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "W": rng.normal(0, 0.3, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATES)),
            "U": rng.normal(0, 0.3, (HIDDEN, GATES)), "w": rng.normal(0, 0.3, GATES), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
        }

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        h = np.tanh(x @ self.p["W"] + self.p["b"])
        t, s = np.tanh(h @ self.p["V"]), 1 / (1 + np.exp(-(h @ self.p["U"])))
        return h, t, s, (t * s) @ self.p["w"]

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss; ``at`` are the first rows of the bags in ``x``."""
        p, of = self.p, np.repeat(np.arange(len(at)), np.diff(np.append(at, len(x))))
        h, t, s, e = self.encoded(x)
        a = np.exp(e - np.maximum.reduceat(e, at)[of])
        a /= np.add.reduceat(a, at)[of]
        z = np.add.reduceat(a[:, None] * h, at)
        score = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        g = (score - y) / len(y)
        dz = g[:, None] * p["c"]
        dh = a[:, None] * dz[of]
        da = (h * dz[of]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, at)[of])
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh += dt @ p["V"].T + ds @ p["U"].T
        dpre = dh * (1 - h * h)
        return {
            "W": x.T @ dpre, "b": dpre.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": np.array([g.sum()]),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                batch = order[k : k + BATCH]
                x = np.concatenate([bags[i] for i in batch])
                at = np.concatenate([[0], np.cumsum([len(bags[i]) for i in batch])[:-1]])
                step += 1
                for name, g in self.gradients(x, at, labels[batch]).items():
                    g = g + 1e-4 * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)

    def score(self, data: np.ndarray) -> tuple[float, int, int, float]:
        """(score, passages, the passage with the most attention, its weight) of one text."""
        begins = passage_begins(data)
        most, total, z, best, best_e = -np.inf, 0.0, np.zeros(HIDDEN), 0, -np.inf
        k = 0
        while k < len(begins):
            # whole passages up to a piece, or one longer passage
            end = max(k + 1, int(np.searchsorted(begins, begins[k] + PIECE)))
            stop = int(begins[end]) if end < len(begins) else len(data)
            h, _, _, e = self.encoded(passages(data[begins[k] : stop], begins[k:end] - begins[k]))
            top = max(most, float(e.max()))
            keep, a = np.exp(most - top) if most > -np.inf else 0.0, np.exp(e - top)
            z, total, most = z * keep + a @ h, total * keep + float(a.sum()), top
            if e.max() > best_e:
                best, best_e = k + int(np.argmax(e)), float(e.max())
            k = end
        logit = float(z @ self.p["c"] / total + self.p["d"][0])
        return 1 / (1 + np.exp(-logit)), len(begins), best, float(np.exp(best_e - most) / total)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> AttentionModel:
        model = cls()
        with np.load(io.BytesIO(raw)) as stored:
            model.p = {k: stored[k] for k in stored.files}
        return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> bytes | None:
    """The model's parameters, some 60 kB, fitted in one task; None without a labelled document."""
    chosen = (
        only(labels, "doc_id", label)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = (
        only(docs, "doc_id", "text")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
        .join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
        .select("doc_id", "text", "y")
    )

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bags, ids, labels_ = [], [], []
        for frame in frames:
            for doc_id, text, y in zip(frame["doc_id"], frame["text"], frame["y"]):
                data = np.frombuffer((text or "").encode(), dtype=np.uint8)
                bags.append(passages(data, passage_begins(data)).astype(np.float32))
                ids.append(doc_id)
                labels_.append(y)
        if not bags:
            return
        order = np.argsort(np.array(ids), kind="stable")
        model = AttentionModel()
        model.fit([bags[i] for i in order], np.array(labels_, dtype=np.float64)[order])
        yield pd.DataFrame({"model": [model.dump()]})

    found = rows.repartition(1).mapInPandas(fit, "model binary").collect()
    return bytes(found[0]["model"]) if found else None


def scored(docs: DataFrame, model: bytes | None) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, top_passage, top_weight) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = AttentionModel.load(model) if model else None
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                rows.append(net.score(data[a:b]) if net else (0.5, len(passage_begins(data[a:b])), 0, None))
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "score", "n_passages", "top_passage", "top_weight"],
            )

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = rows.mapInArrow(run, "doc_id long, score double, n_passages long, top_passage long, top_weight double")
    return out.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        "n_passages",
        "top_passage",
        "top_weight",
    )
