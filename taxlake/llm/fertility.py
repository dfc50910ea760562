"""Quality rules with tokeniser fertility (operator 7).

Base rules count words, symbols, repeated lines and repeated word windows. On top of them two public
vocabularies measure every text: characters per token under a byte-level BPE, the share of words' tokens
that fall back to single bytes under a piece BPE, and the entropy of its tokens against the most that
many tokens can have. A text is rejected when a measure lies outside the band of its language and script.

Bands come from all different texts that pass the base rules, so copies of a text count once: median plus
or minus ``width`` times the quartile range (at least ``FLOORS``) of each group of language, script and
length class. Quartiles are exact on values rounded to ``DIGITS`` digits, so they don't depend on the order of rows and tasks hold
a count per rounded value, however many rows there are; the length class is there because the entropy of running text falls with its length.
A group of fewer than ``LEAST_GROUP`` such texts uses the nearest length class of its language and script that has
as many, else all lengths of its language and script, else the nearest length class of all languages, else
all texts that pass: every passing row is judged. Entropies of other lengths are moved along the slope at which the
groups' medians change from class to class.

Tokens are those of the text's words: a word is tokenised once per slice of texts, however often it is
used, with the blank that precedes a word in running text. White space itself has no tokens.

Defined results: a null or empty text has no words, fails the base rules and has null measures; a null
language is a group of its own; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxlake.llm.shared import only, slices, stored, text_buffers

TOKENIZERS = "/opt/tokenizers"
WIDTH = 3.0
LEAST_GROUP = 20
#: The least quartile range that a band is built from.
FLOORS = {"chars_per_token": 0.02, "fallback_share": 0.01, "token_entropy": 0.005}
#: Digits of the measures in the quartiles: a tenth of the least floor or finer.
DIGITS = 4
#: Split pattern of the byte-level vocabulary (a fixed value, given with the file).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Script of a lead byte of UTF-8, coarse: enough to tell vocabularies' bands apart.
_SCRIPT = np.zeros(256, dtype=np.int64)
_SCRIPT[65:91] = _SCRIPT[97:123] = 1
_SCRIPT[0xC3:0xCA] = 1
_SCRIPT[0xCE:0xD0] = 2
_SCRIPT[0xD0:0xD4] = 3
_SCRIPT[0xD7:0xD8] = 4
_SCRIPT[0xD8:0xDC] = 5
_SCRIPT[0xE0:0xE2] = 6
_SCRIPT[0xE3:0xEE] = 7
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "cjk")

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
    "n_tokens long, chars_per_token double, fallback_share double, token_entropy double"
)


def _repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-2] * distinct + ids[1:-1]
    if distinct >= 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, counts = np.unique(pair * distinct + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for j in range(3):
        covered[j : len(ids) - 2 + j] |= twice
    return int(covered.sum())


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


class _Vocabularies:
    """The two vocabularies of a task, from the bytes of their files."""

    def __init__(self, piece: bytes, ranks: bytes):
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_proto=piece)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bytes = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.vocab_size())])

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece ids of all words in a row, where each word's begin, byte-level tokens of each word)."""
        pieces = self.piece.encode(words, num_threads=1)
        begins = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in pieces], out=begins[1:])
        flat = np.fromiter((i for x in pieces for i in x), dtype=np.int64, count=int(begins[-1]))
        return flat, begins, np.array([len(self.bytes.encode_ordinary(" " + w)) for w in words], dtype=np.int64)


def _measure(piece: bytes, ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _Vocabularies(piece, ranks)
        for batch in batches:
            rows: list[tuple] = []
            data, offsets = text_buffers(batch.column("text"))
            for start, end in slices(offsets):
                rows += _slice(tools, data, offsets[start : end + 1])
            columns = list(zip(*rows)) if rows else [()] * 10
            kinds = [pa.int64()] * 5 + [pa.string(), pa.int64()] + [pa.float64()] * 3
            names = [f.split()[0] for f in MEASURES.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), batch.column("text_hash"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "lang", "text_hash", *names],
            )

    return run


def _slice(tools: _Vocabularies, data: np.ndarray, at: np.ndarray) -> list[tuple]:
    part, at = data[at[0] : at[-1]], at - at[0]
    whole = part.tobytes()
    texts = [whole[a:b] for a, b in zip(at[:-1], at[1:])]
    ids: dict[bytes, int] = {}
    word_ids = [np.array([ids.setdefault(w, len(ids)) for w in t.split()], dtype=np.int64) for t in texts]
    if not ids:
        return [(0, 0, int(_SYMBOL[part[a:b]].sum()), 0, 0, SCRIPTS[0], 0, None, None, None) for a, b in zip(at[:-1], at[1:])]
    words = [w.decode() for w in ids]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    flat, begins, byte_tokens = tools.words(words)
    sizes = np.diff(begins)
    fallback = np.add.reduceat(np.append(tools.is_byte[flat], False).astype(np.int64), begins[:-1])
    fallback[sizes == 0] = 0
    out = []
    for text, own, a, b in zip(texts, word_ids, at[:-1], at[1:]):
        chars, n_tokens = int(lengths[own].sum()), int(sizes[own].sum())
        symbols = int(_SYMBOL[part[a:b]].sum())
        if not len(own):
            out.append((0, 0, symbols, 0, 0, SCRIPTS[0], 0, None, None, None))
            continue
        script = np.bincount(_SCRIPT[part[a:b]], minlength=len(SCRIPTS))
        script = SCRIPTS[int(np.argmax(script[1:])) + 1] if script[1:].any() else SCRIPTS[0]
        # tokens of the text: for every word, the run of its pieces
        width = sizes[own]
        ends = np.cumsum(width)
        tokens = flat[np.repeat(begins[own] - ends + width, width) + np.arange(n_tokens)]
        counts = np.unique(tokens, return_counts=True)[1] / max(n_tokens, 1)
        entropy = float(-(counts * np.log2(counts)).sum() / np.log2(n_tokens)) if n_tokens > 1 else 0.0
        out.append(
            (
                len(own), chars, symbols, _dup_lines(text), _repeat_words(own, len(ids)), script, n_tokens,
                chars / int(byte_tokens[own].sum()), int(fallback[own].sum()) / max(n_tokens, 1), entropy,
            )
        )
    return out


def measures(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, lang, text_hash, counts and measures) per row of ``docs`` (doc_id, text, lang), plus base_failed.

    The two vocabulary files are read once, by the driver, and sent along: half a megabyte each.
    """
    piece = (Path(tokenizers) / "piece_bpe_32k.model").read_bytes()
    ranks = (Path(tokenizers) / "byte_bpe_50k.tiktoken").read_bytes()
    rows = only(docs, "doc_id", "text", "lang").withColumns({"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64("text")})
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.mapInArrow(_measure(piece, ranks), f"doc_id long, lang string, text_hash long, {MEASURES}").withColumn(
        "base_failed", failed
    )


def _band(name: str, value: Column, width: float, low: bool, high: bool) -> Column:
    quartiles = F.col(f"band.{name}")
    reach = F.greatest(quartiles[2] - quartiles[0], F.lit(FLOORS[name])) * width
    inside = F.lit(True)
    if low:
        inside = inside & (value >= quartiles[1] - reach)
    if high:
        inside = inside & (value <= quartiles[1] + reach)
    return inside


def _quartiles(texts: DataFrame, *by: str) -> DataFrame:
    """(by, members, band): quartiles of all measures over the different texts of each group."""
    quartiles = (F.percentile(name, [0.25, 0.5, 0.75]).alias(name) for name in FLOORS)
    return texts.select(*by, "text_hash", *FLOORS).distinct().groupBy(*by).agg(
        F.count("*").alias("members"), F.struct(*quartiles).alias("band")
    )


def _slope(texts: DataFrame) -> DataFrame:
    """(slope): how the median entropy of a language and script moves from a length class to the next.

    Least squares over the classes with enough members within the groups, in whole numbers, so that it doesn't depend on the order of rows. One row.
    """
    medians = _quartiles(texts, "lang", "script", "class").select(
        "lang", "script", F.col("class").alias("x"), F.round(F.col("band.token_entropy")[1] * 10**DIGITS).cast("long").alias("y"),
        (F.col("members") >= LEAST_GROUP).alias("full"),
    )

    def squares(which: Column, a: str, b: str) -> Column:
        def total(c: Column) -> Column:
            return F.sum(F.when(which, c))

        return total(F.lit(1)) * total(F.col(a) * F.col(b)) - total(F.col(a)) * total(F.col(b))

    sums = medians.groupBy("lang", "script").agg(*(
        squares(which, "x", b).alias(f"{name}_x{b}")
        for name, which in (("full", F.col("full")), ("any", F.lit(True))) for b in "xy"
    ))
    # without two full classes of one group, all of them
    full, some = (F.try_divide(F.sum(f"{name}_xy"), F.sum(f"{name}_xx")) for name in ("full", "any"))
    return sums.agg(F.round(F.coalesce(full, some, F.lit(0.0)) / 10**DIGITS, DIGITS).alias("slope"))


def _nearest(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """``rows`` (class, members, band) plus ``name``: the band of the nearest class with enough members, the lower of two."""
    order = Window.partitionBy(*by).orderBy("class")
    full = F.when(F.col("members") >= LEAST_GROUP, F.struct("class", "band"))
    below = F.last(full, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(full, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    closer = F.col("__above.class") - F.col("class") < F.col("class") - F.col("__below.class")
    nearer = F.col("__below").isNull() | F.coalesce(closer, F.lit(False))
    return (
        rows.withColumns({"__below": below, "__above": above})
        .withColumn(name, F.when(nearer, F.col("__above.band")).otherwise(F.col("__below.band")))
        .drop("__below", "__above")
    )


def judged(measured: DataFrame, width: float = WIDTH) -> DataFrame:
    """``measured`` with ``kept``: base rules passed and every measure inside the band of its group."""
    classed = measured.withColumn("class", F.floor(F.log2(F.greatest("n_words", F.lit(1))) * 2))
    rounded = [F.round(name, DIGITS).alias(name) for name in FLOORS]
    texts = stored(classed.where("not base_failed").select("lang", "script", "class", "text_hash", *rounded).distinct())
    slope = stored(_slope(texts))
    # entropies as they would be at class 0
    level = F.col("token_entropy") - F.col("slope") * F.col("class")
    texts = texts.join(F.broadcast(slope)).withColumn("token_entropy", F.round(level, DIGITS)).drop("slope")

    own = _nearest(_quartiles(texts, "lang", "script", "class"), "near", "lang", "script").drop("members", "band")
    whole = _quartiles(texts, "lang", "script").where(F.col("members") >= LEAST_GROUP).select(
        F.col("lang").alias("__lang"), F.col("script").alias("__script"), F.col("band").alias("whole")
    )
    wide = _nearest(_quartiles(texts, "class"), "wide").select("class", "wide")  # at most 128 length classes
    every = _quartiles(texts).select(F.col("band").alias("every"))
    bands = (
        own.join(whole, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("script") == F.col("__script")), "left")
        .join(F.broadcast(wide), "class")
        .join(F.broadcast(every))
        .join(F.broadcast(slope))
        .select("lang", "script", "class", "slope", F.coalesce("near", "whole", "wide", "every").alias("band"))
    )
    joined = classed.alias("m").join(
        bands.alias("g"),
        F.col("m.lang").eqNullSafe(F.col("g.lang"))
        & (F.col("m.script") == F.col("g.script"))
        & (F.col("m.class") == F.col("g.class")),
        "left",
    ).select("m.*", "g.slope", "g.band")
    ok = F.lit(True)
    for name, (low, high) in {
        "chars_per_token": (True, True), "fallback_share": (False, True), "token_entropy": (True, False),
    }.items():
        ok = ok & _band(name, level if name == "token_entropy" else F.col(name), width, low, high)
    return joined.withColumn("kept", ~F.col("base_failed") & ok).select(*measured.columns, "kept")


def fertility_rules(docs: DataFrame, tokenizers: str = TOKENIZERS, width: float = WIDTH) -> DataFrame:
    """Counts, measures, base_failed and kept for every row of ``docs``.

    The measures are stored once: the bands need all of them before the first verdict.
    """
    return judged(stored(measures(docs, tokenizers)), width).drop("text_hash")


def passing_rows(docs: DataFrame, tokenizers: str = TOKENIZERS, width: float = WIDTH) -> DataFrame:
    """The rows of ``docs`` that the rules keep; each row is judged by its own text and language."""
    rejected = judged(stored(measures(docs, tokenizers)), width).where("not kept")
    gone = rejected.select(*(F.col(c).alias(f"gone_{c}") for c in ("doc_id", "text_hash", "lang"))).distinct().alias("gone")
    same = (
        F.col("docs.doc_id").cast("long").eqNullSafe(F.col("gone.gone_doc_id"))
        & (F.xxhash64(F.col("docs.text")) == F.col("gone.gone_text_hash"))
        & F.col("docs.lang").eqNullSafe(F.col("gone.gone_lang"))
    )
    return docs.alias("docs").join(gone, same, "left_anti")
