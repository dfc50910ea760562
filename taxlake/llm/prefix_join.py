"""Near duplicates by a grouped prefix join on word-shingle sets (operator 5).

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold t. Under any
one order of all shingles, linked sets share a shingle among the first ``n - ceil(t * n) + 1`` of each.

1. Equal sets are collapsed to the smallest doc_id, copies cost nothing later on.
2. A first order puts shingles with a small hash first, and among these the rare before the frequent.
   Only shingles that could enter a prefix are counted, a small multiple of ``1 - t`` of all. Documents
   that meet no other one in this order have no link. The others are ordered again by the frequency
   of all their shingles among them, so that prefixes hold what few documents share.
3. Documents with the same prefix and the same size are one group. Groups meet on shared prefix
   shingles and are filtered by size; pairs are made for what remains.
4. Pairs come in two steps, so that a family of n near copies doesn't make n * n of them: first every
   member against the most central group of its bucket, then only pairs of groups that are not yet in
   one component. Each pair is verified on the whole shingle sets. No pair is capped or dropped. In
   both steps a pair has to agree early enough in its prefixes (a filter on positions).

Defined results: null, empty or blank texts have no shingle and link with nothing; a text of fewer
words than a shingle is one shingle; repeated rows come back as often as they came in, rows that
share a doc_id count as linked; rows with a null doc_id get their size and a null component; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxlake.llm.shared import _mix, components, long_lists, only, shingle_sets, stored

#: How much wider than the prefix the counted part of the order is.
COUNTED = 1.5
#: First tokens in the order, prefix or not, that rows carry for the filter on pairs and that a group has
#: in common besides its prefix. It bounds the rows, not the pairs.
TOP = 64


def _least_overlap(n, percent: int):
    """ceil(percent / 100 * n)."""
    return (n * percent + 99) // 100


def _sketch(k: int, percent: int):
    edge = np.uint64(min(0.999, COUNTED * (100 - percent) / 100) * 2.0**64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, heads, counted = [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n = len(s)
                inside = int(np.searchsorted(s, edge))
                prefix = n - _least_overlap(n, percent) + 1 if n else 0
                sizes.append(n)
                counted.append(inside)
                one.append(int(np.sum(_mix(s ^ np.uint64(0x5851F42D4C957F2D)))))
                two.append(int(np.sum(_mix(s + np.uint64(0x14057B7EF767814F)))))
                heads.append(s[: max(inside, prefix)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array(sizes, dtype=np.int64)),
                    pa.array(np.array(counted, dtype=np.int64)),
                    pa.array(np.array(one, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(two, dtype=np.uint64).view(np.int64)),
                    long_lists(heads),
                ],
                names=["doc_id", "n", "counted", "one", "two", "heads"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), long_lists(list(shingle_sets(batch.column(1), k)))], names=["doc_id", "items"]
            )

    return run


def _alike(a: Column, b: Column, percent: int) -> Column:
    return F.greatest(a, b) * percent <= F.least(a, b) * 100


def _prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, alone, tokens): the prefix of every set in ``nodes`` (doc_id, n, counted, heads).

    The first ``counted`` of ``heads`` are ordered by frequency, the others come after them as they are.
    ``alone`` shingles, of no other set, come first of all and are only counted; ``tokens`` are the rest.
    """
    tokens = nodes.select("doc_id", "counted", F.posexplode("heads").alias("at", "token")).select(
        "token", "doc_id", (F.col("at") >= F.col("counted")).alias("late")
    )
    frequent = tokens.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1")
    met = (
        tokens.join(frequent, "token")
        .groupBy("doc_id")
        .agg(
            F.sort_array(
                F.collect_set(F.struct("late", F.when(F.col("late"), 0).otherwise(F.col("docs")).alias("docs"), "token"))
            ).alias("met")
        )
        .join(nodes.select("doc_id", "n", "counted").distinct(), "doc_id")
    )
    prefix = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1
    early, late = F.filter("met", lambda m: ~m["late"]), F.filter("met", lambda m: m["late"])
    return (
        met.withColumn("alone", F.col("counted") - F.size(early))
        .withColumn("room", F.greatest(prefix - F.col("alone"), F.lit(0)).cast("int"))
        .withColumn("tokens", F.concat(F.slice(early["token"], F.lit(1), F.col("room")), late["token"]))
        .where(F.size("tokens") > 0)
        .withColumn("top", F.slice(F.concat(early["token"], late["token"]), 1, TOP))
        .select("doc_id", "n", "alone", "tokens", "top")
    )


def _bucket(prefixes: DataFrame, *names: str) -> DataFrame:
    """Every token of the prefixes, with its place ``at`` in the order of its set."""
    return prefixes.select(*names, "n", F.col("alone").alias("first"), F.posexplode("tokens").alias("at", "token")).select(
        *names, "n", (F.col("first") + F.col("at")).alias("at"), "token"
    )


def _early(before: Column, sizes: Column, percent: int) -> Column:
    """Whether so many shingles in front of the first common one leave room for the threshold.

    All of them belong to one set only, and linked sets have (1 - t) / (1 + t) of both sizes as such.
    """
    return before * (100 + percent) <= sizes * (100 - percent)


def _first_and_close(percent: int) -> Column:
    """Of a pair that meets on several tokens, take the first; and look how far its prefixes differ.

    Before the last common one of the ``TOP`` first tokens, what isn't common belongs to one set only.
    A pair without common tokens among these is taken on any token.
    """
    def close(common: Column) -> Column:
        last = F.get(common, F.size(common) - 1)
        before = (
            F.col("alone_l") + F.col("alone_r") + F.array_position("top_l", last) + F.array_position("top_r", last)
            - F.size(common) * 2
        )
        return (F.size(common) == 0) | (
            (F.get(common, F.lit(0)) == F.col("token")) & _early(before, F.col("n_l") + F.col("n_r"), percent)
        )

    return F.transform(F.array(F.array_intersect("top_l", "top_r")), close)[0]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(common * 100 >= (F.size("x") + F.size("y") - common) * percent)
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    ``k`` words a shingle, ``percent`` the least similarity. component_id is the smallest doc_id that
    links reach; links between documents already known to be in one component are not looked at.
    """
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sketch = stored(
        rows.mapInArrow(_sketch(k, percent), "doc_id long, n long, counted long, one long, two long, heads array<long>")
    )
    known = sketch.where("n > 0 and doc_id is not null")
    nodes = known.groupBy("one", "two", "n").agg(
        F.min("doc_id").alias("doc_id"), F.first("counted").alias("counted"), F.first("heads").alias("heads")
    )
    # first pass, on the counted part of the order: which documents can have a partner at all
    bucket = _bucket(_prefixes(nodes, percent), "doc_id")
    reach = bucket.groupBy("token").agg(F.min("at").alias("least"), F.count("*").alias("met")).where("met > 1")
    wanted = stored(
        bucket.join(reach, "token")
        .where((F.col("at") + F.col("least")) * percent <= F.col("n") * (100 - percent))
        .select("doc_id")
        .distinct()
    )
    sets = stored(rows.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, items array<long>"))
    # second pass, among these: all their shingles in the order of their frequency
    whole = sets.select("doc_id", F.size("items").cast("long").alias("n"), F.col("items").alias("heads"))
    members = stored(
        _prefixes(whole.withColumn("counted", F.col("n")), percent).withColumn(
            "grp",
            F.when(F.col("alone") == 0, F.concat_ws(":", F.col("n"), F.md5(F.array_join(F.array_union("top", "tokens"), ","))))
            .otherwise(F.col("doc_id").cast("string")),
        )
    )
    groups = members.groupBy("grp").agg(
        F.min("doc_id").alias("head"), F.first("n").alias("n"), F.min("alone").alias("alone"), F.first("tokens").alias("tokens")
    )
    # every group of a bucket meets the bucket's most central group: the one with the fewest lone shingles
    bucket = _bucket(groups, "grp", "head", "alone")
    centre = bucket.groupBy("token").agg(
        F.min(F.struct("alone", "head", F.col("n").alias("size"), F.col("at").alias("place"))).alias("c")
    )
    stars = (
        bucket.join(centre, "token")
        .where(_alike(F.col("n"), F.col("c.size"), percent))
        .where(_early(F.col("at") + F.col("c.place"), F.col("n") + F.col("c.size"), percent))
        .select(F.col("c.head").alias("a"), "grp")
    )
    inside = groups.select(F.col("head").alias("a"), "grp")
    pairs = (
        stars.union(inside).distinct()
        .join(members.select("grp", F.col("doc_id").alias("b")), "grp")
        .where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    links = stored(_verified(pairs, sets, percent))
    first = stored(components(links))
    # what is left: groups that share a prefix shingle and lie in different components so far
    placed = stored(
        members.join(first.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id"))
    )
    parts = placed.groupBy("grp", "component").agg(
        F.first("n").alias("n"), F.first("alone").alias("alone"), F.first("tokens").alias("tokens"), F.first("top").alias("top")
    )
    parts = _bucket(parts, "grp", "component", "alone", "top")
    left, right = (
        parts.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("grp", "component", "n", "at", "alone", "top")))
        for side in "lr"
    )
    open_pairs = (
        left.join(right, "token")
        .where(
            (F.col("component_l") < F.col("component_r"))
            & _alike(F.col("n_l"), F.col("n_r"), percent)
            & _early(F.col("at_l") + F.col("at_r"), F.col("n_l") + F.col("n_r"), percent)
            & _first_and_close(percent)
        )
        .select("grp_l", "component_l", "grp_r", "component_r")
        .distinct()
    )
    for side, name in (("l", "a"), ("r", "b")):
        member = placed.select(
            F.col("grp").alias(f"grp_{side}"), F.col("component").alias(f"component_{side}"), F.col("doc_id").alias(name)
        )
        open_pairs = open_pairs.join(member, [f"grp_{side}", f"component_{side}"])
    open_pairs = open_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(
        pairs, ["a", "b"], "left_anti"
    )
    # the first components stand for their links, so that only the new ones are left to follow
    late = stored(_verified(open_pairs.distinct(), sets, percent))
    joined = first if late.isEmpty() else components(
        first.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(late)
    )
    final = joined.select(F.col("id").alias("node"), "component")
    placed_nodes = nodes.select("one", "two", "n", F.col("doc_id").alias("node")).join(final, "node", "left")
    result = sketch.join(placed_nodes, ["one", "two", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "node", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return result.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def one_per_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, and every row that is near to no other.

    Each row is compared by its own text: rows without a doc_id, or with one that another row has too, get an id of
    their own for the comparison, above all others, so that the row with the smallest doc_id of a group stays.
    """
    clash = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    clash = stored(clash.select(F.col("doc_id").alias("clash_id"))).alias("clash")
    top = docs.agg(F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0)).alias("top_id")).first().top_id
    same = F.col("docs.doc_id").eqNullSafe(F.col("clash.clash_id"))
    plain = docs.alias("docs").join(clash, same, "left_anti").withColumn("row_id__", F.col("doc_id").cast("long"))
    odd = docs.alias("docs").join(clash, same, "left_semi")
    odd = stored(odd.withColumn("row_id__", F.monotonically_increasing_id() + F.lit(top + 1)))
    rows = plain.unionByName(odd)
    judged = near_duplicates(rows.select(F.col("row_id__").alias("doc_id"), "text"), k, percent)
    gone = judged.where("component_id <> doc_id").select(F.col("doc_id").alias("row_id__"))
    return rows.join(gone, "row_id__", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
