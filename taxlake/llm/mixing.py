"""Mixing sources to target weights by Pfair scheduling (operator 6), in DataFrame functions only.

Every source has a whole-number weight, its share of the mix is that weight over the sum of all. Its rows, in a
fixed order and over and over, fill blocks of ``block_rows`` rows without a gap, so every block is full. Block
i (from 1) of a source of share w has the release time floor((i - 1) / w) and the deadline ceil(i / w), in
slots of one block. At every slot the released block with the earliest deadline is taken: after any number
t of slots a source has had more than w * t - 1 and less than w * t + 1 blocks, for the target weights
themselves and however long the mix is.

The schedule is made in stretches of ``STRETCH`` slots, each by itself. At the start S of a stretch a source has
had floor(w * S) blocks or one more, by largest remainders, which adds up to S; both ends of a stretch are
known by arithmetic, and unit blocks with such windows always fit between them. So no step walks through the
corpus in order. Only the sources that have a block in a stretch are looked at there, at most ``STRETCH``.

The mix lasts until every source has been used in full: sources that are small for their weight come
round again (``epoch`` counts from 0), and no row of any source is left out. With ``max_epochs`` it ends before
a source would begin its next round, even if others are not through. Without given weights a source's
weight is its number of rows to the power ``TEMPERATURE``.

A source of any size is numbered without bringing it to one task: rows fall into buckets of about
``BUCKET`` rows by a hash, buckets are numbered within, and the buckets' sizes are summed up.

Defined results: a null source is a source of its own; sources without a given weight share the least
given one; weights are taken to nine digits of the largest, at least one of these units each; rows that are
equal in doc_id and text are ordered arbitrarily among themselves but each is kept; the last blocks may hold
rows of a further epoch; an empty table gives an empty result; the columns of the input are passed on,
whatever their names, and a clash with the added columns (slot, place, epoch) is an error at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxlake.llm.shared import stored

STRETCH = 1_024
TEMPERATURE = 0.7
BLOCK_ROWS = 64
BUCKET = 10_000
#: Weights are whole numbers, up to this one.
UNITS = 1_000_000_000
ADDED = ("slot", "place", "epoch")
#: Rounds of a source that one array lists.
ROUNDS = 1_000

_WIDE = "decimal(38,0)"


def _name(source: Column) -> Column:
    """A source as text that no null can equal."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(name, rows, weight, total): whole-number weights of the sources in ``sizes`` (source, rows)."""
    if weights:
        given = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
        weight = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(float(min(weights.values()))))
    else:
        weight = F.pow("rows", F.lit(TEMPERATURE))
    rows = sizes.select(_name(F.col("source")).alias("name"), "rows", weight.cast("double").alias("raw"))
    most = rows.agg(F.max("raw").alias("most"))  # one row
    whole = rows.join(F.broadcast(most)).withColumn("weight", F.greatest(F.round(F.col("raw") / F.col("most") * UNITS), F.lit(1)).cast("long"))
    return whole.join(F.broadcast(whole.agg(F.sum("weight").alias("total")))).select("name", "rows", "weight", "total")


def _over(blocks: Column, up: bool) -> Column:
    """``blocks`` over the share, in whole slots."""
    product, weight = blocks.cast("decimal(19,0)") * F.col("total").cast("decimal(19,0)"), F.col("weight").cast("decimal(19,0)")
    product = product + weight - F.lit(1).cast("decimal(1,0)") if up else product
    return F.call_function("div", product, weight)


def length_of(plan: DataFrame, block_rows: int, max_epochs: int | None) -> DataFrame:
    """(length): slots of the mix, one row."""
    blocks = F.ceil(F.col("rows") / block_rows)
    length = F.max(_over(blocks, up=True))
    if max_epochs:
        most = F.floor(F.col("rows") * F.lit(max_epochs) / block_rows)
        length = F.least(length, F.min(_over(most, up=False)))
    return plan.agg(length.alias("length"))


def stretches(plan: DataFrame, length: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(at, slots, name, weight, total, had, upto): blocks that each source has had at both ends of a stretch."""
    ends = length.where("length > 0").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / stretch).cast("long"))).alias("number"), "length"
    ).select("number", F.least(F.col("number") * stretch, F.col("length")).alias("at"))
    product = F.col("at").cast(_WIDE) * F.col("weight").cast("decimal(19,0)")
    part = Window.partitionBy("number")
    by_rest = part.orderBy(F.desc("rest"), "name")
    counted = (
        ends.join(F.broadcast(plan.select("name", "weight", "total")))  # every source at every end
        .withColumn("product", product)
        .withColumn("whole", F.expr("product div total"))
        .withColumn("rest", F.expr("product % total"))
        .withColumn("missing", F.col("at") - F.sum("whole").over(part))
        .withColumn("had", F.col("whole") + F.when(F.row_number().over(by_rest) <= F.col("missing"), 1).otherwise(0))
    )
    following = Window.partitionBy("name").orderBy("number")
    return (
        counted.withColumns({"upto": F.lead("had").over(following), "until": F.lead("at").over(following)})
        .where("upto > had")
        .select("at", (F.col("until") - F.col("at")).alias("slots"), "name", "weight", "total", "had", "upto")
    )


def schedule(ends: DataFrame) -> DataFrame:
    """(slot, name, block): earliest deadline first over the released blocks of each stretch; block counts from 0.

    Times are relative to the start of the stretch: block had + j of a source is released at
    floor((lag + j * total) / weight), where lag = had * total - at * weight lies between -total and total.
    """
    lag = F.col("had").cast(_WIDE) * F.col("total") - F.col("at").cast(_WIDE) * F.col("weight")
    source = F.struct("name", "weight", "total", lag.cast("long").alias("lag"), "had", (F.col("upto") - F.col("had")).alias("blocks"))
    gathered = ends.groupBy("at", "slots").agg(F.array_sort(F.collect_list(source)).alias("all"))  # at most a slot's block each
    start = F.struct(
        F.transform("all", lambda s: F.lit(0).cast("long")).alias("done"), F.array().cast("array<struct<index:int,turn:bigint>>").alias("slots")
    )

    def step(state: Column, t: Column) -> Column:
        def ready(s: Column, i: Column) -> Column:
            turn = F.get(state["done"], i)
            reached = s["lag"] + turn * s["total"]
            deadline = F.call_function("div", reached + s["total"] + s["weight"] - 1, s["weight"])  # rounded up
            return F.when(
                (turn < s["blocks"]) & (reached < (t + 1) * s["weight"]),
                F.struct(F.least(deadline, F.col("slots")).alias("deadline"), i.alias("index"), turn.alias("turn")),
            )

        chosen = F.array_min(F.array_compact(F.transform(F.col("all"), ready)))
        return F.transform(
            F.array(chosen),
            lambda c: F.struct(
                F.transform(state["done"], lambda d, i: d + F.when(i == c["index"], 1).otherwise(0)).alias("done"),
                F.concat(state["slots"], F.array(F.struct(c["index"].alias("index"), c["turn"].alias("turn")))).alias("slots"),
            ),
        )[0]

    taken = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), start, step, lambda s: s["slots"])
    return gathered.select("at", "all", F.posexplode(taken).alias("offset", "c")).select(
        (F.col("at") + F.col("offset")).alias("slot"),
        F.col("all")[F.col("c.index")]["name"].alias("name"),
        (F.col("all")[F.col("c.index")]["had"] + F.col("c.turn")).alias("block"),
    )


def mixed(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    stretch: int = STRETCH,
    source: str = "source",
    key: str = "doc_id",
    max_epochs: int | None = None,
) -> DataFrame:
    """``docs`` in mixing order: its columns with slot, place (row within the slot's block) and epoch."""
    clash = {c.lower() for c in docs.columns} & set(ADDED)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are already there")
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]  # names that can't clash
    key, source = (f"c{docs.columns.index(c)}" for c in (key, source))
    rows = docs.select(*own)
    counts = rows.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("rows"))
    plan = stored(targets(counts, weights).withColumn("buckets", F.greatest(F.ceil(F.col("rows") / BUCKET), F.lit(1))))
    length = stored(length_of(plan, block_rows, max_epochs))
    ends = stored(stretches(plan, length, stretch))
    slots = stored(schedule(ends))
    had = ends.groupBy("name").agg(F.max("upto").alias("blocks"))

    bucket = F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.col("buckets"))
    placed = rows.withColumn("name", _name(F.col(source))).join(F.broadcast(plan.join(had, "name")), "name").withColumn("bucket", bucket)  # a row a source
    filled = placed.groupBy("name", "bucket").agg(F.count("*").alias("held"))
    before = filled.select(
        "name", "bucket", (F.sum("held").over(Window.partitionBy("name").orderBy("bucket")) - F.col("held")).alias("before")
    )
    order = Window.partitionBy("name", "bucket").orderBy(F.struct(F.xxhash64(F.col(key)).alias("a"), F.col(key).alias("b")))
    numbered = (
        placed.withColumn("rank", F.row_number().over(order) - 1)
        .join(before, ["name", "bucket"])
        .withColumn("number", F.col("before") + F.col("rank"))
    )
    # rounds of a row: its places number, number + rows, ... as long as the source has blocks; listed in two steps
    last = F.floor((F.col("blocks") * block_rows - 1 - F.col("number")) / F.col("rows"))
    thousands = numbered.withColumn("last", last).where("last >= 0").withColumn(
        "thousand", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / ROUNDS)))
    )
    rounds = thousands.withColumn(
        "epoch",
        F.explode(F.sequence(F.col("thousand") * ROUNDS, F.least(F.col("last"), F.col("thousand") * ROUNDS + ROUNDS - 1))),
    ).withColumn("at", F.col("epoch") * F.col("rows") + F.col("number")).withColumn("block", F.floor(F.col("at") / block_rows))
    return rounds.join(slots, ["name", "block"]).select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)),
        F.col("slot").cast("long").alias("slot"),
        (F.col("at") % block_rows).cast("long").alias("place"),
        F.col("epoch").cast("long").alias("epoch"),
    )
