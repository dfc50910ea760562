"""URL filter by the ratio of two character language models (operator 2), in DataFrame functions only.

Rules come first: a rule fits its host and all subdomains when the url's path starts with the rule's
path, and the longest fitting rule decides. URLs that rules accept or reject train two smoothed
variable-order Markov models over the characters of host and path; a url without a rule is judged by
its log-likelihood under both, as the mean difference per character against a calibrated threshold.

Models: counts of all ``ORDER``-grams of all ruled urls outside the held-out fifth; shorter contexts are
sums over longer ones. Witten-Bell smoothing blends every context with the next shorter one by the
number of distinct characters seen after it, down to a uniform distribution. The threshold is where
the held-out accepted and rejected urls have equal error; it is 0 while one of them has no url.

Everything is a grouped count or an equi-join on grams. The tables of grams grow with the variety of
urls, not with a group's size squared, and nothing is sent to the driver.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by the
models as the empty text; repeated rows are judged alike and all kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxlake.llm.shared import only, stored

#: (rule, action). Fixed values of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 5
#: Size of the alphabet below the shortest context; one of its signs ends a url.
ALPHABET = 256
HELD_OUT = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\u0002", "\u0003"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest fitting rule, else null."""
    fitting = []
    for rule, action in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        fitting.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.coalesce(*fitting)


def _grams(strings: DataFrame) -> DataFrame:
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col("s"), F.lit(END))
    return strings.withColumn(
        "gram",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("s") + 1), lambda i: F.substr(padded, i, F.lit(ORDER)))),
    )


def log_ratios(strings: DataFrame) -> DataFrame:
    """(gram, ratio): ln P(accepted) - ln P(rejected) of the last character after the others.

    ``strings`` has (s, n, label, held_out); grams of all of them are listed, the trained ones counted.
    """
    trained = ~F.col("held_out")
    counts = stored(
        _grams(strings).groupBy("gram").agg(
            *(F.sum(F.when(trained & (F.col("label") == label), F.col("n")).otherwise(0)).alias(name)
              for label, name in (("allow", "a"), ("block", "r")))
        )
    )
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        levels.append(
            levels[-1].groupBy(F.right("gram", F.lit(order)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        )
    model = None
    for order, level in enumerate(reversed(levels), start=1):
        level = level.withColumn("context", F.left("gram", F.lit(order - 1)))
        contexts = level.groupBy("context").agg(
            *(f(x).alias(f"{x}_{name}") for x in "ar" for name, f in
              (("all", F.sum), ("kinds", lambda c: F.count(F.when(F.col(c) > 0, 1)))))
        )
        level = level.join(contexts, "context")
        if model is None:
            level = level.withColumn("pa", F.lit(1.0 / ALPHABET)).withColumn("pr", F.lit(1.0 / ALPHABET))
        else:
            shorter = model.select(F.col("gram").alias("tail"), "pa", "pr")
            level = level.withColumn("tail", F.right("gram", F.lit(order - 1))).join(shorter, "tail")
        new = {
            f"p{x}": F.when(
                F.col(f"{x}_all") > 0,
                (F.col(x) + F.col(f"{x}_kinds") * F.col(f"p{x}")) / (F.col(f"{x}_all") + F.col(f"{x}_kinds")),
            ).otherwise(F.col(f"p{x}"))
            for x in "ar"
        }
        model = stored(level.select("gram", *(c.alias(n) for n, c in new.items())))
    return model.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row (threshold): where held-out accepted and rejected urls of ``scored`` err equally often."""
    steps = [i / 200 for i in range(1, 100)]
    held = scored.where("held_out and label is not null").groupBy().agg(
        F.percentile_approx(F.when(F.col("label") == "allow", F.col("score")), steps, 10_000).alias("a"),
        F.percentile_approx(F.when(F.col("label") == "block", F.col("score")), [1 - x for x in steps], 10_000).alias("r"),
    )
    # the least share of errors at which the lower accepted scores lie above the upper rejected ones
    meet = F.filter(F.arrays_zip("a", "r"), lambda x: x["a"] >= x["r"])
    first = F.get(meet, F.lit(0))
    middle = F.transform(F.array(first), lambda x: (x["a"] + x["r"]) / 2)[0]
    return held.select(F.coalesce(middle, F.lit(0.0)).alias("threshold"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) for every row of ``pages`` (page_id, url)."""
    host, path = split_url(F.col("url"))
    urls = (
        only(pages, "page_id", "url")
        .select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
        .withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
        .withColumn("s", F.concat("host", "path"))
    )
    strings = stored(
        urls.groupBy("s")
        .agg(F.count("*").alias("n"), F.first("found.action").alias("label"))
        .withColumn("held_out", F.pmod(F.xxhash64("s"), F.lit(HELD_OUT)) == 0)
    )
    scored = stored(
        _grams(strings)
        .join(log_ratios(strings), "gram")
        .groupBy("s", "label", "held_out")
        .agg(F.avg("ratio").alias("score"))
    )
    return (
        urls.join(scored.select("s", "score"), "s")
        .join(F.broadcast(threshold(scored)))  # one row
        .select(
            "page_id",
            "host",
            "path",
            F.col("found.rule").alias("rule"),
            F.coalesce("found.action", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")).alias("verdict"),
            "score",
            "threshold",
        )
    )
