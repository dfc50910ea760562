"""Published rate files: the daily CSV and the wide monthly CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxlake.functions.rates import DAILY_SOURCE, MONTHLY_SOURCE
from taxlake.operators.currency import from_units_per_eur

_EMPTY = "currency string, rate_date date, rate_to_eur decimal(18,10), source string"


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily reference rates; columns are found by header name, unusable rows are skipped."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = {c.strip().upper(): c for c in raw.columns}
    if not {"CURRENCY", "TIME_PERIOD", "OBS_VALUE"} <= names.keys():
        return spark.createDataFrame([], _EMPTY)
    day = F.trim(F.col(f"`{names['TIME_PERIOD']}`"))
    value = F.trim(F.col(f"`{names['OBS_VALUE']}`")).try_cast("decimal(28,10)")
    rows = raw.select(
        F.upper(F.trim(F.col(f"`{names['CURRENCY']}`"))).alias("currency"),
        F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd")).alias("rate_date"),
        value.alias("units"),
    )
    return rows.filter(F.col("rate_date").isNotNull() & (F.col("units") > 0)).select(
        "currency", "rate_date", from_units_per_eur(F.col("units")).alias("rate_to_eur"), F.lit(DAILY_SOURCE).alias("source")
    )


def read_monthly(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Monthly rates, one country per row and one month per column, to long form.

    A published file holds one year, a few hundred rows; ``path`` may be a folder of many. Each file has its own
    header. Without ``year`` it is read from the path, as in ``year=2024``. The last row of a currency and
    month wins.
    """
    columns = [f"c{i}" for i in range(14)]
    raw = (
        spark.read.option("sep", ";")
        # the file is windows-1252; Latin-1 reads its letters, digits and no-break spaces alike
        .option("encoding", "iso-8859-1")
        .option("multiLine", True)
        .option("header", False)
        .schema(", ".join(f"{c} string" for c in columns))
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
        .withColumn("line", F.monotonically_increasing_id())
    )
    clean = lambda c: F.lower(F.trim(F.regexp_replace(c, "\ufeff", "")))
    is_header = (clean(F.col("c0")) == "land") & F.col("c13").isNotNull()
    start = F.min(F.when(is_header, F.col("line"))).over(W.partitionBy("file"))
    body = (
        raw.withColumn("start", start)
        .filter((F.col("line") > F.col("start")) & (clean(F.col("c1")) == "1 euro"))
        .select("file", "line", *[F.col(f"c{m + 1}").alias(str(m)) for m in range(1, 13)])
    )
    cells = body.unpivot(["file", "line"], [str(m) for m in range(1, 13)], "month", "cell")
    pattern = r"^([0-9][0-9.,\s ]*)\s+([A-Z]{3})$"
    number = F.regexp_replace(F.regexp_extract(F.trim("cell"), pattern, 1), r"[\s ]", "")
    units = F.when(
        number.rlike(r"^(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?$"),
        F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(28,10)"),
    )
    quotes = cells.select(
        F.regexp_extract(F.trim("cell"), pattern, 2).alias("currency"),
        F.col("month").cast("int").alias("month"),
        units.alias("units"),
        "line",
        (F.regexp_extract("file", r"year=(\d{4})", 1).try_cast("int") if year is None else F.lit(year)).alias("year"),
    ).filter((F.col("units") > 0) & (F.col("currency") != ""))
    latest = quotes.where("year is not null").groupBy("currency", "year", "month").agg(F.max_by("units", "line").alias("units"))
    month = F.lpad(F.col("month").cast("string"), 2, "0")
    return latest.select(
        "currency",
        F.make_date(F.col("year"), F.col("month"), F.lit(1)).alias("rate_date"),
        from_units_per_eur(F.col("units")).alias("rate_to_eur"),
        F.concat(F.lit(f"{MONTHLY_SOURCE} "), F.col("year").cast("string"), F.lit("-"), month).alias("source"),
    )
