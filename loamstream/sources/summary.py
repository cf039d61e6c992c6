"""Summary tables in Parquet, partitioned by granularity and year, and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import DEPTHS, LOCATIONS
from ..operators.timeops import ntz
from ..schema import series_name, to_wide
from ..session import path_exists


def union_sources(sources: Sequence[tuple[DataFrame, int]], year: int, ts: str = "ts") -> DataFrame:
    """Candidate sources of a year with their rank, the higher one wins later; rows after the year go."""
    out = None
    for df, rank in sources:
        ranked = df.withColumn("source_rank", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    return out.filter(F.col(ts) < ntz(f"{year + 1}-01-01"))


def extract_before(df: DataFrame, cutoff: str, require: str | None = "BattV_Min", source: str = "file", ts: str = "ts") -> DataFrame:
    """Rows before a cutoff from sources that have the required variable, ordered in each output file."""
    rows = df.filter(F.col(ts) < ntz(cutoff))
    if require is not None:
        having = df.filter(F.col("variable") == require).select(source).distinct()
        rows = rows.join(having, source, "left_semi")
    return rows.sortWithinPartitions(source, ts)


def write_summary(df: DataFrame, root: str, granularity: str, kind: str = "raw", bin_col: str = "bin", mode: str = "overwrite") -> None:
    """Write one granularity; only the years present are replaced.

    Rows are laid out by series and time so that row groups skip, and a hot series is spread over
    range partitions instead of one file. `bin_day` is a date, whose extremes the files' footers hold.
    """
    keyed = df.withColumns({"bin_day": F.to_date(bin_col), "kind": F.lit(kind), "granularity": F.lit(granularity), "year": F.year(bin_col)})
    by = [c for c in ("year", "variable", "strip", "treated", "location", "depth", bin_col) if c in keyed.columns]
    keyed.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).partitionBy("kind", "granularity", "year").parquet(root)


def load_summary(spark: SparkSession, roots: Sequence[str] | str, year: int, granularity: str, kind: str = "raw") -> DataFrame | None:
    """One granularity and year, from the first root that has it; None when none does.

    The three conditions are partition filters, so other files are not opened.
    """
    for root in [roots] if isinstance(roots, str) else roots:
        if not path_exists(spark, root):
            continue
        found = spark.read.parquet(root).filter((F.col("kind") == kind) & (F.col("granularity") == granularity) & (F.col("year") == year))
        if not found.isEmpty():
            return found.drop(*PARTITIONS, "bin_day")
    return None


PARTITIONS = ("kind", "granularity", "year")


def _by_footers(spark: SparkSession, root: str) -> DataFrame:
    """A stored table whose counts, minima and maxima per partition come from the files' footers.

    Spark pushes aggregates into its second Parquet reader only, which is chosen when the table is opened.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    key = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(key)
    spark.conf.set(key, ",".join(x for x in before.split(",") if x != "parquet"))
    try:
        return spark.read.parquet(root)
    finally:
        spark.conf.set(key, before)


def date_ranges(spark: SparkSession, root: str) -> DataFrame:
    """First and last day per year and granularity of the tables in `root`; no row is read."""
    per = _by_footers(spark, root).groupBy(*PARTITIONS).agg(F.min("bin_day").alias("min"), F.max("bin_day").alias("max"))
    return per.groupBy("year", "granularity").agg(F.min("min").alias("min"), F.max("max").alias("max"))


def season_ranges(summary: DataFrame) -> DataFrame:
    """The same for season tables, from the periods' own bounds."""
    return summary.groupBy("season_year").agg(F.min("period_start").alias("min"), F.max("period_end").alias("max"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Which (kind, granularity, year) exist, with their rows; counted from the files' footers."""
    return _by_footers(spark, root).groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n_rows"))


def export_per_logger(df: DataFrame, path: str, variables: Sequence[str] = ("VWC", "T", "EC"), ts: str = "ts") -> None:
    """One CSV folder per logger with only that logger's columns, ordered by time in each file.

    A logger-day is the unit of writing, so a hot logger is written by many tasks.
    """
    names = [f"{v}_{d}" for v in variables for d in DEPTHS] + ["BattV_Min"]
    key = F.when(F.col("variable") == "BattV_Min", F.col("variable")).otherwise(F.concat_ws("_", "variable", "depth"))
    wide = df.filter(F.col("variable").isin("BattV_Min", *variables)).withColumn("_n", key).groupBy(
        F.concat("strip", "location").alias("tag"), ts).agg(*[F.max(F.when(F.col("_n") == n, F.col("value"))).alias(n) for n in names])
    stamped = wide.withColumn(ts, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    stamped.repartition("tag", F.substring(ts, 1, 10)).sortWithinPartitions("tag", ts).write.mode("overwrite").partitionBy("tag").option("header", "true").csv(path)


SUFFIX = {"VWC": "_pct", "SWC": "_pct", "T": "_degF", "EC": "_dS_per_m"}


def export_selection(readings: DataFrame, ratios: DataFrame | None, variable: str, strip: str, depth: str | None, location: str | None, kind: str = "all", ts: str = "ts") -> DataFrame:
    """Wide table of the chosen raw and ratio columns with unit suffixes; ratios keep six decimals.

    With a location the raw columns run over depths, with a depth over locations. Ratio columns are
    those of the strip's pair.
    """
    source = "VWC" if variable == "SWC" else variable
    rows = readings.filter((F.col("variable") == source) & (F.col("strip") == strip))
    if location is not None:
        names = [f"{source}_{d}_raw_{strip}_{location}" for d in DEPTHS]
    else:
        names = [f"{source}_{depth}_raw_{strip}_{l}" for l in LOCATIONS]
    suffix = SUFFIX.get(variable, "")
    raw = to_wide(rows.withColumn("_k", series_name()).filter(F.col("_k").isin(*names)).drop("_k"), names, ts).withColumnsRenamed(
        {n: f"{n}{suffix}" for n in names})
    if kind == "raw" or ratios is None:
        return raw
    pair = ratios.filter((F.col("variable") == source) & ((F.col("treated") == strip) | (F.col("control") == strip)))
    key = F.concat_ws("_", "variable", "depth", F.lit("ratio"), "treated", "control", "location")
    mate = {"S1": "S1_S2", "S2": "S1_S2", "S3": "S3_S4", "S4": "S3_S4"}[strip]
    wanted = [f"{source}_{d}_ratio_{mate}_{l}" for d in DEPTHS for l in LOCATIONS]
    wide = pair.withColumn("_k", key).groupBy(ts).agg(*[F.bround(F.max(F.when(F.col("_k") == n, F.col("ratio"))), 6).alias(n) for n in wanted])
    return wide if kind == "ratio" else raw.join(wide, ts, "full_outer")


# fixed values: columns that may date a dataset, in order of preference
DATE_COLUMNS = ("date_rec", "date", "sample_date", "date_rept", "start_timestamp", "end_timestamp", "application_date", "timestamp", "nir_date")


def describe_dataset(df: DataFrame, date_columns: Sequence[str] = DATE_COLUMNS, year_columns: Sequence[str] = ("year", "Year")) -> DataFrame:
    """Row count, column count and year span from the first date or year column with a usable value."""
    spans = []
    for c in [c for c in (*date_columns, *year_columns) if c in df.columns]:
        y = F.year(F.col(c).cast("string").try_cast("timestamp_ntz")) if c in date_columns else F.col(c).cast("string").try_cast("int")
        spans.append(F.struct(F.min(y).alias("a"), F.max(y).alias("b")))
    first = F.get(F.filter(F.array(*spans), lambda s: s["a"].isNotNull()), F.lit(0)) if spans else F.lit(None).cast("struct<a:int,b:int>")
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), first.alias("_s"))
    a, b = F.col("_s.a"), F.col("_s.b")
    span = F.when(a.isNull(), "unknown").when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string")))
    return out.select("n_rows", F.lit(len(df.columns)).alias("n_columns"), span.alias("year_span"))


def with_year(df: DataFrame, year: int) -> DataFrame:
    """`Year` added where the dataset has none."""
    return df if "Year" in df.columns else df.withColumn("Year", F.lit(year))
