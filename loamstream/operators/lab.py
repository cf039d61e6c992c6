"""Lab result cleaning, merging and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import div
from ..plans import keep_latest
from ..plans.words import meet_on_rarest, prefixes
from .timeops import parse_ts_formats

# fixed values: texts that mean zero, texts that mean nothing
ZERO_TEXTS = ("NOT REPORTED", "NOT_REPORTED", "<0.01", "< 0.01", "<0.1", "< 0.1", "BDL")
EMPTY_TEXTS = ("", "NA", "N/A", "NAN", "NULL", "NONE", ".", "-", "--")
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy")

# fixed values: stable column names and the columns they may come from, first present wins
ALIASES = {
    "nitrate_n_ppm": ("h2o_no3_n", "no3_n_ppm", "no3_n", "nitrate_n", "nitrate_ppm", "no3_ppm"),
    "soil_ph": ("1_1_soil_ph", "soil_ph_1_1", "ph", "soil_pH"),
    "cec_meq_100g": ("cec_sum_of_cations_me_100g", "cec"),
}
# fixed values: soil chemistry columns filled from their older names
BACKFILL = {
    "soil_ph_1_1": "1_1_soil_ph", "ec_1_1": "1_1_s_salts_mmho_cm", "cec_meq_100g": "cec_sum_of_cations_me_100g",
    "sum_of_cations_meq_100g": "cec_sum_of_cations_me_100g", "nitrate_n_ppm": "h2o_no3_n",
}
KEEP_MOISTURE = ("moisture_pct", "dry_matter_pct", "moisture_pct_db", "dry_matter_pct_db")


def strip_from_id(c: Column) -> Column:
    """`strip_1` … `strip_4` from the many ways a sample id names its strip."""
    s = F.regexp_replace(F.upper(F.trim(c)), r"[\s_\-]+", "")
    named = F.coalesce(*[F.when(s.contains(f"STRIP{d}"), F.lit(d)) for d in "1234"])
    digit = F.coalesce(named, F.nullif(F.regexp_extract(s, "S([1-4])", 1), F.lit("")))
    return F.when(digit.isNotNull(), F.concat(F.lit("strip_"), digit))


def lab_number(c: Column, less_is_zero: bool = True) -> Column:
    """Number in a lab cell: below detection is 0, blanks are missing, thousands commas go."""
    s = F.trim(c.cast("string"))
    u = F.upper(s)
    value = F.replace(s, F.lit(","), F.lit("")).try_cast("double")
    out = F.when(u.isin(*ZERO_TEXTS), F.lit(0.0)).when(u.isin(*EMPTY_TEXTS), F.lit(None).cast("double"))
    if less_is_zero:
        out = out.when(s.startswith("<"), F.lit(0.0))
    return out.otherwise(F.when(~F.isnan(value), value))


def clean_lab_values(df: DataFrame, columns: Sequence[str], less_is_zero: bool = True) -> DataFrame:
    return df.withColumns({c: lab_number(F.col(c), less_is_zero) for c in columns})


def lab_dates(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Date columns over several formats, row by row; unreadable is NULL."""
    out = df
    for c in columns:
        out = parse_ts_formats(out, c, formats, to="_ts").withColumn(c, F.to_date("_ts")).drop("_ts")
    return out


def pick_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate the frame has, exact names before names that differ in case."""
    for c in candidates:
        if c in df.columns:
            return c
    lowered = {c.strip().lower(): c for c in df.columns}
    return next((lowered[c.strip().lower()] for c in candidates if c.strip().lower() in lowered), None)


def first_value(df: DataFrame, candidates: Sequence[str]) -> Column:
    """Cell-wise first non-missing of the candidate columns the frame has."""
    have = [F.col(c) for c in candidates if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def add_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Stable names that are missing are copied from the first known source column."""
    for name, sources in aliases.items():
        if name not in df.columns:
            source = pick_column(df, sources)
            if source is not None:
                df = df.withColumn(name, F.col(f"`{source}`"))
    return df


def standardize_lab(df: DataFrame, id_columns: Sequence[str], dates: Mapping[str, str], drop: Sequence[str] = (), depth: tuple[int, int] | None = None, text_columns: Sequence[str] = ()) -> DataFrame:
    """Fixed order: strip, admin columns, dates, special values, depth, numbers, aliases.

    `dates` maps source to target names; `text_columns` stay text.
    """
    source = pick_column(df, id_columns)
    out = df.withColumn("strip", strip_from_id(F.col(source))) if source else df
    gone = {c.lower() for c in drop}
    out = out.drop(*[c for c in out.columns if c.strip().lower() in gone])
    out = out.withColumnsRenamed({a: b for a, b in dates.items() if a in out.columns and b not in out.columns})
    out = lab_dates(out, [b for b in dates.values() if b in out.columns])
    if depth is not None:
        out = out.withColumns({"begin_depth_in": F.lit(depth[0]), "end_depth_in": F.lit(depth[1])})
    keep = {"strip", "begin_depth_in", "end_depth_in", *dates.values(), *text_columns, *([source] if source else [])}
    out = clean_lab_values(out, [c for c in out.columns if c not in keep])
    return add_aliases(out)


def resolve_headers(columns: DataFrame, aliases: DataFrame) -> DataFrame:
    """Actual header for every field: exact, then prefix, then all words of an alias.

    `columns` has `ord` (anything sortable) and `actual`, `aliases` has `field, alias_ord, alias`. Names meet on whole
    beginnings (of a beginning only its first column matters, so it is one row) and on an alias's rarest word.
    """
    def squeezed(c: str) -> Column:
        return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "")

    def words(c: str) -> Column:
        found = F.regexp_extract_all(F.lower(F.col(c)), F.lit("([a-z0-9]+)"), 1)
        return F.filter(F.array_distinct(found), lambda w: ~w.isin("ng", "g"))

    # duplicates of one squeezed name: the first column stands for all
    cols = columns.withColumn("_n", squeezed("actual")).filter("_n <> ''").groupBy("_n").agg(
        F.min_by("actual", "ord").alias("actual"), F.min("ord").alias("ord"))
    al = aliases.withColumn("_a", squeezed("alias"))
    first = F.min_by("actual", "ord").alias("actual"), F.min("ord").alias("ord")
    begun = cols.select("ord", "actual", F.explode(prefixes(F.col("_n"))).alias("_a")).groupBy("_a").agg(*first)
    shown = ("field", "_k", "alias_ord", "ord", "actual")
    known = al.filter("_a <> ''")
    exact = known.join(cols.withColumnRenamed("_n", "_a"), "_a").withColumn("_k", F.lit(0)).select(*shown)
    longer = known.join(begun, "_a").withColumn("_k", F.lit(1)).select(*shown)
    shorter = known.withColumn("_n", F.explode(prefixes(F.col("_a")))).join(cols, "_n").withColumn("_k", F.lit(1)).select(*shown)
    by_name = exact.unionByName(longer).unionByName(shorter)
    aw = al.select("field", "alias_ord", words("alias").alias("_aw")).filter(F.size("_aw") > 0).distinct()
    cw = cols.select("ord", "actual", words("actual").alias("_cw"))
    by_word = meet_on_rarest(aw, cw, "_aw", "_cw").withColumn("_k", F.lit(2)).select(*shown)
    best = by_name.unionByName(by_word).groupBy("field").agg(F.min_by("actual", F.struct("_k", "alias_ord", "ord")).alias("actual"), F.min("_k").alias("match_kind"))
    return aliases.select("field").distinct().join(best, "field", "left")


def backfill_strips(df: DataFrame, date: str = "date_rec", order: str = "row_no") -> DataFrame:
    """Dates with exactly four rows without a strip get strips 1 to 4 in row order.

    The count decides first, so only groups of four are ever ordered.
    """
    blank = F.trim(F.coalesce("strip", F.lit(""))) == ""
    four = df.filter(blank).groupBy(date).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 4").select(date)
    w = Window.partitionBy(date).orderBy(order)
    fixed = df.filter(blank).join(four, date, "left_semi").select(
        order, F.concat(F.lit("strip_"), F.row_number().over(w).cast("string")).alias("_fix"))
    out = df.join(fixed, order, "left")
    return out.withColumn("strip", F.coalesce("_fix", strip_from_id(F.col("strip")))).select(*df.columns)


def merge_supplement(base: DataFrame, extra: DataFrame, keys: Sequence[str] = ("strip", "date_rec"), order: str = "row_no") -> DataFrame:
    """Base and supplement rows, the last per key wins and the supplement comes last.

    A column the supplement never fills is missing from its rows either way.
    """
    shared = [c for c in base.columns if c in extra.columns]
    both = base.withColumn("_src", F.lit(0)).unionByName(extra.select(*shared).withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_latest(both, keys, ["_src", order]).drop("_src")


def patch_missing(df: DataFrame, supplement: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("strip", "nir_date"), order: str = "row_no") -> DataFrame:
    """Missing cells filled from the supplement's last row per key; `filled` counts them per row."""
    supp = keep_latest(supplement, keys, [order]).select(*keys, *[F.col(c).alias(f"_s_{c}") for c in columns if c in supplement.columns])
    out = df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns}).join(supp, list(keys), "left")
    have = [c for c in columns if c in supplement.columns]
    gained = sum((F.when(F.col(c).isNull() & F.col(f"_s_{c}").isNotNull(), 1).otherwise(0) for c in have), F.lit(0))
    return out.withColumn("filled", gained).withColumns({c: F.coalesce(c, f"_s_{c}") for c in have}).drop(*[f"_s_{c}" for c in have])


def fill_counts(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many cells of each column were filled."""
    def missing(df: DataFrame, name: str) -> DataFrame:
        have = [c for c in columns if c in df.columns]
        one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in have])
        return one.unpivot([], have, "column", name)

    a, b = missing(before, "_a"), missing(after, "_b")
    return b.join(a, "column", "left").select("column", (F.col("_a") - F.col("_b")).alias("filled"))


def prefer_dry_basis(df: DataFrame, keep: Sequence[str] = KEEP_MOISTURE) -> DataFrame:
    """As-received columns go when their dry-basis twin is there."""
    have = set(df.columns)
    return df.drop(*[c for c in df.columns if c not in keep and not c.endswith("_db") and f"{c}_db" in have])


def lab_row_filter(df: DataFrame, sample_id: str = "sample_id", date: str = "date_rec", backfill: Mapping[str, str] = BACKFILL) -> DataFrame:
    """Rows of the trial with both keys; newer column names are filled from the older ones."""
    rows = df.withColumn("strip", strip_from_id(F.col(sample_id))).filter("strip IS NOT NULL")
    rows = rows.filter(F.trim(F.coalesce(F.col(date).cast("string"), F.lit(""))) != "")
    for new, old in backfill.items():
        if old in rows.columns:
            rows = rows.withColumn(new, F.coalesce(F.col(new), F.col(f"`{old}`")) if new in rows.columns else F.col(f"`{old}`"))
    return rows


# ------------------------------------------------------------------ tables

def lab_cell(df: DataFrame, keys: Sequence[str], raw: str = "raw") -> DataFrame:
    """One value per cell: a single distinct text stays (as number if it is one), several numbers are
    averaged, anything else is missing.

    `min = max` tells a single text from several, so the whole rule combines on the map side.
    """
    text = F.trim(F.col(raw).cast("string"))
    missing = text.isNull() | F.upper(text).isin("", "NAN", "NONE", "NULL")
    t = F.when(~missing, text)
    num = F.replace(t, F.lit(","), F.lit("")).try_cast("double")
    got = df.groupBy(*keys).agg(
        F.min(t).alias("_lo"), F.max(t).alias("_hi"), F.avg(num).alias("_avg"), F.count(t).alias("_n"), F.count(num).alias("_m"),
        F.max(num).alias("_one"))
    single = F.col("_lo") == F.col("_hi")
    all_num = (F.col("_n") > 0) & (F.col("_n") == F.col("_m"))
    return got.select(
        *keys, F.when(single & all_num, F.col("_one")).when(all_num, F.col("_avg")).alias("value"),
        F.when(single & (F.col("_m") == 0), F.col("_lo")).alias("text_value"))


PAIR_ROWS = (("s1_s2", "strip_1", "strip_2"), ("s3_s4", "strip_3", "strip_4"))


def lab_matrix(cells: DataFrame, date: str = "sampled_on", min_year: int | None = None, years: tuple[int, int] | None = None, ratios: bool = True) -> DataFrame:
    """Strip rows and treated/control ratio rows by analyte and date: (analyte, row_key, date, value).

    `cells` has `strip, analyte, value` and the date. The ratio comes from one conditional
    aggregation over the strips, not from a self-join.
    """
    rows = cells
    if min_year is not None:
        rows = rows.filter(F.year(date) >= min_year)
    if years is not None:
        rows = rows.filter(F.year(date).between(*years))
    out = rows.select("analyte", F.col("strip").alias("row_key"), date, "value")
    if ratios:
        by = rows.groupBy("analyte", date).agg(*[
            F.max(F.when(F.col("strip") == s, F.col("value"))).alias(s) for _, a, b in PAIR_ROWS for s in (a, b)])
        pairs = by.select("analyte", date, F.explode(F.array(*[
            F.struct(F.lit(k).alias("row_key"), div(F.col(a), F.col(b)).alias("value")) for k, a, b in PAIR_ROWS])).alias("_p")).select("analyte", date, "_p.*")
        out = out.unionByName(pairs)
    return out


def by_dates(matrix: DataFrame, rows: Sequence[str], dates: Sequence[str], date: str = "sampled_on", value: str = "value") -> DataFrame:
    """The long matrix with one column per listed date; a date outside the list fails the job."""
    listed = F.col(date).isNull() | F.col(date).isin(*[F.lit(d).cast("date") for d in dates])
    checked = matrix.withColumn(value, F.when(listed, F.col(value)).otherwise(
        F.raise_error(F.concat(F.lit("date outside the list: "), F.col(date).cast("string"))).cast("double")))
    return checked.groupBy(*rows).agg(*[F.max(F.when(F.col(date) == F.lit(d).cast("date"), F.col(value))).alias(d) for d in dates])


def lab_long_matrix(df: DataFrame, row_key: str, period: str, variables: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mean of each variable by row and sampling date: (row_key, variable, sampled_on, value).

    A variable is the first column it is known by.
    """
    chosen = {k: pick_column(df, [k, *names]) for k, names in variables.items()}
    cells = F.array(*[F.struct(F.lit(k).alias("variable"), F.col(c).cast("double").alias("value")) for k, c in chosen.items() if c])
    rows = df.withColumn("sampled_on", F.col(period).try_cast("date")).filter("sampled_on IS NOT NULL").select(
        F.col(row_key).alias("row_key"), "sampled_on", F.explode(cells).alias("_c"))
    return rows.groupBy("row_key", "_c.variable", "sampled_on").agg(F.avg("_c.value").alias("value"))


def lab_wide_matrix(df: DataFrame, row_key: str, min_year: int | None = None, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Wide table with dates as headers to long rows (row_key, sampled_on, value)."""
    columns = [c for c in df.columns if c != row_key]
    melted = df.unpivot([row_key], [F.col(f"`{c}`").cast("double").alias(c) for c in columns], "_h", "value")
    rows = parse_ts_formats(melted, "_h", formats, to="_ts").withColumn("sampled_on", F.to_date("_ts"))
    if min_year is not None:
        rows = rows.filter(F.year("sampled_on") >= min_year)
    return rows.select(F.trim(F.col(row_key)).alias(row_key), "sampled_on", "value")


def band_label(df: DataFrame, bands: DataFrame, value: str = "value", key: str = "reference_key") -> DataFrame:
    """First band, in order, that holds the value.

    Bands of one key are a handful, kept as an array on one row per key; a reading is matched in its
    own row and never multiplied.
    """
    item = F.struct("ord", "label", "min_value", "max_value", "include_min", "include_max")
    table = bands.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_b"))
    v = F.col(value)

    def holds(b: Column) -> Column:
        low = b["min_value"].isNull() | F.when(b["include_min"], v >= b["min_value"]).otherwise(v > b["min_value"])
        high = b["max_value"].isNull() | F.when(b["include_max"], v <= b["max_value"]).otherwise(v < b["max_value"])
        return low & high

    hit = F.get(F.filter("_b", holds), F.lit(0))["label"]
    return df.join(table, key, "left").withColumn("label", F.when(v.isNotNull(), hit)).drop("_b")


def lab_report(df: DataFrame, expected: Sequence[str], by: Sequence[str] = ("strip", "date_rec"), ignore: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows per strip and date, columns that are missing or unmatched with the number of values they hold).

    A column is unmatched if it is neither expected nor in `ignore`.
    """
    missing = [c for c in expected if c not in df.columns]
    unmatched = [c for c in df.columns if c not in expected and c not in ignore]
    entry = lambda issue, c, n: F.struct(F.lit(issue).alias("issue"), F.lit(c).alias("column"), n.alias("n_values"))
    found = [entry("missing", c, F.lit(0).cast("bigint")) for c in missing] + [entry("unmatched", c, F.count(F.col(f"`{c}`"))) for c in unmatched]
    columns = df.agg(F.array(*found).alias("_c")) if found else df.agg(F.lit(None).cast("array<struct<issue:string,column:string,n_values:bigint>>").alias("_c"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), columns.select(F.inline("_c"))
