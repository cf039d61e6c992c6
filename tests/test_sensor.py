"""Clocks, cleaning, resampling, seasons and sources on small fixed data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loamstream import schema
from loamstream.functions import distance_ft, machine_name, safe_ratio
from loamstream.operators import clean, derive, resample as rs, seasons, series, timeops as tm
from loamstream.sources import summary as sm, textfiles as tf

D = dt.datetime


def times(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.col("t").cast("timestamp_ntz").alias("ts"))


def test_civil_time_on_both_transitions(spark):
    df = times(spark, "2024-03-10 01:45:00", "2024-03-10 02:00:00", "2024-11-03 00:30:00", "2024-11-03 01:30:00")
    got = [r.ts_local for r in tm.to_civil(df).orderBy("i").collect()]
    assert got == [D(2024, 3, 10, 1, 45), D(2024, 3, 10, 3), D(2024, 11, 3, 1, 30), D(2024, 11, 3, 1, 30)]
    utc = [r.ts_utc for r in tm.to_civil(df).orderBy("i").collect()]
    assert len(set(utc)) == 4


def test_local_gap_shifts_to_its_end_and_fold_is_dropped(spark):
    df = times(spark, "2024-03-10 01:59:00", "2024-03-10 02:30:00", "2024-03-10 03:00:00", "2024-11-03 01:15:00", "2024-11-03 02:00:00")
    tr = tm.dst_transitions(spark.createDataFrame([(2024,)], "year int"))
    assert {(r.kind, r.local_start, r.local_end) for r in tr.collect()} == {
        ("gap", D(2024, 3, 10, 2), D(2024, 3, 10, 3)), ("fold", D(2024, 11, 3, 1), D(2024, 11, 3, 2))}
    got = [(r.i, r.ts) for r in tm.normalize_local(df, tr).orderBy("i").collect()]
    assert got == [(0, D(2024, 3, 10, 1, 59)), (1, D(2024, 3, 10, 3)), (2, D(2024, 3, 10, 3)), (4, D(2024, 11, 3, 2))]


def test_clock_steps_apply_to_the_shifted_time(spark):
    df = times(spark, "2024-01-01 00:30:00", "2024-01-01 01:00:00", "2024-01-01 02:00:00")
    # the second step starts at a time the first one moves rows across
    steps = {"L": [("2024-01-01 01:00:00", 60), ("2024-01-01 02:30:00", -30)]}
    got = [r.ts for r in tm.correct_clock(df, steps, F.lit("L")).orderBy("i").collect()]
    assert got == [D(2024, 1, 1, 0, 30), D(2024, 1, 1, 2), D(2024, 1, 1, 2, 30)]
    same = tm.correct_clock(df, steps, F.lit("other")).orderBy("i").collect()
    assert [r.ts for r in same] == [r.ts for r in df.orderBy("i").collect()]


def test_strict_parse_keeps_rejects(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("01/02/2024",), (None,)], "raw string")
    good, bad = tm.parse_ts(df, "raw")
    assert good.count() == 1 and bad.count() == 2


def long(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, strip string, location string, depth string, variable string, value double")


def test_bounds_include_their_edges(spark):
    rows = [(D(2024, 1, 1), "S1", "T", "1", "VWC", v) for v in (1.0, 80.0, 0.999, 80.001, None)]
    got = [r.value for r in clean.enforce_bounds(long(spark, rows)).collect()]
    assert got == [1.0, 80.0, None, None, None]
    assert clean.bounds_report(long(spark, rows), ["variable"]).first().violations == 2


def test_sentinels_and_nan(spark):
    rows = [(D(2024, 1, 1), "S1", "T", "1", "VWC", v) for v in (9999.0, -9999.0, 10000.0, -10000.0, float("nan"))]
    assert [r.value for r in clean.mask_sentinels(long(spark, rows)).collect()] == [9999.0, -9999.0, None, None, None]


def test_resample_sum_conserves_and_drops_empty_bins(spark):
    rows = [(D(2024, 1, 1, h, 5), "S1", "T", "1", v, x) for h in range(24) for v, x in (("precip_in", 0.1), ("VWC", None if h < 12 else 2.0))]
    df = long(spark, rows)
    hourly = rs.resample(df, "hourly", digits=None)
    assert hourly.filter("variable = 'VWC'").count() == 12
    total = hourly.filter("variable = 'precip_in'").agg(F.sum("value")).first()[0]
    assert total == pytest.approx(2.4)
    assert rs.resample(df, "daily").filter("variable = 'precip_in'").first().value == 2.4


def test_resample_rounds_half_to_even_and_month_ends(spark):
    rows = [(D(2024, 2, 3), "S1", "T", "1", "VWC", 0.0005), (D(2024, 1, 31), "S1", "T", "1", "VWC", 0.0015)]
    got = {r.bin: r.value for r in rs.resample(long(spark, rows), "monthly").collect()}
    assert got == {D(2024, 2, 29): 0.0, D(2024, 1, 31): 0.002}


def test_filled_resample_has_every_bin(spark):
    rows = [(D(2024, 1, 1, 0), "S1", "T", "1", v, 1.0) for v in ("precip_in", "VWC")] + [(D(2024, 1, 1, 3), "S1", "T", "1", v, 1.0) for v in ("precip_in", "VWC")]
    got = rs.resample_filled(long(spark, rows), "hourly", ["variable"]).orderBy("variable", "bin").collect()
    assert [r.value for r in got] == [1.0, None, None, 1.0, 1.0, 0.0, 0.0, 1.0]


def test_right_closed_bins(spark):
    df = times(spark, "2024-01-01 00:15:00", "2024-01-01 00:15:01").withColumn("value", F.lit(1.0))
    got = sorted(r.bin for r in rs.resample_bins(df, 900, []).collect())
    assert got == [D(2024, 1, 1, 0, 15), D(2024, 1, 1, 0, 30)]


def test_single_row_has_no_deviation(spark):
    r = rs.summary_stats(long(spark, [(D(2024, 1, 1), "S1", "T", "1", "VWC", 5.0)]), ["strip"]).first()
    assert (r["min"], r["std"]) == (5.0, None)


def test_value_range_degenerate(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", -4.0), ("c", 1.0), ("c", 2.0)], "k string, value double")
    got = {r.k: (r.low, r.high) for r in rs.value_range(df, ["k"]).collect()}
    assert got == {"a": (0.0, 1.0), "b": (-4.4, -3.6), "c": (1.0, 2.0)}


def test_winter_needs_the_previous_year_and_november_has_no_season(spark):
    df = times(spark, "2023-11-01 00:00:00", "2024-03-31 23:59:59", "2024-04-01 00:00:00", "2024-11-01 00:00:00")
    got = [r.s for r in df.select("i", seasons.assign_season("ts", 2024).alias("s")).orderBy("i").collect()]
    assert got == ["Q1_Winter", "Q1_Winter", "Q2_Early_Growing", None]


def test_empty_season_is_null_and_all_missing_rain_is_zero(spark):
    rows = [(D(2024, 5, 1), "S1", "T", "1", "VWC", 2.0), (D(2024, 5, 1), "S1", "T", "1", "precip_in", None)]
    got = {(r.period_code, r.variable): r.value for r in seasons.season_summary(long(spark, rows), [2024]).collect()}
    assert got == {("Q1_Winter", "VWC"): None, ("Q1_Winter", "precip_in"): None, ("Q2_Early_Growing", "VWC"): 2.0, ("Q2_Early_Growing", "precip_in"): 0.0}


def test_period_normalisation():
    got = seasons.normalize_periods([{"code": "a_b", "start": "2024-05-01", "end": "06-30"}])
    assert got == [{"code": "a_b", "label": "a b", "start": "05-01", "end": "06-30"}]
    assert seasons.period_label({"label": "Winter", "start": "11-01", "end": "03-31"}) == "Winter: Nov 1–Mar 31"


def test_names_round_trip(spark):
    names = ["VWC_1_raw_S1_T", "BattV_Min_S1_T", "SWC_vol_gal_S2_B_3", "EC_2_ratio_S3_S4_M", "unknown"]
    df = spark.createDataFrame([tuple([D(2024, 1, 1)] + [1.0] * len(names))], "ts timestamp_ntz, " + ", ".join(f"{n} double" for n in names))
    got = sorted((r.variable, r.depth, r.strip, r.location) for r in schema.to_long(df).fillna("-").collect())
    assert got == [("BattV_Min", "-", "S1", "T"), ("EC", "2", "S3_S4", "M"), ("SWC_vol_gal", "3", "S2", "B"), ("VWC", "1", "S1", "T")]


def test_ratio_guard(spark):
    df = spark.createDataFrame([(1.0, 0.001), (1.0, 0.0009), (1.0, 0.0), (1.0, None)], "a double, b double")
    assert [r.r for r in df.select(safe_ratio(F.col("a"), F.col("b")).alias("r")).collect()] == [1000.0, None, None, None]


def test_profile_and_distance(spark):
    df = spark.createDataFrame([("p", 6, 0.2), ("p", 12, 0.4), ("p", 18, 0.4)], "k string, z int, theta double")
    r = derive.profile_volume(df, ["k"], 10.0).first()
    assert r.volume == pytest.approx(10 * (0.3 * 6 + 0.4 * 6)) and r.mean_theta == pytest.approx(0.35)
    d = spark.range(1).select(distance_ft(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(0.0)).alias("d")).first().d
    assert d == pytest.approx(3 * 364000.0)


def test_machine_name(spark):
    df = spark.createDataFrame([("CEC/Sum of Cations me/100g",), ("1:1 Soil pH",), ("Gram(+):Gram(-)",), ("NDF %",)], "s string")
    assert [r.m for r in df.select(machine_name(F.col("s")).alias("m")).collect()] == [
        "cec_sum_of_cations_me_100g", "1_1_soil_ph", "gram_gram", "ndf_pct"]


def test_toa5_files_with_different_columns(spark, tmp_path):
    (tmp_path / "S1T_Table1.dat").write_text(
        '"TOA5","x"\n"TIMESTAMP","RECORD","BattV_Min","VWC_1_Avg"\n"TS","RN","V","m"\n"","","Min","Avg"\n'
        '"2024-01-01 00:15:00",1,12.5,0.25\n"2024-01-01 00:00:00",2,"NAN",""\nbroken,3,1,1\n')
    (tmp_path / "S2B_Table1.dat").write_text(
        '"TOA5","x"\n"TIMESTAMP","RECORD","T_3_Avg"\n"TS","RN","C"\n"","","Avg"\n"2024-01-01 00:15:00",1,20\n')
    good, bad = tf.read_toa5(spark, str(tmp_path))
    got = sorted((r.strip, r.location, r.depth or "", r.variable, r.value) for r in good.filter("value IS NOT NULL").collect())
    assert got == [("S1", "T", "", "BattV_Min", 12.5), ("S1", "T", "1", "VWC", 0.25), ("S2", "B", "3", "T", 20.0)]
    assert [r.raw for r in bad.collect()] == ["broken"]


def test_toa5_order_survives_splits(spark, tmp_path):
    lines = ['"TOA5"', '"TIMESTAMP","RECORD","BattV_Min"', '""', '""'] + [f'"2024-01-01 00:00:{i % 60:02d}",{i},{i}.5' for i in range(3000)]
    (tmp_path / "S3M_Table1.dat").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8kb")
    spark.conf.set("spark.sql.files.openCostInBytes", "1kb")
    try:
        good, _ = tf.read_toa5(spark, str(tmp_path))
        rows = good.orderBy("block", "line_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.record for r in rows] == list(range(3000))
    assert len({r.block for r in rows}) > 3


def test_one_and_two_header_lab_files(spark, tmp_path):
    (tmp_path / "two.csv").write_text('Strip,"1:1 pH, soil"\nstrip_name,ph\nS1,"7,1"\n')
    (tmp_path / "one.csv").write_text("strip,date_rec,ph\nS1,2024-01-01,7\n")
    df, human = tf.read_two_header_csv(spark, str(tmp_path / "two.csv"))
    assert df.columns == ["strip_name", "ph"] and df.first().ph == "7,1" and human["ph"] == "1:1 pH, soil"
    df, human = tf.read_two_header_csv(spark, str(tmp_path / "one.csv"))
    assert [tuple(r) for r in df.collect()] == [("S1", "2024-01-01", "7")] and human == {c: c for c in df.columns}


def test_summary_pruning_and_fallback(spark, tmp_path):
    rows = [(D(y, 1, d), "S1", "T", "1", "VWC", float(d)) for y in (2023, 2024) for d in (1, 2)]
    root = str(tmp_path / "s")
    sm.write_summary(rs.resample(long(spark, rows), "daily"), root, "daily")
    df = sm.load_summary(spark, [str(tmp_path / "none"), root], 2024, "daily")
    assert df.count() == 2 and sm.load_summary(spark, root, 1999, "daily") is None
    assert "PartitionFilters: [isnotnull(kind" in df._jdf.queryExecution().toString()


def test_selection_names_carry_units(spark):
    rows = [(D(2024, 1, 1), s, "T", d, "VWC", 2.0) for s in ("S1", "S2") for d in "12"]
    r = long(spark, rows)
    out = sm.export_selection(r, derive.pair_ratio(r, ("VWC",)), "SWC", "S2", "1", None)
    assert "VWC_1_raw_S2_T_pct" in out.columns and "VWC_3_ratio_S1_S2_B" in out.columns
    assert out.first()["VWC_2_ratio_S1_S2_T"] == 1.0


def test_ratio_series_needs_one_grouping(spark):
    with pytest.raises(ValueError):
        series.raw_series(long(spark, []), "VWC", "S1", "2024-01-01", "2024-01-02")
