from datetime import UTC, datetime

from pyspark.sql import functions as F

from meterloom.functions import formats
from meterloom.operators.live import day_start, window_start


def test_numbers_and_countdowns(spark):
    cases = [(999, "999"), (1000, "1K"), (1234, "1.23K"), (12_345, "12.3K"), (123_456, "123K"), (999_499, "999K"), (999_500, "1M"), (1_234_567, "1.23M"), (999_999_999, "1B"), (1_200_000_000, "1.2B"), (1_000_000_000_000, "1T"), (9_995, "10K"), (0, "0")]
    rows = spark.createDataFrame(cases, "n bigint, want string").withColumn("got", formats.short_number(F.col("n")))
    assert [(r.n, r.got) for r in rows.collect()] == cases
    times = [(0, "0s"), (59, "59s"), (60, "1m"), (3661, "1h 1m"), (86_400, "1d"), (90_061, "1d 1h"), (86_461, "1d 1m")]
    rows = spark.createDataFrame(times, "s bigint, want string").withColumn("got", formats.countdown(F.col("s")))
    assert [(r.s, r.got) for r in rows.collect()] == times


def test_paths(spark):
    cases = [("/a/./b/../c//d", "/a/c/d"), ("/../a", "/a"), ("a/../../b", "../b"), ("/", "/"), ("", "")]
    rows = spark.createDataFrame(cases, "p string, want string").withColumn("got", formats.normal_path(F.col("p")))
    assert [(r.p, r.got) for r in rows.collect()] == cases


def test_midnight_in_a_gap(spark):
    now = datetime(2024, 4, 26, 12, tzinfo=UTC)
    assert day_start(now, "Africa/Cairo") == datetime(2024, 4, 25, 22, tzinfo=UTC)
    assert window_start(datetime(2024, 1, 15, 0, 20, tzinfo=UTC), "UTC") == datetime(2024, 1, 15, tzinfo=UTC)
    day = spark.sql("SELECT DATE '2024-04-26' AS d").select(F.unix_seconds(formats.local_midnight(F.col("d"), "Africa/Cairo")).alias("s")).first().s
    assert day == int(datetime(2024, 4, 25, 22, tzinfo=UTC).timestamp())


def test_per_hour(spark):
    r = spark.sql("SELECT 40L AS v, 1800000000L AS w, 7L AS x, 0L AS z").select(formats.per_hour(F.col("v"), F.col("w")), formats.per_hour(F.col("x"), F.col("z")), formats.window_minutes(F.lit(61_000_000))).first()
    assert tuple(r) == (80, 0, 2)
