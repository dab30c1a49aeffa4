"""Events stored by month."""

from __future__ import annotations

from pathlib import Path

import pytest
import small
from pyspark.sql import functions as F

from uptakelens.plans.study import GROUP_KEYS, Study
from uptakelens.sources import periods

DAYS = ["2023-10-01", "2023-10-31", "2023-11-15", "2024-01-01"]  # none in December


def log(spark, rows=small.EVENTS):
    dated = [(DAYS[i % len(DAYS)], *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(dated, f"day string, {small.EVENT_SCHEMA}").withColumn("day", F.col("day").cast("date"))


def files(path: str) -> dict[str, set[str]]:
    return {p.name: {f.name for f in p.glob("part-*")} for p in Path(path).glob("period=*")}


def study_of(spark, events) -> Study:
    made = small.study(spark)
    return Study(events, made.register, made.areas)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    periods.write_periods(log(spark), path, "day", "2023-10-01", "2024-02-01")
    return path


@pytest.mark.parametrize("start, end", [("2023-10-01", "2024-02-01"), ("2023-11-01", "2024-01-01"), ("2023-12-01", "2024-01-01")])
def test_any_window_equals_the_events(spark, store, start, end):
    stored = study_of(spark, periods.read_periods(spark, store, start, end))
    direct = study_of(spark, log(spark).filter(f"day >= '{start}' AND day < '{end}'").drop("day"))
    for build in (Study.rates_by_group, lambda s: s.median_age(False), lambda s: s.area_gap(False), Study.gap_cells, Study.vocabulary):
        assert rows(build(stored)) == rows(build(direct))


def test_one_month_replaced_rewrites_one_partition(spark, store):
    before = files(store)
    assert set(before) == {f"period={p}" for p in ("2023-10", "2023-11", "2023-12", "2024-01")}
    late = spark.createDataFrame([("2023-11-30", "a1", "H: Indian", "65-69", "Male", 67)], f"day string, {small.EVENT_SCHEMA}")
    both = log(spark).union(late.withColumn("day", F.col("day").cast("date")))
    assert periods.write_periods(both, store, "day", "2023-11-01", "2023-12-01") == ["2023-11"]
    after = files(store)
    assert before["period=2023-11"].isdisjoint(after["period=2023-11"])
    assert all(before[p] == after[p] for p in before if p != "period=2023-11")
    read = periods.read_periods(spark, store, "2023-11-01", "2023-12-01")
    assert read.selectExpr("sum(events)").first()[0] == both.filter("day LIKE '2023-11%'").count()


def test_a_month_that_lost_its_events_is_emptied(spark, store):
    periods.write_periods(log(spark).filter("false"), store, "day", "2023-10-01", "2023-11-01")
    assert periods.read_periods(spark, store, "2023-10-01", "2023-11-01").collect() == []


def test_only_the_windows_partitions_are_read(spark, store):
    cells = study_of(spark, periods.read_periods(spark, store, "2023-11-01", "2024-01-01")).event_cells(GROUP_KEYS[:1])
    plan = cells._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "(period#" in plan


def test_a_month_never_written_is_an_error(spark, store):
    with pytest.raises(ValueError, match="2024-02"):
        periods.read_periods(spark, store, "2024-01-01", "2024-03-01")


@pytest.mark.parametrize("window", [("2023-10-02", "2023-12-01"), ("2023-10-01", "2023-10-31"), ("2023-10-01", "2023-10-01")])
def test_windows_that_cut_a_month(spark, tmp_path, window):
    with pytest.raises(ValueError):
        periods.write_periods(log(spark), str(tmp_path), "day", *window)


def test_days_as_periods_and_counts_given(spark, tmp_path):
    path = str(tmp_path / "days")
    tallied = log(spark).groupBy("day", "area", "group_raw", "age_band", "sex", "age").count()
    tallied = tallied.withColumnRenamed("count", "events")
    periods.write_periods(tallied, path, "day", "2023-10-01", "2023-11-03", unit="day")
    assert len(files(path)) == 33
    read = periods.read_periods(spark, path, "2023-10-31", "2023-11-01", unit="day")
    assert read.selectExpr("sum(events)").first()[0] == sum(i % 4 == 1 for i in range(len(small.EVENTS)))
    with pytest.raises(ValueError, match="unit"):
        periods.periods_of("2023-10-01", "2023-11-01", "week")
