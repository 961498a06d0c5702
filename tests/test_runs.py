"""Write-once runs and retention by months."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, hours
from zonecast.sources import bitemporal as B
from zonecast.sources import runs

OLD = dt.datetime(2024, 1, 1)


def versions(spark, n=24, start=OLD, value=1.0, known=OLD, tier="forever", series=21):
    return B.to_versions(frame(spark, hours(n, start), "value double", [value] * n), series, known, tier)


def stored(df):
    return sorted((r["retention"], r["valid_time"], r["value"], r["knowledge_time"]) for r in df.collect())


def files(root):
    return sorted(p.relative_to(root).as_posix() for p in pathlib.Path(root, "rows").rglob("*.parquet"))


def test_nothing_written_reads_as_nothing(spark, tmp_path):
    root = str(tmp_path / "none")
    assert runs.read_runs(spark, root).count() == 0 and not runs.is_complete(spark, root, "r")
    assert runs.drop_expired(spark, root, OLD) == {"dropped": [], "rewritten": []}


def test_a_run_counts_once_and_a_torn_one_never(spark, tmp_path):
    root = str(tmp_path / "store")
    one = versions(spark)
    torn = runs.write_rows(versions(spark, 10, value=9.0), root)  # ends before it is finished
    assert torn and runs.read_runs(spark, root).count() == 0
    assert runs.write_run(one, root, "first") and not runs.write_run(one, root, "first")
    assert stored(runs.read_runs(spark, root)) == stored(one)
    two = versions(spark, 5, value=2.0, known=OLD + dt.timedelta(hours=1))
    assert runs.write_run(two, root, "second")
    got = runs.read_runs(spark, root)
    assert got.count() == 29 and B.read_latest(got).where("value = 2").count() == 5
    assert {r["run"] for r in got.select("run").distinct().collect()} == {"first", "second"}


def test_two_attempts_that_finish_together_count_once(spark, tmp_path):
    root = str(tmp_path / "store")
    one = versions(spark)
    for attempt in [runs.write_rows(one, root), runs.write_rows(one, root)]:
        runs.finish(spark, root, "same", attempt)
    assert stored(runs.read_runs(spark, root)) == stored(one)


def test_a_run_without_rows_is_complete(spark, tmp_path):
    root = str(tmp_path / "store")
    assert runs.write_run(versions(spark).where("false"), root, "empty") and not runs.write_run(versions(spark), root, "empty")
    assert runs.read_runs(spark, root).count() == 0


def test_ranges_and_series(spark, tmp_path):
    root = str(tmp_path / "store")
    runs.write_run(versions(spark, 24 * 70).unionByName(versions(spark, 24, series=22)), root, "r")
    got = runs.read_runs(spark, root, [21], dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 2, 5))
    assert got.count() == 24 * 2 + 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ym" in plan.split("PartitionFilters")[1][:200]


@pytest.fixture
def aged(spark, tmp_path):
    """January to May in two runs and three tiers, with an unfinished attempt in the month that holds the limit."""
    root = str(tmp_path / "aged")
    tiers = [versions(spark, 24 * 150, tier=t) for t in ("short", "medium", "forever")]
    runs.write_run(tiers[0].unionByName(tiers[1]).unionByName(tiers[2]), root, "a")
    late = versions(spark, 24 * 31, dt.datetime(2024, 4, 20), value=2.0, tier="short")
    runs.write_run(late, root, "b")
    runs.write_run(versions(spark, 24 * 2, dt.datetime(2024, 4, 1), value=3.0, tier="short"), root, "c")
    runs.write_rows(versions(spark, 24 * 5, dt.datetime(2024, 4, 1), value=9.0, tier="short"), root)
    return root


NOW, TTL = dt.datetime(2024, 5, 10, 6), {"short": 25, "medium": 90}  # limits: 15 April and 10 February, 06:00


def test_retention_equals_the_row_filter(spark, aged):
    before = B.apply_retention(runs.read_runs(spark, aged), NOW, TTL)
    want = stored(before)
    done = runs.drop_expired(spark, aged, NOW, TTL)
    assert stored(runs.read_runs(spark, aged)) == want
    assert done == {"dropped": [("short", 202401), ("short", 202402), ("short", 202403), ("medium", 202401)],
                    "rewritten": [("short", 202404), ("medium", 202402)]}
    assert runs.drop_expired(spark, aged, NOW, TTL) == {"dropped": [], "rewritten": []}


def test_retention_leaves_other_files_unread_and_in_place(spark, aged):
    held = files(aged)
    # files no reader could open: wholly expired, wholly kept, and of a tier without a limit
    junk = [f"rows/{p}/attempt=x/part-0.parquet" for p in
            ("retention=short/ym=202402", "retention=short/ym=202405", "retention=medium/ym=202404", "retention=forever/ym=202402")]
    for p in junk:
        pathlib.Path(aged, p).parent.mkdir(parents=True)
        pathlib.Path(aged, p).write_bytes(b"not parquet")
    runs.drop_expired(spark, aged, NOW, TTL)
    after = files(aged)
    assert junk[0] not in after and set(junk[1:]) <= set(after)

    def untouched(p):
        short_ok = "ym=202405" in p
        return "=forever" in p or ("=short" in p and short_ok) or ("=medium" in p and any(m in p for m in ("202403", "202404", "202405")))

    assert [p for p in held if untouched(p)] == [p for p in after if untouched(p) and p not in junk]
    april = spark.read.parquet(f"{aged}/rows/retention=short/ym=202404").groupBy("value").count()
    counts = {r["value"]: r["count"] for r in april.collect()}
    # run b has no expired row, run c only such rows, the unfinished attempt is nobody's to remove
    assert counts == {1.0: 24 * 16 - 6, 2.0: 24 * 11, 9.0: 24 * 5}
    b = [p for p in held if "short/ym=202404" in p]
    assert len([p for p in b if p in after]) == 2 * len(b) // 4
    assert spark.read.parquet(f"{aged}/rows/retention=short/ym=202404").where(F.col("valid_time") < NOW - dt.timedelta(days=25)).where("value < 9").count() == 0
