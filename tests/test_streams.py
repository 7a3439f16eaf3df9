"""Streams of many files, read in several batches and not in the order of time."""

from collections import Counter
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from meridia.plans import QUERIES
from meridia.streaming import edits as T


def test_windows_count_all_rows_of_unordered_files(spark, tmp_path):
    first = datetime(2024, 1, 1, 1, tzinfo=UTC)
    rows = [(first + timedelta(hours=7 * k), "ab"[k % 2]) for k in range(60)]  # 18 days
    for k in (11, 3, 0, 7, 1, 10, 2, 9, 5, 4, 8, 6):
        spark.createDataFrame(rows[5 * k : 5 * k + 5], "ts timestamp, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    want = Counter((t.date(), x) for t, x in rows)
    mark = rows[-1][0] - timedelta(days=2)
    for files in (2, 8, 100):
        got = T.windowed_counts(T.read_stream(spark, f"{tmp_path}/log", files), "ts", "value", "1 day", "2 days").withColumn("day", F.to_date("start")).collect()
        assert {(r.day, r.value): r.n for r in got} == want and len(got) == len(want), (files, sum(r.n for r in got))
        assert {r.day for r in got if r.closed} == {d for d, _ in want if d + timedelta(days=1) <= mark.date()}


def test_state_at_a_point_knows_every_edit_up_to_it(spark, tmp_path):
    log = [(n, datetime(2024, 1, 1) + timedelta(minutes=n), n * n % 7, ("view", "click", "error")[n * n % 11 % 3]) for n in range(500, 1500)]
    spark.createDataFrame(log[::-1], "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    state = {}
    for n, _, k, kind in log:
        if n <= 500 + 999 // 10 * 7:
            state[k] = (None if kind == "error" else kind, state.get(k, (None,))[0])
    got = QUERIES["l3_state_at_point"](spark, str(tmp_path)).collect()
    assert {r.feature_id: (r.value, r.before) for r in got} == state and len(got) == len(state) > 3
