from __future__ import annotations

from datetime import datetime, timedelta

from loomcrawl.streaming import dedup

KIND = "delivery_id bigint, source_agent string, batch_sequence bigint, emitted_at timestamp, extra string"


def brute(rows):
    first, seen = {}, set()
    for d, agent, seq, at, _ in sorted(rows, key=lambda r: r[0]):
        key = (agent.strip().lower() if agent is not None else None, seq, at and at.replace(microsecond=at.microsecond // 1000 * 1000))
        if d in seen:
            continue
        seen.add(d)
        first.setdefault(key, d)
    return sorted(seen - set(first.values()))


def deliveries():
    t = datetime(2030, 1, 1)
    rows = [(i, f"agent-{i % 7}", i // 3, t + timedelta(hours=i), "x") for i in range(1, 60)]
    rows += [(100 + i, f" AGENT-{i % 7} ", i // 3, t + timedelta(hours=i, microseconds=400), "x") for i in range(1, 60, 5)]
    rows += [(200, "late", 1, t - timedelta(days=300), "x"), (201, "late", 1, t - timedelta(days=300), "x")]
    rows += [(300, None, 1, t, "x"), (301, None, 1, t, "x"), (302, "a", None, t, "x"), (303, "a", None, t, "x"), (304, "a", 1, None, "x"), (305, "A", 1, None, "x")]
    rows += [(400 + i, "hot", 1, t, "x") for i in range(200)]
    return rows + [rows[0]]


def write_run(spark, rows, folder):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)


def test_repeated_deliveries_over_many_files(spark, tmp_path):
    rows = deliveries()
    for k in range(0, len(rows), 60):  # several files: late copies come in later micro-batches
        write_run(spark, rows[k : k + 60], str(tmp_path / "b.parquet"))
    got = [r.delivery_id for r in dedup.repeated_deliveries(spark, str(tmp_path / "b.parquet"), delay_ms=7_200_000, files_per_trigger=1).collect()]
    assert sorted(got) == brute(rows) and len(got) == len(set(got))


def test_three_runs_from_one_checkpoint(spark, tmp_path):
    """Each call goes on from the state of the last; only late arrivals are looked up."""
    t = datetime(2030, 1, 1)
    first = [(i, f"agent-{i}", i, t + timedelta(minutes=i), "x") for i in range(1, 40)]
    again = [(100 + i, f" Agent-{i} ", i, t + timedelta(minutes=i), "x") for i in range(1, 40, 2)]
    ahead = [(200, "ahead", 1, t + timedelta(days=30), "x")]
    expired = [(300 + i, f"AGENT-{i}", i, t + timedelta(minutes=i), "x") for i in range(1, 40)] + [(400, "never seen", 1, t, "x"), (401, "never seen", 1, t, "x")]
    source, home = str(tmp_path / "runs"), "file://" + str(tmp_path / "home")
    rows, kept = [], []
    for run in (first, again + ahead, expired):
        write_run(spark, run, source)
        rows += run
        log = dedup.DeliveryLog(spark, home, delay_ms=3_600_000).receive(source)
        kept.append({r.delivery_id for r in log.kept().collect()})
    assert kept[0] == set(range(1, 40)) and kept[1] == kept[0] | {200} and kept[2] == kept[1] | {400}
    assert {r for r, *_ in rows} - kept[2] == set(brute(rows))
    verdicts = {v: n for v, n in log.answers().groupBy("verdict").count().collect()}
    assert verdicts == {"kept": 40, "late": 40}  # copies on time were answered by the state alone
    assert dedup.DeliveryLog(spark, home, delay_ms=3_600_000).receive(source).answers().count() == 80
    # Without what the stream put out, the lookup has nothing to tell late copies by.
    lost = log.answers().where("verdict = 'late'").select("message").distinct().count()
    assert lost == 40 and log.answers().where("verdict = 'kept'").select("message").distinct().count() == 40


def test_files_out_of_order(spark, tmp_path):
    t = datetime(2030, 1, 1)
    source = str(tmp_path / "runs")
    write_run(spark, [(9, "a", 1, t, "x"), (8, "b", 1, t, "x")], source)
    write_run(spark, [(3, "A", 1, t, "x"), (2, "c", 1, t, "x")], source)
    write_run(spark, [(5, "a ", 1, t, "x"), (None, "a", 1, t, "x")], source)
    got = dedup.repeated_deliveries(spark, source, files_per_trigger=1).collect()
    assert sorted(r.delivery_id for r in got) == [5, 9]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(str(tmp_path / "e.parquet"))
    assert dedup.repeated_deliveries(spark, str(tmp_path / "e.parquet")).count() == 0
