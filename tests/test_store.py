"""The refreshed store equals a full run, and the monitor follows growing files."""

import os
import threading
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace

import pytest

from meterloom.operators import incremental, reports
from meterloom.operators.pricing import built_in_prices
from meterloom.plans.api import build_report, events_of, refreshed_report
from meterloom.schemas import ReportOptions
from meterloom.sources import ranges
from meterloom.sources.files import selected_files, selected_lines
from meterloom.streaming import monitor
from tests.test_logs import context, meta, tokens, usage, write


def test_refresh_equals_full_run(spark, tmp_path):
    root, store, prices = tmp_path / "logs", str(tmp_path / "store"), built_in_prices(spark)
    write(root / "a.jsonl", context("gpt-5"), tokens("2025-09-11T00:00:01Z", usage(10, 1, 2, 0)))
    write(root / "b.jsonl", tokens("2025-09-12T23:30:01Z", usage(20, 1, 2, 0)))
    zones = ("UTC", "Europe/Warsaw")

    def same():
        for tz in zones:
            options = ReportOptions(roots=(str(root),), timezone=tz)
            full = reports.daily_report(events_of(spark, options)[0], prices, options).collect()
            assert incremental.stored_report(spark, "daily", store, prices, options).collect() == full
        return full

    def refreshed():
        chosen = selected_files(spark, [str(root)])
        found = [incremental.refresh(spark, selected_lines(spark, [str(root)], files=chosen), chosen, store, tz, ranges) for tz in zones]
        assert found[0] == found[1]
        return found[0]

    assert refreshed() == {"rebuild": 2}
    assert [str(r.date) for r in same()] == ["2025-09-11", "2025-09-13"]
    assert refreshed() == {"cached": 2}
    with open(root / "a.jsonl", "a") as f:
        f.write(__import__("json").dumps(tokens("2025-09-13T00:00:01Z", total=usage(40, 1, 5, 0)), separators=(",", ":")) + "\n")
    assert refreshed() == {"cached": 1, "append": 1}
    assert len(same()) == 2
    (root / "b.jsonl").unlink()
    assert refreshed() == {"cached": 1, "removed": 1}
    same()
    incremental.compact(spark, store, str(tmp_path / "compact"))
    assert incremental.stored_report(spark, "daily", str(tmp_path / "compact"), prices).collect() == incremental.stored_report(spark, "daily", store, prices).collect()


def test_stored_session_report_and_lost_race(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    write(root / "project/parent.jsonl", meta("t0"), context("gpt-5"), tokens("2025-09-11T00:00:01Z", usage(100, 0, 10, 0, 110)))
    boundary = {"type": "inter_agent_communication_metadata", "payload": {}}
    write(root / "project/child.jsonl", meta("t1", "t0"), boundary, tokens("2025-09-11T00:00:03Z", usage(20, 0, 2, 0, 22)))
    options = ReportOptions(roots=(str(root), str(tmp_path / "gone")))
    got, want = refreshed_report(spark, "session", store, options), build_report(spark, "session", options)
    assert got["rows"].collect() == want["rows"].collect() and got["rows"].first().total == 132
    assert got["totals"].collect() == want["totals"].collect() and got["missing_directories"] == [str(tmp_path / "gone")]
    # another refresh took the next generation
    rows = spark.createDataFrame([], incremental.MANIFEST)
    incremental.commit(spark, rows, store, "UTC", 2)
    with pytest.raises(incremental.StoreChanged):
        incremental.commit(spark, rows, store, "UTC", 2)


def test_broken_sums_are_read_again(spark, tmp_path):
    root, store, prices = tmp_path / "logs", tmp_path / "store", built_in_prices(spark)
    write(root / "a.jsonl", tokens("2025-09-11T00:00:01Z", usage(10, 1, 2, 0)))
    write(root / "b.jsonl", tokens("2025-09-12T00:00:01Z", usage(20, 1, 2, 0)))
    chosen = selected_files(spark, [str(root)])
    go = lambda: incremental.refresh(spark, selected_lines(spark, [str(root)], files=chosen), chosen, str(store))
    assert go() == {"rebuild": 2}
    for part in store.glob("sums/tz=UTC/run=*"):
        rows = spark.read.parquet(str(part)).where("session_id = 'a'")
        spark.createDataFrame(rows.collect(), rows.schema).write.mode("overwrite").parquet(str(part))
    assert go() == {"cached": 1, "rebuild": 1}
    assert [r.total for r in incremental.stored_report(spark, "daily", str(store), prices).collect()] == [12, 22]


def appended(path, *entries, end="\n"):
    with open(path, "a") as f:
        f.write("\n".join(e if isinstance(e, str) else __import__("json").dumps(e, separators=(",", ":")) for e in entries) + end)


def test_only_new_bytes_are_parsed(spark, tmp_path):
    root, store, prices = tmp_path / "logs", str(tmp_path / "store"), built_in_prices(spark)
    boundary = {"type": "inter_agent_communication_metadata", "payload": {}}
    write(root / "a.jsonl", context("gpt-5.3-codex"), tokens("2025-09-11T00:00:01Z", total=usage(10, 1, 2, 0)))
    write(root / "child.jsonl", meta("t1", "t0"), tokens("2025-09-11T00:00:02Z", usage(7, 0, 0, 0)))
    write(root / "fork.jsonl", {"type": "session", "id": "y", "timestamp": "2025-09-11T05:00:00Z", "parentSession": "x"})
    appended(root / "a.jsonl", '{"unfinished', end="")
    read = []

    def range_lines(table):
        read.extend(tuple(r) for r in table.select("session_id", "start", "end").collect())
        return ranges.range_lines(table)

    parts, none = SimpleNamespace(examined=ranges.examined, range_lines=range_lines), "1 = 0"

    def refreshed(lines=none):
        chosen = selected_files(spark, [str(root)])
        return incremental.refresh(spark, selected_lines(spark, [str(root)], files=chosen).where(lines), chosen, store, parts=parts)

    def same():
        options = ReportOptions(roots=(str(root),))
        full = reports.daily_report(events_of(spark, options)[0], prices, options).collect()
        assert incremental.stored_report(spark, "daily", store, prices, options).collect() == full
        return sum(r.total for r in full)

    assert refreshed("1 = 1") == {"rebuild": 3} and same() == 12
    sizes = {n: os.path.getsize(root / f"{n}.jsonl") for n in ("a", "child", "fork")}
    whole = sizes["a"] - len('{"unfinished')
    appended(root / "a.jsonl", '":1}', tokens("2025-09-11T00:00:03Z", total=usage(30, 1, 5, 0)))
    appended(root / "child.jsonl", boundary, tokens("2025-09-12T00:00:04Z", usage(5, 0, 1, 0)))
    message = {"type": "message", "message": {"role": "assistant", "provider": "openai-codex", "model": "gpt-5", "usage": {"input": 4, "output": 1}}}
    appended(root / "fork.jsonl", message | {"timestamp": "2025-09-11T04:59:59Z"}, message | {"timestamp": "2025-09-11T05:00:00Z"})
    # no line is handed over, so all that is found comes from the new bytes and the stored states
    assert refreshed() == {"append": 3} and same() == 12 + 23 + 6 + 5
    assert sorted(read) == [("a", whole, os.path.getsize(root / "a.jsonl")), *((n, sizes[n], os.path.getsize(root / f"{n}.jsonl")) for n in ("child", "fork"))]
    assert refreshed() == {"cached": 3}
    states = {r.session_id: r for r in incremental.stored_states(spark, store).collect()}
    assert states["a"].model == "gpt-5.3-codex" and states["a"].carried.input == 30 and (states["child"].thread_id, states["child"].past_boundary) == ("t1", True)


def test_a_grown_file_with_another_start_is_rebuilt(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    filler = ['{"type":"other","n":"%060d"}' % i for i in range(200)]
    write(root / "a.jsonl", *filler, tokens("2025-09-11T00:00:01Z", usage(10, 0, 0, 0)), *filler)

    def refreshed():
        chosen = selected_files(spark, [str(root)])
        return incremental.refresh(spark, selected_lines(spark, [str(root)], files=chosen), chosen, store, parts=ranges)

    total = lambda: sum(r.total for r in incremental.stored_report(spark, "daily", store, built_in_prices(spark)).collect())
    assert refreshed() == {"rebuild": 1} and total() == 10
    text = (root / "a.jsonl").read_text()
    # same file object, first 4 KiB and size of the prefix, other last 4 KiB
    with open(root / "a.jsonl", "r+") as f:
        f.write(text.replace('"input_tokens":10', '"input_tokens":20').replace('%060d"}' % 199, '%060d"}' % 777) + text.splitlines()[200] + "\n")
    assert refreshed() == {"rebuild": 1} and total() == 30
    # another content of the same size and time
    stat = os.stat(root / "a.jsonl")
    with open(root / "a.jsonl", "r+") as f:
        f.write((root / "a.jsonl").read_text().replace('"input_tokens":20', '"input_tokens":40'))
    os.utime(root / "a.jsonl", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert refreshed() == {"rebuild": 1} and total() == 50
    assert refreshed() == {"cached": 1}


def test_one_of_two_commits_wins(spark, tmp_path):
    for n in range(50):
        won = []
        go = lambda: won.append(incremental.published(spark, f"{tmp_path}/commits/{n}", "x" * n + "!"))
        pair = [threading.Thread(target=go) for _ in range(2)]
        for t in pair:
            t.start()
        for t in pair:
            t.join()
        assert sorted(won) == [False, True]
        assert (tmp_path / f"commits/{n}").read_text() == "x" * n + "!"
    assert len(list((tmp_path / "commits").glob("_*"))) == 0


def test_dead_runs_are_not_read_and_vacuumed(spark, tmp_path):
    root, store = tmp_path / "logs", str(tmp_path / "store")
    for n in range(3):
        write(root / "a.jsonl", tokens("2025-09-11T00:00:01Z", usage(10 + n, 0, 0, 0)))
        chosen = selected_files(spark, [str(root)])
        assert incremental.refresh(spark, selected_lines(spark, [str(root)], files=chosen), chosen, store)["rebuild"] == 1
    live = incremental.manifest(spark, store).first().run
    plan = incremental.stored_sums(spark, store)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(run" in plan and live in plan
    folders = lambda: sorted(p.name for p in (tmp_path / "store/sums/tz=UTC").glob("run=*"))
    assert len(folders()) == 3 and incremental.vacuum(spark, store) == []  # a reader may still look at them
    gone = incremental.vacuum(spark, store, keep=timedelta(0), now=datetime.now(UTC) + timedelta(hours=2))
    assert len(gone) == 2 and folders() == [f"run={live}"]
    assert incremental.stored_report(spark, "daily", store, built_in_prices(spark)).first().total == 12


def test_snapshot_of_an_empty_store(spark, tmp_path):
    s = monitor.snapshot(spark, str(tmp_path / "none"), built_in_prices(spark), datetime(2025, 9, 11, 0, 30, tzinfo=UTC), ReportOptions())
    assert s["totals"].first()["total"] == 0 and s["rates"].first()["total_per_hour"] == 0 and s["models"].count() == 0 and s["history"].count() == 33


def test_monitor_follows_files(spark, tmp_path):
    root, store, prices = tmp_path / "logs", str(tmp_path / "store"), built_in_prices(spark)
    now = datetime(2025, 9, 11, 0, 30, tzinfo=UTC)
    write(root / "a.jsonl", context("gpt-5"), tokens("2025-09-11T00:10:00Z", usage(40, 10, 8, 2, 48)))

    def go():
        q = monitor.start(spark, str(root), store, prices, clock=lambda: now, once=True)
        q.awaitTermination(120)
        assert q.exception() is None
        return monitor.snapshot(spark, store, prices, now, ReportOptions())

    first = go()
    assert first["totals"].first()["total"] == 48
    rate = first["rates"].first()
    assert (rate.window_minutes, rate.input_per_hour, rate.total_per_hour) == (30, 80, 96)
    with open(root / "a.jsonl", "a") as f:
        f.write(__import__("json").dumps(tokens("2025-09-11T00:20:00Z", total=usage(50, 15, 10, 3, 60)), separators=(",", ":")) + "\n")
        f.write('{"unfinished')
    second = go()
    assert second["totals"].first()["total"] == 60 and second["rates"].first()["total_per_hour"] == 120
    write(root / "a.jsonl", tokens("2025-09-11T00:25:00Z", usage(1, 0, 1, 0, 2)))
    assert go()["totals"].first()["total"] == 2
    # the same size and first 4 KiB, another end
    filler = ['{"type":"other","n":"%060d"}' % i for i in range(200)]
    write(root / "b.jsonl", *filler, tokens("2025-09-11T00:26:00Z", usage(5, 0, 0, 0)))
    assert go()["totals"].first()["total"] == 2 + 5
    text = (root / "b.jsonl").read_text().replace('"input_tokens":5', '"input_tokens":6')
    (root / "b.jsonl").write_text(text + filler[0] + "\n")
    assert go()["totals"].first()["total"] == 2 + 6
    # a tick without new lines writes its snapshot too
    written = len(list((tmp_path / "store/snapshot/totals").glob("batch=*")))
    go()
    assert len(list((tmp_path / "store/snapshot/totals").glob("batch=*"))) == written + 1


def test_monitor_across_midnight(spark, tmp_path):
    root, store, prices = tmp_path / "logs", str(tmp_path / "store"), built_in_prices(spark)
    clock = SimpleNamespace(now=datetime(2025, 9, 11, 23, 50, tzinfo=UTC))

    def go():
        q = monitor.start(spark, str(root), store, prices, clock=lambda: clock.now, once=True)
        q.awaitTermination(200)
        assert q.exception() is None
        s = monitor.snapshot(spark, store, prices, clock.now, ReportOptions())
        return s["totals"].first()["total"], s["rates"].first()["total_per_hour"], sum(r.cost_usd_per_hour > 0 for r in s["history"].collect())

    days = lambda: sorted(p.name for p in (tmp_path / "store/events").glob("day=*"))
    # yesterday's, today's and a future event; the future one is hidden until now reaches it
    write(root / "a.jsonl", context("gpt-5"), tokens("2025-09-10T10:00:00Z", usage(1, 0, 0, 0)), tokens("2025-09-11T23:40:00Z", total=usage(31, 0, 0, 0)), tokens("2025-09-12T00:05:00Z", total=usage(41, 0, 0, 0)))
    total, rate, points = go()
    assert (total, rate, points > 0) == (30, 30, True) and days() == ["day=2025-09-11", "day=2025-09-12"]
    # after midnight the day starts anew, while the history still shows the evening before
    clock.now = datetime(2025, 9, 12, 0, 10, tzinfo=UTC)
    appended(root / "a.jsonl", tokens("2025-09-11T23:45:00Z", usage(8, 0, 0, 0)))  # late, into a day that is kept
    total, rate, later = go()
    assert (total, rate, later >= points) == (10, 60, True)
    clock.now = datetime(2025, 9, 11, 23, 59, tzinfo=UTC)
    assert monitor.snapshot(spark, store, prices, clock.now, ReportOptions())["totals"].first()["total"] == 38
    # a day later nothing of the old days is left, and late events of a day that is gone stay out
    clock.now = datetime(2025, 9, 13, 9, 0, tzinfo=UTC)
    appended(root / "a.jsonl", tokens("2025-09-11T23:46:00Z", usage(9, 0, 0, 0)), tokens("2025-09-13T08:59:00Z", usage(2, 0, 0, 0)))
    assert go()[0] == 2 and days() == ["day=2025-09-13"]
    with pytest.raises(ValueError):
        monitor.start(spark, str(root), store, prices, ReportOptions(since="20250101"))
