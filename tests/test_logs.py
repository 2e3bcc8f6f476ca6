"""Golden cases over log files on disk."""

import json

import pytest

from meterloom.plans.api import build_report, events_of, session_file
from meterloom.schemas import ReportOptions
from meterloom.sources.files import inventory, selected_files


def usage(i, c, o, r, t=None):
    return {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r} | ({} if t is None else {"total_tokens": t})


def tokens(ts, last=None, total=None, **more):
    info = ({"last_token_usage": last} if last else {}) | ({"total_token_usage": total} if total else {}) | more
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": info}}


def context(model, ts="2025-09-11T00:00:00Z"):
    return {"timestamp": ts, "type": "turn_context", "payload": {"model": model}}


def meta(thread, parent=None, cwd=None):
    source = {"subagent": {"thread_spawn": {"parent_thread_id": parent}}} if parent else "cli"
    return {"timestamp": "2025-09-11T00:00:00Z", "type": "session_meta", "payload": {"id": thread, "source": source} | ({"cwd": cwd} if cwd else {})}


def write(path, *entries):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((e if isinstance(e, str) else json.dumps(e, separators=(",", ":"))) + "\n" for e in entries))


def rows(report):
    return report["rows"].collect()


def test_delta_then_cumulative(spark, tmp_path):
    write(
        tmp_path / "project/a.jsonl", context("gpt-5"), tokens("2025-09-11T18:25:40.670Z", usage(1200, 200, 500, 0, 1700), usage(1200, 200, 500, 0, 1700)),
        tokens("2025-09-12T00:00:00.000Z", total=usage(2000, 300, 800, 0, 2800)),
    )
    r = build_report(spark, "daily", ReportOptions(roots=(str(tmp_path), str(tmp_path / "gone"))))
    assert [(str(x.date), x.input, x.cached_input, x.output) for x in rows(r)] == [("2025-09-11", 1200, 200, 500), ("2025-09-12", 800, 100, 300)]
    assert r["totals"].first()["input"] == 2000 and r["missing_directories"] == [str(tmp_path / "gone")]
    assert [x.month for x in rows(build_report(spark, "monthly", ReportOptions(roots=(str(tmp_path),))))] == ["2025-09"]


def test_second_dialect_and_fork(spark, tmp_path):
    def message(ts, provider="openai-codex", **u):
        return {"type": "message", "timestamp": ts, "message": {"role": "assistant", "provider": provider, "model": "gpt-5", "usage": u}}

    first = message("2026-01-02T00:00:00Z", input=100, output=30, cacheRead=40, cacheWrite=10, reasoning=12, totalTokens=180)
    write(tmp_path / "p/a.jsonl", {"type": "session", "id": "x", "timestamp": "2026-01-02T00:00:00Z"}, first, message("2026-01-02T00:00:01Z", "other", input=9, output=9))
    write(
        tmp_path / "p/fork.jsonl", {"type": "session", "id": "y", "timestamp": "2026-01-03T00:00:00Z", "parentSession": "x"},
        message("2026-01-02T00:00:00Z", input=100, output=30), message("2026-01-03T00:00:00Z", input=20, output=5),
    )
    e = {(x.session_id, x.input, x.cached_input, x.output, x.reasoning_output, x.total) for x in events_of(spark, ReportOptions(roots=(str(tmp_path),)))[0].collect()}
    assert e == {("p/a", 150, 40, 30, 12, 180), ("p/fork", 20, 0, 5, 0, 25)}


def test_spawned_child_and_fold(spark, tmp_path):
    write(tmp_path / "project/parent.jsonl", meta("t0"), context("gpt-5"), tokens("2025-09-11T00:00:01Z", usage(100, 0, 10, 0, 110)))
    inherited = [tokens("2025-09-11T00:00:02Z", total=usage(100, 0, 10, 0, 110)), {"type": "inter_agent_communication_metadata", "payload": {}}]
    write(tmp_path / "project/child.jsonl", meta("t1", "t0"), meta("t0"), *inherited, tokens("2025-09-11T00:00:03Z", total=usage(120, 0, 12, 0, 132)))
    write(tmp_path / "loop1.jsonl", meta("l1", "l2"), {"type": "inter_agent_communication_metadata"}, tokens("2025-09-11T00:00:04Z", usage(5, 0, 0, 0)))
    write(tmp_path / "loop2.jsonl", meta("l2", "l1"), {"type": "inter_agent_communication_metadata"}, tokens("2025-09-11T00:00:05Z", usage(5, 0, 0, 0)))
    write(tmp_path / "orphan.jsonl", meta("o", "nobody"), {"type": "inter_agent_communication_metadata"}, tokens("2025-09-11T00:00:06Z", usage(5, 0, 0, 0)))
    options = ReportOptions(roots=(str(tmp_path),))
    child = [(x.input, x.output, x.total) for x in events_of(spark, options)[0].where("session_id = 'project/child'").collect()]
    assert child == [(20, 2, 22)]
    assert [(x.session_id, x.total) for x in rows(build_report(spark, "session", options))] == [("project/parent", 132), ("loop1", 5), ("loop2", 5), ("orphan", 5)]


def test_fallback_model_and_activity(spark, tmp_path):
    write(tmp_path / "legacy/session-legacy.jsonl", tokens("2025-01-15T23:00:30.000Z", usage(10, 0, 5, 0, 15)))
    r = rows(build_report(spark, "session", ReportOptions(roots=(str(tmp_path),), timezone="Europe/Warsaw")))[0]
    assert (r.directory, r.session_file, r.last_activity) == ("legacy", "session-legacy", "2025-01-16T00:00:30.000+01:00")
    assert r.models["gpt-5"].is_fallback and r.models["gpt-5"].fallback_input == 10


def test_duplicate_roots_project_and_cost(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    write(a / "p/s.jsonl", meta("t", cwd="/w/project"), context("gpt-5"), tokens("2025-09-11T00:00:01Z", usage(100, 0, 10, 0, 110)))
    write(b / "p/s.jsonl", meta("t", cwd="/w/project-x"), context("gpt-5"), tokens("2025-09-11T00:00:01Z", usage(100, 0, 10, 0, 110)), tokens("2025-09-11T00:00:02Z", usage(50, 0, 5, 0, 55)))
    both = ReportOptions(roots=(str(a), str(b)))
    assert [(x.input, x.total) for x in rows(build_report(spark, "daily", both))] == [(150, 165)]
    only = ReportOptions(roots=(str(a), str(b)), project="/w/./project/")
    assert [(x.input, x.total) for x in rows(build_report(spark, "daily", only))] == [(100, 110)]
    write(tmp_path / "c/s.jsonl", context("gpt-5"), tokens("2025-09-11T00:00:01Z", usage(1_000_000, 250_000, 100_000, 0, 1_100_000)))
    free = rows(build_report(spark, "daily", ReportOptions(roots=(str(tmp_path / "c"),), free_cached=True)))[0]
    assert (free.input, free.cached_input, free.cost_usd) == (1_000_000, 250_000, pytest.approx(1.9375))
    less = rows(build_report(spark, "daily", ReportOptions(roots=(str(tmp_path / "c"),), exclude_cached=True)))[0]
    assert (less.input, less.cached_input, less.total, less.cost_usd) == (750_000, 0, 850_000, pytest.approx(1.9375))


def test_lossy_records(spark, tmp_path):
    good = json.dumps(tokens("2025-09-11T00:00:01Z", usage(1, 0, 0, 0)), separators=(",", ":"))
    write(
        tmp_path / "s.jsonl", "", "{broken", good.replace("event_msg", "event\\u005fmsg"), good.replace('"type":', '"type": '), good.replace("2025-09-11T00:00:01Z", "never"),
        good.replace('"2025-09-11T00:00:01Z"', "7"), good.replace('"input_tokens":1', '"input_tokens":"5"'),
        json.dumps(tokens("2025-09-11T00:00:02Z", {"input_tokens": 9, "cached_input_tokens": -1, "cache_read_input_tokens": 4, "output_tokens": 1.5}), separators=(",", ":")),
        json.dumps(context(42), separators=(",", ":")), good.replace('"info":{', '"model":" m ","info":{"model":7,'),
    )
    e = events_of(spark, ReportOptions(roots=(str(tmp_path),)))[0].orderBy("seq").collect()
    assert [(x.input, x.cached_input, x.output, x.model) for x in e] == [(1, 0, 0, "gpt-5"), (9, 4, 0, "gpt-5"), (1, 0, 0, "m")]
    with pytest.raises(Exception, match="invalid timestamp"):
        events_of(spark, ReportOptions(roots=(str(tmp_path),), strict=True))[0].collect()


def test_invalid_utf8_is_an_error_only_if_strict(spark, tmp_path):
    good = json.dumps(tokens("2025-09-11T00:00:01Z", usage(1, 0, 0, 0)), separators=(",", ":")).encode()
    (tmp_path / "s.jsonl").write_bytes(good + b"\n" + good.replace(b"token_count", b"token_count\xff", 1) + b"\n" + b"\xff noise\n" + good.replace(b'"info"', b'"x":"\xff","info"') + b"\n")
    assert events_of(spark, ReportOptions(roots=(str(tmp_path),)))[0].count() >= 1
    with pytest.raises(Exception, match="not valid UTF-8"):
        events_of(spark, ReportOptions(roots=(str(tmp_path),), strict=True))[0].collect()


def test_empty_and_compressed_files(spark, tmp_path):
    import zstandard

    a = tmp_path / "logs"
    write(a / "p/root.jsonl", meta("t0"), context("gpt-5"), tokens("2025-09-11T00:00:01Z", usage(5, 0, 0, 0)))
    child = [meta("t1", "t0"), {"type": "inter_agent_communication_metadata"}, tokens("2025-09-11T00:00:02Z", usage(10, 0, 0, 0))]
    packed = zstandard.compress("".join(json.dumps(x, separators=(",", ":")) + "\n" for x in child).encode())
    (a / "p/child.JSONL.zst").write_bytes(packed)
    (a / "p/hidden.jsonl.ZST").write_bytes(packed)
    (a / "p/hidden.jsonl").write_text("")
    options = ReportOptions(roots=(str(a),))
    found = {(r.session_id, r.compressed): r.bytes for r in inventory(spark, [str(a)]).collect()}
    assert found[("p/hidden", False)] == 0 and len(found) == 4
    # the empty plain file hides its compressed sibling
    assert sorted(r.session_id for r in selected_files(spark, [str(a)]).collect()) == ["p/child.JSONL", "p/hidden", "p/root"]
    assert [(x.session_id, x.total) for x in rows(build_report(spark, "session", options))] == [("p/root", 15)]


def test_prices_do_not_compute_events_twice(spark):
    from meterloom.operators import reports
    from meterloom.plans import bindings as b

    plan = reports.daily_report(b.events(spark, "/root/testdata/sf0.001"), b.pricing(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [event_id") == 1 and len([x for x in plan.split("\n") if x.lstrip(" +-:").startswith("Window [")]) <= 4


def test_months_models_json_and_lookup(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    write(a / "p/s.jsonl", context("zeta"), tokens("2025-01-01T00:00:00Z", usage(2, 0, 0, 0)), context("alpha"), tokens("2024-12-31T23:59:59Z", usage(1, 0, 0, 0)), tokens("2025-01-05T00:00:00Z", usage(4, 0, 0, 0)))
    write(b / "p/s.jsonl", tokens("2024-11-30T00:00:00Z", usage(8, 0, 0, 0)))
    report = build_report(spark, "monthly", ReportOptions(roots=(str(a), str(b), str(tmp_path / "gone"))))
    assert [(r.month, r.total) for r in rows(report)] == [("2024-12", 1), ("2025-01", 6)]
    texts = [json.loads(r.value) for r in report["json"].collect()]
    assert [(t["kind"], t["row"]["month"], t["missing_directories"]) for t in texts] == [("monthly", m, [str(tmp_path / "gone")]) for m in ("2024-12", "2025-01")]
    assert list(texts[1]["row"]["models"]) == ["alpha", "zeta"] and "is_fallback" not in texts[1]["row"]["models"]["zeta"]
    # both bounds belong to the range, and days are those of the zone
    bounds = ReportOptions(roots=(str(a),), since="2024-12-31", until="20250101", timezone="Europe/Warsaw")
    assert [(str(r.date), r.total) for r in rows(build_report(spark, "daily", bounds))] == [("2025-01-01", 3)]
    # the larger copy across roots; no row for an unknown session
    options = ReportOptions(roots=(str(b), str(a)))
    assert [r.path for r in session_file(spark, options, "p/s").collect()] == [str(a / "p/s.jsonl")] and session_file(spark, options, "p/none").count() == 0


def test_other_agents_and_later_boundaries(spark, tmp_path):
    write(tmp_path / "legacy.jsonl", {"type": "session_meta", "payload": {"id": "legacy", "source": {"subagent": "review"}}}, context("gpt-5"), tokens("2026-01-02T00:01:00Z", usage(10, 0, 1, 0, 11)))
    boundary, at = {"type": "inter_agent_communication_metadata"}, "2026-01-02T00:0{}:00Z".format
    write(
        tmp_path / "spawned.jsonl", meta("s", "parent"), context("gpt-5"), tokens(at(2), total=usage(100, 0, 10, 0, 110)), boundary, tokens(at(3), total=usage(110, 0, 11, 0, 121)), boundary,
        tokens(at(4), total=usage(120, 0, 12, 0, 132)),
    )
    events = events_of(spark, ReportOptions(roots=(str(tmp_path),)))[0].orderBy("session_id", "seq").collect()
    assert [(e.session_id, e.total) for e in events] == [("legacy", 11), ("spawned", 11), ("spawned", 11)]


def test_files_are_pruned_by_time_and_links_followed_once(spark, tmp_path):
    import os

    write(tmp_path / "r/old.jsonl", context("m"))
    write(tmp_path / "r/x/y/z/new.jsonl", context("m"))
    write(tmp_path / "r/_hidden/s.jsonl", context("m"))
    os.symlink(tmp_path / "r/x", tmp_path / "r/x/y/loop")
    os.utime(tmp_path / "r/old.jsonl", (1_700_000_000, 1_700_000_000))
    found = lambda **more: sorted(r.session_id for r in inventory(spark, [str(tmp_path / "r")], **more).collect())
    assert found() == ["old", "x/y/z/new"] and found(modified_after="2024-01-01T00:00:00") == ["x/y/z/new"]


def test_large_files_are_read_in_segments(spark, tmp_path):
    entries = [context("m1"), *[tokens(f"2025-09-11T00:{i // 60 % 60:02d}:{i % 60:02d}Z", total=usage(i + 1, 0, 0, 0)) for i in range(3000)]]
    write(tmp_path / "s.jsonl", *entries)
    options, key = ReportOptions(roots=(str(tmp_path),)), "spark.sql.files.maxPartitionBytes"
    want = rows(build_report(spark, "daily", options))
    spark.conf.set(key, "64k")
    try:
        events, lines = events_of(spark, options)
        assert lines.select("seq.block_start").distinct().count() > 4
        assert rows(build_report(spark, "daily", options)) == want and want[0].total == 3000 and events.where("model <> 'm1'").count() == 0
    finally:
        spark.conf.unset(key)


def test_options():
    with pytest.raises(ValueError):
        ReportOptions(last_days=2, since="20250101")
    with pytest.raises(Exception):
        ReportOptions(timezone="Nowhere/City")
    assert ReportOptions(exclude_cached=True).cached_is_free


def test_only_headers_are_asked_whether_they_are_first(spark):
    from pyspark.sql import functions as F

    from meterloom.functions import parse

    escaped = '{"timestamp":"2024-01-01T00:00:00Z","type":"session\\u005fmeta","payload":{"id":"t0","source":{"subagent":{"thread_spawn":{"parent_thread_id":"p"}}}}}'
    late = escaped.replace("\\u005f", "_").replace("t0", "t1")
    pad = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.sha2(F.concat("id", i).cast("binary"), 256)))
    usage = F.concat(F.lit('{"timestamp":"2024-01-01T00:00:01Z","type":"event_msg","payload":{"type":"token_count","model":"'), pad, F.lit('","last_token_usage":{"input_tokens":3}}}'))
    lines = spark.range(2, 1002).select((F.col("id") % 5).cast("string").alias("session_id"), F.col("id").alias("seq"), usage.alias("value"))
    lines = lines.unionByName(spark.createDataFrame([("0", 1, escaped), ("0", 2000, late), ("1", 2001, late)], "session_id string, seq long, value string"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        rows = parse.records(lines, headers=True).collect()
        assert written() - before < 200_000  # of 1.9 MB of lines
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(rows) == 1003 and sum(r.last is not None for r in rows) == 1000
    assert [(r.session_id, r.seq, r.thread_id) for r in rows if r.is_spawned] == [("0", 1, "t0")]
    assert [r.seq for r in rows if r.thread_id] == [1]
