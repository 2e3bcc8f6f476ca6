"""Price lists, snapshots and the choice between them."""

import json

from meterloom.operators.pricing import built_in_prices, latest_snapshot, merged_prices, prices_from_list, refresh_is_due, save_snapshot, stored_snapshots, with_prices


def test_price_list(spark):
    document = {"m": {"input_cost_per_token": 1e-6, "output_cost_per_token": 4e-6}, "free": {"input_cost_per_token": 0}, "text": "x", "c": {"input_cost_per_token": 2e-6, "cache_read_input_token_cost": 5e-7}}
    got = {r.model: tuple(round(x, 6) for x in r[1:]) for r in prices_from_list(spark.createDataFrame([(json.dumps(document),)], "value string")).collect()}
    assert got == {"m": (1.0, 1.0, 4.0), "c": (2.0, 0.5, 0.0)}


def test_snapshots_are_added_and_chosen_by_age(spark, tmp_path):
    path, day = str(tmp_path / "prices"), 86_400
    none = stored_snapshots(spark, path)
    assert refresh_is_due(none, 0) and not refresh_is_due(none, 0, offline=True)
    first = spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("gpt-5", 9.0, 9.0, 9.0)], built_in_prices(spark).schema)
    save_snapshot(first, path, 1000)
    save_snapshot(first.where("model = 'a'"), path, 2000)
    kept = stored_snapshots(spark, path)
    assert [(r.model, r.is_stale) for r in latest_snapshot(kept, 2000 + day).collect()] == [("a", False)]
    assert not refresh_is_due(kept, 2000 + day) and refresh_is_due(kept, 2001 + day) and not refresh_is_due(kept, 0)
    assert refresh_is_due(kept, 2000, forced=True) and not refresh_is_due(kept, 2001 + day, offline=True, forced=True)
    merged = {r.model: r.input_cost_per_mtoken for r in merged_prices(first, built_in_prices(spark)).collect()}
    assert merged == {"a": 1.0, "gpt-5": 9.0, "gpt-5-codex": 1.25, "gpt-5.2-codex": 1.25}


def test_candidates_in_order(spark):
    names = [" openai/gpt-5 ", "azure/gpt-5-codex", "gpt-5.3-codex", "openrouter/openai/x", "openrouter/free", "openrouter/y:FREE", "x", "openai/azure/z", "nothing"]
    rows = spark.createDataFrame([(n,) for n in names], "model string")
    prices = [*[tuple(r) for r in built_in_prices(spark).collect()], ("openai/gpt-5", 2.0, 2.0, 2.0), ("azure/x", 3.0, 3.0, 3.0), ("azure/z", 4.0, 4.0, 4.0), ("openrouter/free", 5.0, 5.0, 5.0)]
    got = {r.model: r.input_cost_per_mtoken for r in with_prices(rows, spark.createDataFrame(prices, built_in_prices(spark).schema)).collect()}
    assert got == {" openai/gpt-5 ": 2.0, "azure/gpt-5-codex": 1.25, "gpt-5.3-codex": 1.25, "openrouter/openai/x": 3.0, "openrouter/free": 0.0, "openrouter/y:FREE": 0.0, "x": 3.0, "openai/azure/z": 4.0, "nothing": 0.0}
