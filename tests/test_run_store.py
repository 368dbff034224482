"""Versions of tables, and runs kept as headers and forecast rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoloom.sources.runs import RunStore
from chronoloom.sources.versions import ConcurrentCommitError, Versions
from chronoloom.spec import AIR_QUALITY, PanelValidationError

SPEC = AIR_QUALITY.but(targets=("pm2_5",), drivers=("temperature",))
HEADS = "run_id string, user_id bigint, timestamp string, model_used string"
ROWS = "run_id string, time timestamp_ntz, pm2_5_pred double, pm2_5_actual double"


def runs(spark, *rows):
    return spark.createDataFrame([(i, u, t, "LSTM") for i, u, t in rows], HEADS)


def ahead(spark, *ids, n=3):
    return spark.createDataFrame([(i, float(k), k + 1.0) for i in ids for k in range(n)], "run_id string, pm2_5_pred double, pm2_5_actual double")


@pytest.fixture()
def store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"), SPEC)
    first = runs(spark, ("a", 1, "2026-01-05T08:00:00+00:00"), ("b", 1, "2026-02-01T00:00:00+00:00"), ("c", 2, "no date"))
    assert store.append(first, ahead(spark, "a", "b", "c")) == 1
    return store


def ids(df):
    return sorted(r["run_id"] for r in df.collect())


def test_both_tables_appear_together(spark, store):
    before = store.view()
    staged = store.stage(runs(spark, ("d", 1, "2026-03-01T00:00:00+00:00")), ahead(spark, "d"))
    # Written, but of no version: what a writer that died here leaves behind.
    assert ids(store.view().runs()) == ["a", "b", "c"] and store.view().forecast_rows().count() == 9
    assert store.versions.append(staged) == 2
    assert ids(store.view().runs()) == ["a", "b", "c", "d"] and store.view().forecast_rows().count() == 12
    assert ids(before.runs()) == ["a", "b", "c"] and before.forecast_rows().count() == 9


def test_readers_keep_their_version(spark, store):
    views = [store.view()]
    store.delete_runs(spark.createDataFrame([(1, "a"), (1, "c")], "user_id bigint, run_id string"))  # c is another user's
    views.append(store.view())
    store.delete_users(spark.createDataFrame([(2,)], "user_id bigint"))
    views.append(store.view())
    store.compact()
    views.append(store.view())
    assert [ids(v.runs()) for v in views] == [["a", "b", "c"], ["b", "c"], ["b"], ["b"]]
    assert [v.forecast_rows().count() for v in views] == [9, 6, 3, 3]
    assert [v.version for v in views] == [1, 2, 3, 4] and ids(store.view(1).runs()) == ["a", "b", "c"]
    assert "gone" not in store.versions.manifest(4)
    # A user who comes back starts anew.
    store.append(runs(spark, ("e", 2, "2026-05-01T00:00:00+00:00")), ahead(spark, "e"))
    assert ids(store.view().runs(2)) == ["e"]


def test_filters_and_pruning(spark, store):
    view = store.view()
    assert ids(view.runs(1)) == ["a", "b"] and ids(view.runs(start_date="2026-01-06")) == ["b"]
    assert ids(view.runs(end_date="2026-01-31")) == ["a"] and ids(view.runs(model_used="XGBoost")) == []
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    rows = view.forecast_rows(1, "2026-02-01", "2026-02-28")
    assert ids(rows) == ["b"] * 3 and set(rows.columns) >= {"pm2_5_pred", "pm2_5_actual", "model_used", "user_id", "temperature_used"}
    text = rows._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.split("\n") if "PartitionFilters" in line and "month" in line]
    assert len(scans) >= 2 and all("month#" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)
    assert all("EqualTo(user_id,1)" in s for s in scans)


def test_refused_batches(spark, store):
    good = runs(spark, ("x", 1, "2026-01-01T00:00:00+00:00"))
    with pytest.raises(PanelValidationError, match="label"):
        store.append(good.withColumn("model_used", F.lit(" ")), ahead(spark, "x"))
    with pytest.raises(PanelValidationError, match="differ"):
        store.append(good.union(good), ahead(spark, "x"))
    with pytest.raises(PanelValidationError, match="without a run"):
        store.append(good, ahead(spark, "x", "y"))
    with pytest.raises(PanelValidationError, match="model_used"):
        store.append(good.drop("model_used"), ahead(spark, "x"))
    assert store.versions.head() == 1
    store.append(good.drop("timestamp"), ahead(spark, "x", n=0))
    row = store.view().runs(1, start_date="2026-03-01").filter("run_id = 'x'").first()
    assert row["timestamp"].endswith("+00:00") and row["inserted_seq"] > 0


def test_settings(spark, store):
    put = lambda u, m: store.put_settings(spark.createDataFrame([(u, m)], "user_id bigint, default_model string"))
    put(1, "XGBoost")
    put(2, "ARIMA")
    put(1, "LSTM")
    assert {r.user_id: r.default_model for r in store.view().settings().collect()} == {1: "LSTM", 2: "LSTM"}
    store.delete_users(spark.createDataFrame([(1,)], "user_id bigint"))
    store.compact()
    assert [r.user_id for r in store.view().settings().collect()] == [2]


def test_writers_take_turns(spark, tmp_path):
    one, two = (Versions(spark, str(tmp_path / "v")) for _ in range(2))
    seen = []

    def late(now):
        # While this change is made another writer commits.
        if not seen:
            two.append({"t": two.stage("t", spark.range(2))})
        seen.append(dict(now))
        return now | {"t": [*now.get("t", []), path]}

    path = one.stage("t", spark.range(10, 13))
    assert one.commit(late) == 2 and len(seen) == 2 and len(seen[1]["t"]) == 1
    assert sorted(r.id for r in one.read("t", "id long", 2).collect()) == [0, 1, 10, 11, 12]
    with pytest.raises(ConcurrentCommitError):
        one.replace({}, ("t",), base=1)
    assert one.replace({}, ("t",), base=2) == 3 and one.read("t", "id long", 3).count() == 0
    assert one.read("t", "id long, later string", 1).columns == ["id", "later"]


def exchanges(df):
    """Shuffles of a plan by what they deal on, before anything runs."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.split("\n") if "Exchange hashpartitioning" in line]


def test_compact_shuffles_rows_once(spark, store, monkeypatch):
    """Rows meet the runs that are left by place: one shuffle, on the place, and none on the run."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.delete_runs(spark.createDataFrame([(1, "a"), (1, "c")], "user_id bigint, run_id string"))
        # The same id in another place: its rows belong to a run that is left, wherever they lie.
        store.append(runs(spark, ("a", 3, "2026-07-01T00:00:00+00:00")), ahead(spark, "a"))
        staged = []
        stage = Versions.stage
        monkeypatch.setattr(Versions, "stage", lambda self, name, df, *a, **k: (staged.append((name, df)), stage(self, name, df, *a, **k))[1])
        before = ids(store.view().forecast_rows())
        store.compact()
        assert ids(store.view().forecast_rows()) == before == ["a"] * 6 + ["b"] * 3 + ["c"] * 3
        kept = dict(staged)["forecast_rows"]
        moved = [line for line in exchanges(kept) if "pm2_5_pred" in line or "month" in line]
        assert len(moved) == 1 and "user_bucket" in moved[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_places_too_large_for_a_task(spark, store, monkeypatch):
    monkeypatch.setattr("chronoloom.sources.runs.PLACE_ROWS", 2)
    store.append(runs(spark, *[(f"n{i}", 1, "2026-01-09T00:00:00+00:00") for i in range(20)]), ahead(spark, *[f"n{i}" for i in range(20)]))
    store.delete_runs(spark.createDataFrame([(1, f"n{i}") for i in range(0, 20, 2)], "user_id bigint, run_id string"))
    before = ids(store.view().forecast_rows())
    store.compact()
    assert ids(store.view().forecast_rows()) == before and len(before) == 9 + 30


def test_runs_are_shuffled_by_run_alone(spark, store):
    store.delete_runs(spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "user_id bigint, run_id string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = store.view()
        assert ids(view.runs()) == ["b", "c"]
        dealt = [line.split("hashpartitioning(")[1].split(",")[0] for line in exchanges(view.runs())]
        assert dealt and all(d.startswith(("run_id", "_run")) for d in dealt)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
