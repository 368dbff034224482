"""Uploads with unlike headers and odd names, read in one scan."""

from __future__ import annotations

from frames import hourly

from chronoloom.plans import prepare
from chronoloom.queries import panels as P
from chronoloom.sources import csv
from chronoloom.spec import AIR_QUALITY


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)


def test_headers_and_names(spark, tmp_path):
    up = tmp_path / "up loads"
    write(up, "a b.csv", "time,pm10,pm2_5\nt1,1,2\n\nt2,3\n")
    write(up, "x/c.csv", "PM2_5, Time ,note\n5,t1,\"q, \"\"r\"\"\"\n")
    write(up, "y/c.csv", "time\nt9\n")
    write(up, "z[1]+%20.csv", "pm10,pm10,time\r\n7,8,t7\r\n", "utf-8-sig")
    write(up, "empty.csv", "")
    write(up, "head only.csv", "time,pm10\n")
    out = csv.read_uploads(spark, str(up), AIR_QUALITY)
    got = {(r.series_id, r.time, r.pm10, r.pm2_5, r.note) for r in out.collect()}
    assert got == {
        ("a b", "t1", "1", "2", None), ("a b", "t2", "3", None, None), ("x/c", "t1", None, "5", 'q, "r"'),
        ("y/c", "t9", None, None, None), ("z[1]+%20", "t7", "7", None, None),
    }
    assert set(out.columns) == {"time", "pm10", "pm2_5", "note", "series_id", "row_order"}


def test_rows_keep_their_order_over_splits(spark, tmp_path):
    text = "time,pm10\n" + "".join(f"t{i},{i}\n" for i in range(30_000))
    write(tmp_path / "u", "long.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        out = csv.read_uploads(spark, str(tmp_path / "u"), AIR_QUALITY)
        assert out.rdd.getNumPartitions() > 2
        rows = out.orderBy("row_order").select("pm10").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r.pm10) for r in rows] == list(range(30_000))


def test_flow_and_no_product(spark, tmp_path):
    up = tmp_path / "up"
    for name, seed in (("north one.csv", 1), ("sub/south.csv", 2)):
        write(up, name, hourly(seed=seed).drop(columns="series_id").to_csv(index=False))
    write(up, "empty.csv", "")
    out = prepare.prepare_upload(csv.read_uploads(spark, str(up), AIR_QUALITY), AIR_QUALITY, order="row_order")
    assert {r.series_id: r.n_past for r in out.header.collect()} == {"north one": 60, "sub/south": 60}
    panel = csv.read_panel_csv(spark, str(up / "north one.csv"), P.WIDE, "north")
    ends = panel.groupBy("series_id").agg({"time": "max"})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = panel.join(ends, "series_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Product" not in plan and "NestedLoop" not in plan
    assert {r.series_id for r in panel.select("series_id").distinct().collect()} == {"north"}


def test_empty_folder_of_uploads(spark, tmp_path):
    write(tmp_path / "u", "nothing.csv", "")
    out = csv.read_uploads(spark, str(tmp_path / "u"), AIR_QUALITY)
    assert out.count() == 0 and "series_id" in out.columns
