import datetime as dt

import pytest

from loomgrid.streaming import events as E

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture
def folder(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(k // 2 if k < 20 else k, base + dt.timedelta(minutes=(k // 2 if k < 20 else k) * 7), k // 2 % 3 if k < 20 else k % 3, "ab"[k % 2 if k >= 20 else 0], 1.0) for k in range(60)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return path


def collect(spark, stream, tmp_path, mode):
    name = f"t{abs(hash(str(tmp_path)))}"
    E.run_to_table(stream, name, str(tmp_path / "state"), mode)
    return spark.table(name)


def test_dedupe(spark, folder, tmp_path):
    stream = E.dedupe(E.read_folder(spark, folder, SCHEMA, 10), ["event_id"])
    assert collect(spark, stream, tmp_path, "append").count() == 50


def test_windows(spark, folder, tmp_path):
    stream = E.windowed(E.read_folder(spark, folder, SCHEMA, 10), "event_type", "value")
    got = collect(spark, stream, tmp_path, "complete")
    assert got.agg({"n": "sum"}).first()[0] == 60


def test_sessions(spark, folder, tmp_path):
    stream = E.sessions(E.read_folder(spark, folder, SCHEMA, 10), "user_id", "25 minutes")
    assert collect(spark, stream, tmp_path, "complete").agg({"n": "sum"}).first()[0] == 60


def test_contacts(spark, folder, tmp_path):
    stream = E.contacts_within(E.read_folder(spark, folder, SCHEMA, 10), "user_id", "event_id")
    got = {tuple(r)[1:] for r in collect(spark, stream, tmp_path, "append").collect()}
    assert got and all(a < b and a % 3 == b % 3 for a, b in got)
