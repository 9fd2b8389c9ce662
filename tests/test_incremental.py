"""Incremental loads against the rollup over all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from retenta.operators import incremental, rollups, scoring

TX, CONV = "user_id long, monto double, fecha_hora timestamp_ntz", "user_id long, date timestamp_ntz"


def batch(spark, seed, n=200):
    rng = random.Random(seed)
    day = lambda: datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(600 * 1440))
    tx = [(rng.choice([None, 1, 1, 1, *range(2, 30)]), rng.choice([None, round(rng.random() * 1e4, 2)]), day()) for _ in range(n)]
    tx.append((None, 1.0, datetime(2025, 8, 20) + timedelta(days=200 * seed)))  # the last of all has no client
    return spark.createDataFrame(tx, TX), spark.createDataFrame([(1, day()) for _ in range(n // 2)], CONV)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_batches_equal_one_load_and_replays_do_nothing(spark, tmp_path, monkeypatch):
    tx_dir, conv_dir, state = (str(tmp_path / x) for x in ("tx", "conv", "state"))

    def check():
        tx, conv = spark.read.parquet(tx_dir), spark.read.parquet(conv_dir)
        assert rows(incremental.monthly_kpis(spark, state)) == rows(rollups.monthly_kpis(tx, conv))
        whole = scoring.transaction_summary(tx).select("user_id", "total_tx", "monto_total", F.col("ultima_tx").cast("timestamp_ntz").alias("ultima_tx"))
        assert rows(incremental.client_summary(spark, state)) == rows(whole)

    for i in range(3):
        tx, conv = batch(spark, i)
        tx.repartition(2).write.mode("append").parquet(tx_dir)
        if i != 1:
            conv.coalesce(1).write.mode("append").parquet(conv_dir)
        assert incremental.load_new(spark, state, tx_dir, conv_dir) == (2 if i == 1 else 3)
        check()
        assert incremental.load_new(spark, state, tx_dir, conv_dir) == 0
    assert incremental.manifest(spark, state).count() == 8

    # a load that breaks off before its manifest entry: its share doesn't count, and is redone
    batch(spark, 9)[0].coalesce(1).write.mode("append").parquet(tx_dir)
    before = rows(incremental.monthly_kpis(spark, state))
    made = type(spark).createDataFrame

    def broken(self, data, schema=None, *a, **b):
        if schema == incremental.MANIFEST and data:
            raise RuntimeError("lost")
        return made(self, data, schema, *a, **b)

    monkeypatch.setattr(type(spark), "createDataFrame", broken)
    with pytest.raises(RuntimeError):
        incremental.load_new(spark, state, tx_dir, conv_dir)
    monkeypatch.undo()
    assert rows(incremental.monthly_kpis(spark, state)) == before
    assert incremental.load_new(spark, state, tx_dir, conv_dir) == 1
    check()


def test_a_later_load_reads_the_new_files_only(spark, tmp_path):
    tx_dir, conv_dir, state = (str(tmp_path / x) for x in ("tx", "conv", "state"))
    tx, conv = batch(spark, 1)
    tx.write.parquet(tx_dir)
    conv.write.parquet(conv_dir)
    incremental.load_new(spark, state, tx_dir, conv_dir)
    first = {r.file for r in incremental.manifest(spark, state).collect()}
    tx.limit(5).coalesce(1).write.mode("append").parquet(tx_dir)
    assert incremental.load_new(spark, state, tx_dir, conv_dir) == 1
    last = incremental.manifest(spark, state).filter("batch = 2").collect()
    assert len(last) == 1 and last[0].file not in first and last[0].kind == "tx"


def test_no_files_at_all(spark, tmp_path):
    for name, schema in (("tx", TX), ("conv", CONV)):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    incremental.load_new(spark, str(tmp_path / "state"), str(tmp_path / "tx"), str(tmp_path / "conv"))
    assert incremental.monthly_kpis(spark, str(tmp_path / "state")).count() == 0
    assert incremental.monthly_kpis(spark, str(tmp_path / "other")).count() == 0
