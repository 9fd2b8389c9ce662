"""The streaming monthly rollup equals the batch rollup, also across restarts."""

from pyspark.sql import functions as F

from retenta.sources import fixtures as fx
from retenta.streaming import monthly_rollup as S

SF = "/root/testdata/sf0.001"


def _month(c):
    return F.trunc(F.col(c).cast("date"), "month")


def test_stream_matches_batch_across_restarts(spark, tmp_path):
    src, conv_src = str(tmp_path / "src"), str(tmp_path / "conv")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    tx = fx.transactions(spark, SF)
    conv = fx.conversations(spark, SF).select("user_id", "date", "input")
    # two arrivals: older orders first, then the rest and the conversations
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    tx.filter(F.col("fecha_hora") < cut).write.mode("append").parquet(src)
    conv.limit(0).write.mode("append").parquet(conv_src)
    S.start_monthly_rollup(spark, src, out, ckpt, conversations_dir=conv_src).awaitTermination()
    tx.filter(F.col("fecha_hora") >= cut).write.mode("append").parquet(src)
    conv.write.mode("append").parquet(conv_src)
    S.start_monthly_rollup(spark, src, out, ckpt, conversations_dir=conv_src).awaitTermination()  # restart

    got = {
        r.mes: (round(r.monto_total, 2), r.num_transacciones, r.num_inputs)
        for r in S.current_totals(spark, out).collect()
    }
    cents = F.round(F.col("monto") * 100).cast("long")
    tx_m = {r.mes: (r.c, r.n) for r in tx.groupBy(_month("fecha_hora").alias("mes")).agg(
        F.sum(cents).alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    conv_m = {r.mes: r.n for r in conv.groupBy(_month("date").alias("mes")).agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {
        m: (round((tx_m.get(m, (0, 0))[0] or 0) / 100.0, 2), tx_m.get(m, (0, 0))[1], conv_m.get(m, 0))
        for m in set(tx_m) | set(conv_m)
    }
    assert got == want and len(got) > 12
