"""Mean balances against a running balance in plain Python, the feature table's modes and
flags on small rows, and compiled trees against the fitted pipeline."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from retenta.operators import balances, features, model, trees

TX = "user_id long, monto double, fecha_hora timestamp_ntz, operacion string, tipo_operacion string"


def plain(rows):
    """(client, month) -> (opening, mean, closing, movements), and client -> mean."""
    until = max(r[2] for r in rows if r[2])
    out, means = {}, {}
    for user in {r[0] for r in rows if r[0] is not None}:
        moves = sorted((r[2], (1 if r[3] in balances.INFLOWS else -1) * round(r[1] * 100)) for r in rows if r[0] == user and r[1] is not None and r[2])
        if not moves:
            continue
        steps = [*(t for t, _ in moves[1:]), until]
        balance, pieces = 0, []
        for (t, c), to in zip(moves, steps):
            balance += c
            pieces.append((t, to, balance))
        whole = (until - moves[0][0]).total_seconds()
        means[user] = (sum(b * (y - x).total_seconds() for x, y, b in pieces) / whole if whole else balance) / 100
        month = moves[0][0].replace(day=1, hour=0, minute=0, second=0)
        while month <= until:
            after = (month + timedelta(days=32)).replace(day=1)
            first, last = max(month, moves[0][0]), min(after, until)
            area = sum(b * max((min(y, last) - max(x, first)).total_seconds(), 0) for x, y, b in pieces)
            closing = sum(c for t, c in moves if t < after)
            span = (last - first).total_seconds()
            inside = sum(month <= t < after for t, _ in moves)
            out[user, month.strftime("%Y-%m")] = (sum(c for t, c in moves if t < month) / 100, (area / span if span else closing) / 100, closing / 100, inside)
            month = after
    return out, means


def moves(seed, n, hot=0):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    ops = ["cashback", "compra", "transf_entrada", None, "retiro_cajero"]
    rows = []
    for i in range(n + hot):
        user = 99 if i >= n else rng.choice([1, 2, 3, 4, None])
        t = start + timedelta(seconds=rng.randrange(86400 * 200)) if rng.random() < 0.95 else None
        rows.append((user, rng.choice([None, 0.0, round(rng.random() * 1e6, 2)]) if rng.random() < 0.2 else round(rng.random() * 1000, 2), t, rng.choice(ops), rng.choice("ab")))
    rows += [(7, 10.0, start + timedelta(days=200), "cashback", "a")] * 2  # at the very end, twice
    return rows


@pytest.mark.parametrize("seed, n, hot", [(1, 60, 0), (2, 300, 0), (3, 200, 4000)])
def test_balances_equal_a_running_balance(spark, seed, n, hot):
    rows = moves(seed, n, hot)
    tx = spark.createDataFrame(rows, TX).repartition(5)
    months, means = plain(rows)
    got = {(r.user_id, r.mes): (r.saldo_inicial, r.saldo_medio, r.saldo_final, r.movimientos) for r in balances.monthly_balances(tx).collect()}
    assert got.keys() == months.keys()
    for key, want in months.items():
        assert got[key] == pytest.approx(want, rel=1e-9, abs=1e-6), key
    profile = {r.user_id: r.saldo_promedio for r in features.transaction_profile(tx).collect()}
    assert {u: m for u, m in profile.items() if m is not None} == pytest.approx(means, rel=1e-9)


def test_a_client_with_most_movements_is_summed_before_the_shuffle(spark):
    tx = spark.createDataFrame(moves(4, 50, 3000), TX)
    for df in (balances.monthly_balances(tx), features.transaction_profile(tx)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_sum" in plan and "Python" not in plan


def test_device_modes_from_json(spark):
    rows = [
        (1, "a", '{"k": 5}'), (1, "a", '{"k": "5"}'), (1, "b", '{"k": 7}'), (1, "b", '{"k":'), (1, None, None), (1, "b", "null"),
        (2, "z", '{"other": 1}'), (2, "y", '{"k": null}'), (2, "y", "[1]"), (2, "z", ""), (3, None, '{"k": {"a": 1}}'), (None, "a", '{"k": 1}'),
    ]
    talks = spark.createDataFrame(rows, "user_id long, input string, props string")
    got = {r.user_id: (r.input, r.dispositivo_moda) for r in features.conversation_profile(talks).collect()}
    assert got[1] == ("b", "5")  # b three times; 5 as a number and as text
    assert got[2] == ("y", None)
    assert got.keys() >= {1, 2} and None not in got


def test_flags_and_active_products(spark):
    rows = [(1, "p", "cuenta_debito", True), (1, "p", "seguro_vida", False), (1, "q", None, False), (2, None, "cuenta_debito", True), (None, "p", "seguro_vida", True)]
    held = spark.createDataFrame(rows, "user_id long, producto string, contrato string, activo boolean")
    got = {r.user_id: r for r in features.product_profile(held).collect()}
    assert (got[1].cuenta_debito, got[1].seguro_vida, got[1].credito_auto, got[1].num_productos_activos, got[1].categoria_mcc_moda) == (True, True, False, 1, "p")
    assert (got[2].cuenta_debito, got[2].num_productos_activos, got[2].categoria_mcc_moda) == (True, 0, None)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a, b, c = rng.random() * 10, rng.choice([None, 1.0, 2.0, 3.5]), rng.random() < 0.5
        rows.append((i, a, b, c, "CHURN" if a + (b or 0) * 2 > 7 and not c or rng.random() < 0.1 else "NO CHURN"))
    table = spark.createDataFrame(rows, "user_id long, a double, b double, c boolean, UsuarioChurn string")
    feats = [("a", "float64"), ("b", "float64"), ("c", "bool")]
    pipeline, _ = model.train_churn_model(table, feats, max_iter=6)
    return table, feats, pipeline


def test_compiled_trees_equal_the_pipeline(spark, fitted):
    table, feats, pipeline = fitted
    compiled = trees.from_pipeline(pipeline, [n for n, _ in feats])
    want = {r.user_id: r.proba for r in model.ml_scorer(pipeline, feats)(table).collect()}
    got = {r.user_id: r.proba for r in trees.scorer(compiled)(table).collect()}
    assert got == pytest.approx(want, rel=1e-12) and len(set(got.values())) > 10
    again = trees.Trees.from_json(compiled.to_json())
    assert again == compiled
    plan = trees.scorer(compiled)(table)._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan


def test_compiled_trees_as_sql(spark, fitted):
    table, feats, pipeline = fitted
    compiled = trees.from_pipeline(pipeline, [n for n, _ in feats])
    rows = [(r.user_id, r.a, r.b, r.c) for r in table.collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (user_id BIGINT, a DOUBLE, b DOUBLE, c BOOLEAN)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    sql = compiled.sql(lambda c: f"coalesce(CAST({c} AS DOUBLE), 0)")
    got = dict(con.execute(f"SELECT user_id, {sql} FROM t").fetchall())
    want = {r.user_id: r.proba for r in trees.scorer(compiled)(table).collect()}
    assert got == pytest.approx(want, rel=1e-12)


def test_a_model_with_hashed_categories_is_refused(spark, fitted):
    table, feats, _ = fitted
    with_text = table.withColumn("x", F.lit("y"))
    pipeline, _ = model.train_churn_model(with_text, [*feats, ("x", "string")], max_iter=1)
    with pytest.raises(ValueError):
        trees.from_pipeline(pipeline, ["a", "b", "c", "x"])


def test_the_stored_model_uses_the_models_own_features():
    stored = trees.stored()
    assert set(stored.features) <= {n for n, _ in model.FEATURES} and len(stored.trees) > 1
