"""Property tests (hypothesis): bounded score, pages partition the set, pivot totals."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retenta.functions import expr as X
from retenta.operators import lookup, monthly

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(
    st.lists(
        st.tuples(
            st.integers(0, 400),
            st.one_of(st.none(), st.integers(1, 10)),
            st.integers(0, 12),
            st.one_of(st.none(), st.integers(0, 2000)),
        ),
        min_size=1,
        max_size=200,
    )
)
def test_score_is_between_0_and_100_for_ratings_1_to_10(spark, rows):
    df = spark.createDataFrame(rows, "login long, sat long, prods long, days long")
    got = [r[0] for r in df.select(X.churn_score("login", "sat", "prods", "days")).collect()]
    assert all(0.0 <= s <= 100.0 for s in got)


@SETTINGS
@given(st.integers(1, 60), st.integers(1, 25), st.lists(st.integers(61, 100), min_size=60, max_size=60))
def test_pages_partition_the_matches(spark, n, size, scores):
    rows = [(i, "E", float(scores[i]), "Alto") for i in range(n)]
    scored = spark.createDataFrame(rows, "user_id long, estado string, churn_score double, riesgo string")
    pages = -(-n // size)
    ids = []
    for p in range(1, pages + 1):
        ids += [r.user_id for r in lookup.high_risk_page(scored, page=p, page_size=size).collect()]
    assert sorted(ids) == list(range(n))
    # order: score desc, then id
    expected = [i for i, _ in sorted(((i, scores[i]) for i in range(n)), key=lambda t: (-t[1], t[0]))]
    assert ids == expected


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 12), st.sampled_from(["a", "b", "c"]), st.integers(0, 10**9)), min_size=1, max_size=40))
def test_pivot_total_is_sum_of_cells(spark, rows):
    data = [(dt.date(2024, m, 1), k, v / 100.0) for m, k, v in rows]
    top = spark.createDataFrame(data, "month date, tipo_operacion string, monto double")
    out = monthly.operations_pivot(top, ["a", "b", "c"]).collect()
    for r in out:
        cents = {k: 0 for k in "abc"}
        for m, k, v in rows:
            if f"2024-{m:02d}" == r.mes_clave:
                cents[k] += v
        assert abs(r.total - round(sum(cents.values()) / 100 / 1e6, 2)) < 0.0051
        assert abs(r.total - (r.a + r.b + r.c)) < 0.0151


@SETTINGS
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.integers(0, 5)), min_size=1, max_size=120),
    st.integers(1, 12),
)
def test_salted_top_rows_per_key_equals_plain_window(spark, rows, k):
    from pyspark.sql import Window

    df = spark.createDataFrame(rows, "key long, a long, b long")
    order = [F.col("a").desc(), F.col("b").asc()]
    old = lookup.GROUP_LIMIT_THRESHOLD
    lookup.GROUP_LIMIT_THRESHOLD = 0  # force the salted path
    try:
        got = lookup.top_rows_per_key(df, "key", order, k, salts=4)
    finally:
        lookup.GROUP_LIMIT_THRESHOLD = old
    w = Window.partitionBy("key").orderBy(*order)
    want = df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    # rows tied on (a, b) are interchangeable: compare the multiset of (key, pos, a, b)
    norm = lambda d: sorted(tuple(r) for r in d.select("key", "pos", "a", "b").collect())
    assert norm(got) == norm(want)


def _half_even(x, digits):
    from decimal import ROUND_HALF_EVEN, Decimal

    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN))


def _score_py(login, sat, prods, days):
    """The churn score rules, written as plain Python."""
    if login is None or prods is None:
        return None
    clip = lambda v, lo, hi: min(max(v, lo), hi)
    s = clip(login, 0, 90) / 90.0 * 35.0
    s += (10.0 - (5.0 if sat is None else float(sat))) / 9.0 * 25.0
    s += (5.0 - clip(prods, 0, 5)) / 5.0 * 20.0
    s += clip(90 if days is None else days, 0, 90) / 90.0 * 20.0
    return _half_even(s, 1)


@SETTINGS
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.integers(-10, 400)),
            st.one_of(st.none(), st.integers(0, 12)),
            st.one_of(st.none(), st.integers(-3, 12)),
            st.one_of(st.none(), st.integers(-5, 2000)),
        ),
        min_size=1,
        max_size=200,
    )
)
def test_score_equals_plain_python_rules(spark, rows):
    df = spark.createDataFrame(rows, "login long, sat long, prods long, days long")
    got = [r[0] for r in df.select(X.churn_score("login", "sat", "prods", "days")).collect()]
    assert got == [_score_py(*r) for r in rows]


def _pct_py(actual, previous):
    if previous == 0:
        return 100.0 if actual > 0 else 0.0
    return _half_even((actual - previous) / abs(previous) * 100.0, 1)


@SETTINGS
@given(st.lists(st.tuples(st.integers(-10**6, 10**6), st.integers(-10**6, 10**6)), min_size=1, max_size=200))
def test_pct_change_equals_plain_python_rule(spark, rows):
    data = [(float(a), float(p)) for a, p in rows]
    df = spark.createDataFrame(data, "a double, p double")
    got = [r[0] for r in df.select(X.pct_change("a", "p")).collect()]
    assert got == [_pct_py(a, p) for a, p in data]


@SETTINGS
@given(
    st.lists(
        st.tuples(st.one_of(st.none(), st.integers(1, 6)), st.integers(1, 10**6), st.integers(0, 900)),
        min_size=1,
        max_size=80,
    ),
    st.lists(st.integers(0, 900), max_size=30),
)
def test_monthly_kpis_equal_plain_python(spark, txs, convs):
    from collections import defaultdict

    from retenta.operators import rollups

    base = dt.datetime(2023, 1, 1)
    tx_rows = [(u, cents / 100.0, base + dt.timedelta(days=d), "op") for u, cents, d in txs]
    conv_rows = [(1, base + dt.timedelta(days=d), "x") for d in convs]
    tx = spark.createDataFrame(tx_rows, "user_id long, monto double, fecha_hora timestamp_ntz, tipo_operacion string")
    conv = spark.createDataFrame(conv_rows, "user_id long, date timestamp_ntz, input string")
    got = {
        r.mes: (round(r.monto_total, 2), r.num_inputs, r.nuevos_churn, r.num_transacciones)
        for r in rollups.monthly_kpis(tx, conv).collect()
    }

    month = lambda t: dt.date(t.year, t.month, 1)
    want = defaultdict(lambda: [0, 0, 0, 0])
    for _, cents, d in txs:
        m = want[month(base + dt.timedelta(days=d))]
        m[0] += cents
        m[3] += 1
    for d in convs:
        want[month(base + dt.timedelta(days=d))][1] += 1
    fecha_max = base + dt.timedelta(days=max(d for _, _, d in txs))
    last = {}
    for u, _, d in txs:
        if u is not None:
            last[u] = max(last.get(u, d), d)
    for d in last.values():
        churn_at = base + dt.timedelta(days=d + 181)
        if churn_at <= fecha_max:
            want[month(churn_at)][2] += 1
    expected = {m: (round(v[0] / 100.0, 2), v[1], v[2], v[3]) for m, v in want.items()}
    assert got == expected


@SETTINGS
@given(
    st.lists(st.tuples(st.integers(1, 4), st.integers(0, 20), st.integers(1, 5)), min_size=1, max_size=60),
    st.integers(1, 4),
    st.integers(1, 5),
)
def test_transaction_pages_equal_plain_python(spark, rows, page, size):
    base = dt.datetime(2024, 1, 1)
    data = [(u, float(m), base + dt.timedelta(days=d), "op") for u, d, m in rows]
    tx = spark.createDataFrame(data, "user_id long, monto double, fecha_hora timestamp_ntz, tipo_operacion string")
    got = sorted(
        (r.user_id, r.pos, r.monto, r.fecha_hora, r.total, r.pages)
        for r in lookup.transaction_pages(tx, page=page, page_size=size).collect()
    )
    want = []
    for u in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == u), key=lambda r: (-r[2].timestamp(), -r[1]))
        total = len(mine)
        for i, r in enumerate(mine[(page - 1) * size : page * size]):
            pos = (page - 1) * size + i + 1
            want.append((u, pos, r[1], r[2].strftime("%Y-%m-%d %H:%M:%S"), total, -(-total // size)))
    assert got == sorted(want)


@SETTINGS
@given(
    st.lists(
        st.tuples(st.integers(0, 130), st.one_of(st.none(), st.integers(-10**5, 10**7)), st.booleans()),
        min_size=1,
        max_size=80,
    )
)
def test_age_profile_equals_plain_python(spark, rows):
    from decimal import ROUND_HALF_EVEN, Decimal

    from retenta.operators import segments

    data = [(i, age, None if c is None else c / 100.0, "CHURN" if ch else "NO CHURN") for i, (age, c, ch) in enumerate(rows)]
    df = spark.createDataFrame(data, "user_id long, edad long, ingreso_mensual_mxn double, UsuarioChurn string")
    got = {r.rango_edad: (r.ingreso_promedio, r.churn_pct, r.total) for r in segments.age_profile(df).collect()}
    edges, labels = [17, 25, 35, 45, 55, 65, 120], ["18–25", "26–35", "36–45", "46–55", "56–65", "65+"]
    want = {}
    for k, label in enumerate(labels):
        band = [(c, ch) for _, age, c, ch in data if edges[k] < age <= edges[k + 1]]
        if not band:
            continue
        cents = [round(c * 100) for c, _ in band if c is not None]
        mean = None if not cents else int(_half_even(sum(cents) / len(cents) / 100.0, 0))
        pct = _half_even(sum(1 for _, ch in band if ch == "CHURN") / len(band) * 100.0, 1)
        want[label] = (mean, pct, len(band))
    assert got == want
