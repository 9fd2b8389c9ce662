"""Scoring and lookup operators on tiny inline frames."""

import datetime as dt

import pytest

from retenta.operators import lookup, scoring

CLIENTS_SCHEMA = (
    "user_id long, estado string, ciudad string, edad long, ingreso_mensual_mxn double, "
    "dias_desde_ultimo_login long, satisfaccion_1_10 double, num_productos_activos long, "
    "es_hey_pro boolean, UsuarioChurn string"
)
TX_SCHEMA = "user_id long, monto double, fecha_hora timestamp_ntz, tipo_operacion string"


def d(day, month=1):
    return dt.datetime(2024, month, day)


@pytest.fixture
def clients(spark):
    return spark.createDataFrame(
        [
            (1, "Jalisco", "Guadalajara", 30, 1000.0, 45, 3.0, 0, False, "CHURN"),
            (2, "Yucatán", "Mérida", 40, 2000.0, 0, 10.0, 5, True, "NO CHURN"),
            (3, "Jalisco", "Zapopan", 50, None, 200, None, 0, False, " churn "),
            (4, None, None, 60, 500.0, None, 5.0, 2, False, None),
        ],
        CLIENTS_SCHEMA,
    )


@pytest.fixture
def transactions(spark):
    return spark.createDataFrame(
        [
            (2, 10.0, d(20), "compra"),
            (2, 5.5, d(31), "compra"),
            (3, 7.25, d(1), "retiro"),
            (None, 1.0, d(10, 2), "compra"),  # no client: counts for the global max only
        ],
        TX_SCHEMA,
    )


def test_transaction_summary_null_keys_and_global_max(transactions):
    got = {r.user_id: r for r in scoring.transaction_summary(transactions).collect()}
    assert set(got) == {2, 3}
    # the global max (Feb 10) includes the row without a client
    assert got[2].dias_sin_tx == 10 and got[2].total_tx == 2 and got[2].monto_total == 15.5
    assert got[3].dias_sin_tx == 40


def test_churn_scores(clients, transactions):
    out = {r.user_id: r for r in scoring.churn_scores(clients, transactions).collect()}
    assert out[1].total_tx is None and out[1].score_tx == 20.0  # no transactions -> 90 days
    assert out[1].churn_score == 76.9 and out[1].riesgo == "Alto"
    assert out[4].churn_score is None and out[4].riesgo is None
    assert len(out) == 4


def test_churn_scores_empty_transactions(spark, clients):
    empty = spark.createDataFrame([], TX_SCHEMA)
    out = scoring.churn_scores(clients, empty).collect()
    assert len(out) == 4 and all(r.total_tx is None for r in out)


def test_high_risk_top_order_and_fill(clients, transactions):
    out = scoring.high_risk_top(clients, transactions, k=5).collect()
    assert [r.user_id for r in out] == [1, 3]  # both CHURN (95), ties by id
    assert out[1].satisfaccion_1_10 == 0.0 and out[1].ingreso_mensual_mxn == 0.0 and out[1].total_tx == 1
    assert out[0].total_tx == 0


def test_score_card_lookup(clients, transactions):
    scored = scoring.churn_scores(clients, transactions)
    card = scoring.score_card_for(scored, 1).collect()
    assert [(r.id, r.score, r.riesgo, r.suggestion) for r in card] == [(1, 76.9, "Alto", "Contacto urgente")]
    assert scoring.score_card_for(scored, 999).count() == 0


def test_search_requires_three_characters(clients, transactions):
    scored = scoring.churn_scores(clients, transactions)
    with pytest.raises(ValueError):
        lookup.search_clients(scored, "ab")


def test_search_regex_case_insensitive(spark):
    df = spark.createDataFrame([("USR-9901",), ("usr-9902",), ("ABC-1",), (None,)], "user_id string")
    got = [r.user_id for r in lookup.search_clients(df, "usr-99", limit=20).collect()]
    assert got == ["USR-9901", "usr-9902"]
    literal = [r.user_id for r in lookup.search_clients(df, "R-9", literal=True).collect()]
    assert literal == ["USR-9901", "usr-9902"]


def test_substring_filter(spark):
    df = spark.createDataFrame([("A1", "Jalisco"), ("B2", "Yucatán"), ("C3", None)], "user_id string, estado string")
    assert [r.user_id for r in lookup.substring_filter(df, "jal").collect()] == ["A1"]
    assert [r.user_id for r in lookup.substring_filter(df, "b2").collect()] == ["B2"]


def _scored_many(spark, n):
    rows = [(i, "Jalisco" if i % 2 else "Yucatán", float(61 + (i * 7) % 40), "Alto") for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, estado string, churn_score double, riesgo string")


def test_pages_partition_the_set(spark):
    scored = _scored_many(spark, 47)
    seen = []
    for page in range(1, 6):
        part = lookup.high_risk_page(scored, page=page, page_size=10).collect()
        assert all(r.total == 47 and r.pages == 5 for r in part)
        seen += [r.user_id for r in part]
    assert sorted(seen) == list(range(47)) and len(seen) == 47
    assert lookup.high_risk_page(scored, page=9, page_size=10).count() == 0  # past the end


def test_keyset_pages_equal_offset_pages(spark):
    scored = _scored_many(spark, 35)
    offset = [r.user_id for p in range(1, 5) for r in lookup.high_risk_page(scored, page=p, page_size=10).collect()]
    keyset, last = [], (None, None)
    while True:
        page = lookup.high_risk_after(scored, last[0], last[1], page_size=10).collect()
        if not page:
            break
        keyset += [r.user_id for r in page]
        last = (page[-1].churn_score, page[-1].user_id)
    assert keyset == offset


def test_page_arguments(spark):
    scored = _scored_many(spark, 3)
    with pytest.raises(ValueError):
        lookup.high_risk_page(scored, page=0)
    with pytest.raises(ValueError):
        lookup.high_risk_page(scored, page_size=101)


def test_state_filter_case_insensitive(spark):
    scored = _scored_many(spark, 10)
    out = lookup.high_risk_page(scored, page=1, page_size=100, estado="JALISCO").collect()
    assert {r.estado for r in out} == {"Jalisco"} and out[0].total == 5


def test_client_transactions_paging(spark, transactions):
    out = lookup.client_transactions(transactions, 2, page=1, page_size=1).collect()
    assert [(r.fecha_hora, r.total, r.pages) for r in out] == [("2024-01-31 00:00:00", 2, 2)]
    assert lookup.client_transactions(transactions, 42).count() == 0


def test_transaction_pages_all_clients(spark, transactions):
    out = lookup.transaction_pages(transactions, page=2, page_size=1).collect()
    assert [(r.user_id, r.pos, r.fecha_hora, r.total) for r in out] == [(2, 2, "2024-01-20 00:00:00", 2)]


def test_conversations_newest_first(spark):
    conv = spark.createDataFrame(
        [(7, d(1), "hola"), (7, d(3), "adios"), (8, d(2), "x")], "user_id long, date timestamp_ntz, input string"
    )
    out = lookup.client_conversations(conv, 7).collect()
    assert [r.input for r in out] == ["adios", "hola"] and out[0].total == 2
    hist = lookup.conversation_histories(conv).collect()
    assert [(r.user_id, r.input, r.total) for r in hist] == [(7, "adios", 2), (7, "hola", 2), (8, "x", 1)]
