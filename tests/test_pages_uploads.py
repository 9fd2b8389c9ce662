"""Indexed pages against sorted lists, row numbers of files at several split sizes, and
month-keyed files with planted faults."""

import random

import pytest
from pyspark.sql import functions as F

from retenta.operators import model, page_index
from retenta.sources import monthly_files, readers

COLUMNS = "user_id long, estado string, ciudad string, churn_score double, riesgo string, es_hey_pro boolean"


def clients(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        score = 77.7 if i % 3 == 0 else round(rng.uniform(50, 100), 1)  # a third of all share a score
        rows.append((i, rng.choice(["Jalisco", "JALISCO", "Sonora", None]), "c", score, "Alto" if score > 60 else "Medio", i % 2 == 0))
    return rows


def expected(rows, page, size, estado=None, low=0.0, high=100.0):
    found = [r for r in rows if r[4] == "Alto" and low <= r[3] <= high and (not estado or (r[1] or "").lower() == estado.lower())]
    found.sort(key=lambda r: (-r[3], r[0]))
    ids = [r[0] for r in found[(page - 1) * size : page * size]]
    return ids, len(found), -(-len(found) // size)


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_indexed_pages_equal_sorted_lists(spark, tmp_path, ranges):
    rows = clients(ranges or 0, 700)
    page_index.write_page_index(spark.createDataFrame(rows, COLUMNS).repartition(3), str(tmp_path / "p"), ranges)
    for page, size, estado, low, high in [
        (1, 15, None, 0, 100), (13, 15, None, 0, 100), (33, 20, None, 0, 100), (2, 100, "jalisco", 0, 100), (3, 7, "SONORA", 77.7, 77.7),
        (1, 10, None, 61.5, 70.2), (10**6, 50, None, 0, 100), (1, 5, "nowhere", 0, 100), (2, 5, None, 99.99, 100), (1, 1, "", 60, 100),
    ]:
        got = page_index.indexed_page(spark, str(tmp_path / "p"), page, size, estado, low, high).collect()
        ids, total, pages = expected(rows, page, size, estado, low, high)
        assert {(r.total, r.page, r.page_size, r.pages) for r in got} == {(total, page, size, pages)}
        assert sorted(r.user_id for r in got if r.user_id is not None) == sorted(ids)
        assert len(got) == max(1, len(ids))


def test_a_deep_page_reads_as_little_as_the_first(spark, tmp_path):
    rows = [(i, "s", "c", 100 - i * 0.001, "Alto", True) for i in range(20_000)]
    path = str(tmp_path / "p")
    page_index.write_page_index(spark.createDataFrame(rows, COLUMNS), path, 20)

    def rows_read(page):
        df = page_index.indexed_page(spark, path, page, 10)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(rango" in plan or "PartitionFilters: [rango" in plan or "rango#" in plan.split("PartitionFilters")[1][:120]
        ids = [r.user_id for r in df.collect()]
        assert sorted(ids) == list(range((page - 1) * 10, page * 10))
        stored = spark.read.parquet(f"{path}/clients")
        held = stored.filter(F.col("user_id").isin(ids)).select("rango").distinct()
        return stored.join(held, "rango").count()

    first, deep = rows_read(1), rows_read(1990)
    assert max(first, deep) <= 2 * 20_000 / 20 * 1.6


def test_page_index_of_no_clients(spark, tmp_path):
    page_index.write_page_index(spark.createDataFrame([], COLUMNS), str(tmp_path / "p"))
    got = page_index.indexed_page(spark, str(tmp_path / "p"), 1, 10).collect()
    assert [(r.user_id, r.total, r.pages) for r in got] == [(None, 0, 0)]
    with pytest.raises(ValueError):
        page_index.indexed_page(spark, str(tmp_path / "p"), 0, 10)


@pytest.mark.parametrize("split", ["128m", "7k", "2k"])
def test_row_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    path = str(tmp_path / "up")
    spark.range(5000, numPartitions=4).select(F.col("id").alias("place"), F.repeat(F.lit("x"), 20).alias("t")).write.option("header", True).csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        upload = readers.read_upload_csv(spark, path)
        got = model.with_row_index(upload).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000 and all(r._row == r.place for r in got)


def test_row_numbers_of_other_frames(spark):
    got = [r._row for r in model.with_row_index(spark.range(100, numPartitions=7).filter("id % 3 = 0")).collect()]
    assert sorted(got) == list(range(34))
    assert model.with_row_index(spark.range(0)).count() == 0


SCHEMA = "mes string, monto double, n long"


def write_lines(spark, path, lines):
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)


@pytest.mark.parametrize("sep", [",", ";"])
def test_bad_months_and_lines_are_kept_apart(spark, tmp_path, sep):
    lines = ["MES,Monto,N", "2024-01-01,1.5,2", "enero,2.5,3", "2024-02-01,x,4", "2024-03-01,3.5", "2024-04-01,4.5,5,6", ",5.5,6", "2024-05-01,,7"]
    write_lines(spark, str(tmp_path / "in"), [x.replace(",", sep) for x in lines])
    out = monthly_files.read_monthly_csv(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"))
    valid = sorted((r.mes.strftime("%Y-%m"), r.monto, r.n) for r in out.valid.collect())
    assert valid == [("2024-01", 1.5, 2), ("2024-05", None, 7)]
    assert sorted((r.mes or "", r.n) for r in out.bad_months.collect()) == [("", 6), ("enero", 3)]
    assert sorted(r.linea.replace(sep, ",") for r in out.bad_lines.collect()) == ["2024-02-01,x,4", "2024-03-01,3.5", "2024-04-01,4.5,5,6"]
    assert out.counts == {"leidas": 7, "valida": 2, "mes_invalido": 2, "linea_corrupta": 3}
    assert {r.estado: r.filas for r in out.report().collect()} == out.counts


def test_a_monthly_file_without_rows(spark, tmp_path):
    write_lines(spark, str(tmp_path / "in"), ["mes,monto,n"])
    out = monthly_files.read_monthly_csv(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"))
    assert out.counts["leidas"] == 0 and out.valid.count() == out.bad_months.count() == out.bad_lines.count() == 0


def test_high_risk_total_counts_all_matches(spark):
    from retenta.operators import scoring

    rows = [(i, "CHURN" if i % 2 else "NO CHURN") for i in range(50)]
    c = spark.createDataFrame(rows, "user_id long, UsuarioChurn string").withColumns({x: F.lit(1) for x in ("satisfaccion_1_10", "dias_desde_ultimo_login", "num_productos_activos", "ingreso_mensual_mxn")}).withColumns({"estado": F.lit("e"), "ciudad": F.lit("c")})
    t = spark.createDataFrame([(1, 2.0)], "user_id long, monto double")
    got = scoring.high_risk_top(c, t, k=3).collect()
    assert [(r.user_id, r.total) for r in got] == [(1, 25), (3, 25), (5, 25)]
