"""Indexed search against a scan."""

import random

import pytest

from retenta.operators import lookup, trigrams


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(2)
    names = ["Nuevo León", "León", "Baja California", "baja", "", None, "ÑANDÚ x", "a.b[c", "aaaa", "İstanbul"]
    rows = [(f"USR-{i:04d}", rng.choice(names) if i % 3 else "Nuevo León", i) for i in range(600)]
    df = spark.createDataFrame(rows, "user_id string, estado string, n int")
    path = str(tmp_path_factory.mktemp("grams") / "g")
    trigrams.write_trigrams(df, path, "user_id", ["user_id", "estado"])
    return df, path


@pytest.mark.parametrize("term", ["león", "LEÓN", "baja c", "usr-00", "7", "", "aaa", "aaaaa", "a.b[c", "ñandú", "nothing here", "o l", "-012", "stan"])
def test_search_equals_a_scan(indexed, term):
    df, path = indexed
    got = sorted(r.n for r in trigrams.search(df, path, term, "user_id", ["user_id", "estado"]).collect())
    assert got == sorted(r.n for r in lookup.substring_filter(df, term).collect())


@pytest.mark.parametrize("pattern", ["R-01", "usr.0.1", "le.n", "B.ja Cal", "x|y", "[ab]aja", "nada.que", ".", "USR-0(12|13)"])
def test_regex_search_equals_a_scan(indexed, pattern):
    df, path = indexed
    got = sorted(r.n for r in trigrams.search(df, path, pattern, "user_id", ["user_id"], regex=True).collect())
    assert got == sorted(r.n for r in df.filter(lookup.regex_match("user_id", pattern)).collect())
    got = sorted(r.n for r in trigrams.search(df, path, pattern, "user_id", ["user_id", "estado"], regex=True).collect())
    assert got == sorted(r.n for r in df.filter(lookup.regex_match("user_id", pattern) | lookup.regex_match("estado", pattern)).collect())


def test_search_reads_its_trigrams_only(indexed):
    df, path = indexed
    plan = trigrams.search(df, path, "león", "user_id", ["estado"])._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "PartitionFilters: [" in scan and "carpeta" in scan.split("PartitionFilters")[1] and "In(trigrama, [" in scan


def test_search_of_no_rows(spark, indexed, tmp_path):
    df, _ = indexed
    trigrams.write_trigrams(df.limit(0), str(tmp_path / "g"), "user_id", ["estado"])
    assert trigrams.search(df.limit(0), str(tmp_path / "g"), "león", "user_id", ["estado"]).count() == 0
