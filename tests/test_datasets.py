"""Dataset operators, streaming, sources and the driver contract."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from glyphmill.__main__ import main
from glyphmill.functions import attacks, kernels as K, udfs
from glyphmill.functions.translit import Romanizer
from glyphmill.operators import datasets as D
from glyphmill.sources import text as sources
from glyphmill.streaming import text as streaming


def rows(spark, values, schema="id long, x string"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], schema)


@pytest.mark.parametrize("limit", [0, 1000])
def test_once_per_value(spark, limit):
    df = rows(spark, ["é", "é", None, "ü"])
    out = D.once_per_value(df, "x", udfs.transliterate, "y", broadcast_rows=limit)
    assert {r["id"]: r["y"] for r in out.collect()} == {0: "e", 1: "e", 2: None, 3: "u"}


def test_dedup_by_key(spark):
    df = rows(spark, ["É", "e", "b", None])
    out = D.dedup_by_key(df.withColumn("k", udfs.search_key("x")), F.col("k"), ["id"]).collect()
    assert sorted((r["key"] or "", r["id"], r["group_size"]) for r in out) == [("", 3, 1), ("b", 2, 1), ("e", 0, 2)]


def test_search_join(spark):
    out = D.search_join(rows(spark, ["Café", "x"]), rows(spark, ["CAFE", "y"], "rid long, rx string"), "x", "rx")
    assert [(r["id"], r["rid"]) for r in out.collect()] == [(0, 0)]


@pytest.mark.parametrize("values", [["a", "a", "a-1"], ["a", "a-1", "a", "a", "b", "b-1-1", "b", "b"], ["x"] * 5, ["a-1", "a-2", "b-1"], ["a-1", "a", "a"], ["", "", "1"]])
def test_unique_slugs_equal_a_sequential_pass(spark, tables, values):
    unique = K.UniqueSlugger(K.Slugger(Romanizer(tables, errors="ignore")))
    expected = [unique(v) for v in values]
    out = D.unique_slugs(rows(spark, values), udfs.slugify("x"), "id").orderBy("id").collect()
    assert [r["slug"] for r in out] == expected


def test_screen_hosts(spark):
    out = D.screen_hosts(rows(spark, ["аррӏе.com", "example.com", None]), "x").orderBy("id").collect()
    assert [r["flagged"] for r in out] == [True, False, None]


ATTACKED = ["paypal secure login", "amazon security", "password"]


@pytest.mark.parametrize("attack", sorted(attacks.ATTACKS))
def test_attacks_are_recovered(spark, attack):
    df = rows(spark, ATTACKED).withColumn("hit", attacks.ATTACKS[attack](F.col("x")))
    out = df.select("x", "hit", udfs.strip_obfuscation("hit").alias("all"), udfs.canonicalize("hit").alias("most"), udfs.canonicalize_strict("hit").alias("strict")).collect()
    for r in out:
        assert r["hit"] != r["x"] and r["all"] == r["x"]
        if attack != "zalgo":
            assert r["most"] == r["x"] == r["strict"]


def test_recovery_and_error_rates(spark):
    df = spark.createDataFrame([("a b b", "a b c"), ("x", "x")], "a string, b string")
    assert D.recovery(df, "a", "b").first().asDict() == {"n": 2, "xmr": 0.5, "word_recovery": 0.75}
    got = D.cer_wer(df, "a", "b").first()
    assert (got["cer"], got["wer"]) == (1 / 6, 1 / 4)


def test_error_rates_of_odd_texts(spark):
    """NUL is a character like any other; nulls on either side are left out of the rates and count as lost words."""
    df = spark.createDataFrame([("a\0b c", "a\0b d"), (None, "x"), ("y", None), ("", "")], "a string, b string")
    got = D.cer_wer(df, "a", "b").first()
    assert (got["cer"], got["wer"]) == (1 / 5, 1 / 2)
    assert D.recovery(df, "a", "b").first().asDict() == {"n": 4, "xmr": 1 / 2, "word_recovery": 1 / 3}
    assert D.recovery(df.limit(0), "a", "b").first().asDict() == {"n": 0, "xmr": None, "word_recovery": None}


def test_recovery_equals_brute_force(spark):
    import random
    from collections import Counter

    rng = random.Random(4)
    rows = [tuple(" ".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(2)) for _ in range(50)]
    common = sum(sum((Counter(a.split()) & Counter(b.split())).values()) for a, b in rows)
    got = D.recovery(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert got["word_recovery"] == common / sum(len(a.split()) for a, _ in rows) and got["xmr"] == sum(a == b for a, b in rows) / 50


def test_profiles_and_mining(spark):
    df = rows(spark, ["aя", "b", None])
    assert {r["script"]: r["n"] for r in D.script_profile(df, "x").collect()} == {"Latin": 2, "Cyrillic": 1}
    known = spark.createDataFrame([("я",)], "src string")
    assert [(r["ch"], r["n"]) for r in D.miss_mining(rows(spark, ["ééя", "é"]), "x", known).collect()] == [("é", 3)]


def test_streaming_equals_batch(spark, tmp_path):
    df = rows(spark, ["Café", "ABC", None])
    df.write.parquet(f"file://{tmp_path}/in")
    out = streaming.keyed_files(spark, f"file://{tmp_path}/in", df.schema, "x", udfs.search_key, f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    assert {r["id"]: r["key"] for r in out.collect()} == {0: "cafe", 1: "abc", 2: None}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\nb\n".encode("latin-1"))
    assert [r["text"] for r in sources.read_decoded(spark, f"file://{tmp_path}/a.txt", "latin1").collect()] == ["é\nb\n"]
    assert sources.read_lines(spark, f"file://{tmp_path}/a.txt").count() == 2
    sources.write_lines(rows(spark, ["x", "y"]), "x", f"file://{tmp_path}/out")
    assert Counter(r["line"] for r in sources.read_lines(spark, f"file://{tmp_path}/out").collect()) == {"x": 1, "y": 1}


@pytest.mark.parametrize(("args", "expected"), [(["t", "Москва"], "Moskva"), (["t", "--target", "ru", "Moskva"], "Москва"), (["slugify", "Hello World"], "hello-world"), (["n", "--form", "NFKC", "ﬁ"], "fi"), (["d", "🔥"], "fire"), (["p", "--profile", "search_index", "Ünï"], "uni")])
def test_command_line(spark, capsys, args, expected):
    assert main(args) == 0
    assert capsys.readouterr().out.strip() == expected


def test_driver_contract(spark):
    assert entry_module.entry(spark).columns == ["key", "n", "first_id"]
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90


def test_oracle_on_the_smallest_tables(spark):
    """Every query of the core with SQL, against DuckDB."""
    import duckdb

    from glyphmill.plans.catalogue import ORACLE, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    wrong = []
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, d)
        columns = sorted(df.columns)
        key = lambda r: tuple((v is None, str(round(v, 6)) if isinstance(v, float) else str(v)) for v in r)
        ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
        theirs = sorted(con.execute(f"select {', '.join(columns)} from ({sql})").fetchall(), key=key)
        if [key(r) for r in ours] != [key(r) for r in theirs]:
            wrong.append(name)
    assert not wrong
