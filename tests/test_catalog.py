"""Every named query against its SQL on DuckDB, over the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from cairn.plans.catalog import ALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if hasattr(x, "item") and not hasattr(x, "__len__"):
        x = x.item()
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool | str):
        return x
    if isinstance(x, int | float):
        return round(float(x), 6) + 0.0
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    return tuple(value(y) for y in x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, (tuple(map(value, r)) for r in df.itertuples(index=False, name=None))))


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, con, sf_dir, name):
    query = ALL[name]
    got = query.run(spark, sf_dir).toPandas()
    if query.sql is None:
        assert len(got.columns) > 1
        return
    want = con.sql(query.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_without_training_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ALL) <= set(entry.queries())


def same_as_sql(spark, path, name, **tables):
    """A query over small tables of (schema, rows) gives the rows of its SQL."""
    con = duckdb.connect()
    for table, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    got, want = rows(ALL[name].run(spark, str(path)).toPandas()), rows(con.sql(ALL[name].sql).df())
    assert got == want
    return want


def test_sql_functions_of_busy_hosts_and_odd_texts(spark, tmp_path):
    texts = ["One. Two! Three", "One. Two! Three", "a.\vb", "a.\u00a0", "\u3000 ", "\n", "a. \n\nb?", "", None, "..!", "line\n"]
    docs = [(max(i, 1), x) for i, x in enumerate(texts)]  # two rows of id 1
    hosts = ["https://www.busy.example/"] * 300 + ["http://edge.example:80/x"] * 200 + ["HTTPS://İΑΣ.example", "nohost", "", None]
    want = same_as_sql(spark, tmp_path, "sql_functions", documents=("doc_id long, text string", docs), pages=("page_id long, url string", list(enumerate(hosts))))
    assert f"('busy.example', {round(1 - math.log(301) / math.log(201), 6)}, 'rarity')" in want and "('edge.example', 0.0, 'rarity')" in want and want.count("('1', 3.0, 'sentences')") == 2
    spark.createDataFrame(docs, "i long, text string").createOrReplaceTempView("odd_texts")
    got = spark.sql("SELECT i, place, sentence FROM odd_texts, LATERAL cairn_sentences(text) WHERE i IN (2, 3, 6) ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [(2, 1, "a."), (2, 2, "\vb"), (3, 1, "a."), (6, 1, "a. \n\n".strip(" ")), (6, 2, "b?")]
    assert spark.sql("SELECT cairn_rarity(300, 200)").first()[0] == 0


def test_located_sentences_of_odd_places(spark, tmp_path):
    items = [
        (1, "A first one. Then a second one!"), (2, "one two three four"), (3, "  \n\u00a0Lead blanks stay. \u00a0 Here.\u3000"), (4, "tail of a.\vb"), (5, "only three words"), (6, "İi don't <b>x</b> four"),
        (7, "one two three four"), (7, "two three four five"), (8, None), (9, "É. ø: ß; \U0001f600 ж"), (10, "w1-w2-w3-w4-w5-w6-w7-w8-w9-w10-w11 w12"), (None, "no name at all"),
    ]
    docs = [
        (1, "A first one. A first one. Then a second one! A first one. Then a second one!"),  # its first sentence stands alone before
        (2, "someone two three fourteen"), (3, "<one two three four>"), (4, "x  \n\u00a0Lead blanks stay. \u00a0 Here.\u3000y"), (5, "\U0001f600e\u0301 detail of a.\vbc"),
        (6, "only three words"), (7, "İi don't <b>x</b> fours"), (8, "one two three four five"), (8, "zero one two three four"), (9, None), (10, ""), (11, "É É. ø: ß; \U0001f600 жук"),
        (12, "1w1-w2-w3-w4-w5-w6-w7-w8-w9-w10-w11 w12 w1-w2-w3-w4-w5-w6-w7-w8-w9-w10-w11 w13"), (None, "There is no name at all."), (13, "One two three four"),
    ]
    want = same_as_sql(spark, tmp_path, "located_sentences", benchmark=("item_id long, text string", items), documents=("doc_id long, text string", docs))
    assert len(want) == 13 and repr((1.0, 13.0, 1.0, 2.0)) in want


def test_located_sentences_without_items(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "located_sentences", benchmark=("item_id long, text string", [(1, "too short")]), documents=("doc_id long, text string", [(1, "too short")])) == []
