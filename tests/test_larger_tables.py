"""Queries against their SQL on small tables of what larger ones hold: odd rows, many rows, large keys."""

import duckdb

from quarry.plans import catalogue


def same_as_sql(spark, folder, name, **tables):
    """The query's rows, which are those of its SQL. `tables`: rows and schema of each."""
    con = duckdb.connect()
    for table, (rows, kind) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(path)
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(map(repr, expected))
    return got


def test_file_kinds_of_texts_without_letters(spark, tmp_path):
    rows = [(k, "1" * k, None if k % 5 == 0 else "web") for k in range(24)] + [(99, "é 12", "web"), (100, None, "web"), (101, "", None)]
    got = same_as_sql(spark, tmp_path, "q_file_kind", documents=(rows, "doc_id long, text string, source string"))
    assert "(0, 'markdown')" in got


def test_excerpts_of_more_conversations_than_a_list_shows(spark, tmp_path):
    rows = [(k, t, "user", f"w{k} the and {'of ' * (k % 20)}") for k in range(300) for t in range(2)]
    got = same_as_sql(spark, tmp_path, "q_search_excerpt", conversations=(rows, "conv_id long, turn int, role string, text string"))
    assert len(got) == 300


def test_costs_of_one_and_more(spark, tmp_path):
    rows = [(k, n) for k in (0, 1, 9_999, 10_000, 123_456, 98_765_432) for n in (0, 1023, 1024, 1535, 1536, 1_000_000)]
    got = same_as_sql(spark, tmp_path, "q_sizes_and_costs", documents=(rows, "doc_id long, n_chars long"))
    assert "('12,3456 €', 123456, '0 o')" in got
