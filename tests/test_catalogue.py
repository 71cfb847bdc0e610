"""Every query with SQL agrees with DuckDB; the others run."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from lectern.plans import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    made = duckdb.connect()
    for f in os.listdir(sf):
        made.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return made


def rows(table):
    names = sorted(table.column_names)
    kinds = [str(table.schema.field(c).type).replace("large_", "") for c in names]
    return names, kinds, sorted(map(repr, zip(*(table.column(c).to_pylist() for c in names))))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, sf, name):
    got = rows(catalogue.QUERIES[name](spark, sf).toArrow())
    if name in catalogue.ORACLES:
        assert got == rows(con.sql(catalogue.ORACLES[name]).to_arrow_table())
    else:
        assert got[2]


@pytest.mark.parametrize("name", ["offload_warning", "common_prefix_length", "recursive_answer", "context_resolution", "fits_in_one_chunk"])
def test_larger_tables(spark, name):
    """Ties, chains and rounds that the smallest tables don't hold."""
    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    assert rows(catalogue.QUERIES[name](spark, sf).toArrow()) == rows(con.sql(catalogue.ORACLES[name]).to_arrow_table())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_no_oracle_is_an_echo():
    assert len(catalogue.ORACLES) >= 50


def test_recursive_answer_goes_on_behind_the_last_unrolled_round(spark, tmp_path):
    """A source of 256 facts, two to a pack, ends in its eighth round. The SQL unrolls seven and has no row for it; with more it has the same."""
    texts = [(k, f"fact {k:04d} of that kind " + "y" * 760, "deep") for k in range(256)] + [(1000 + k, f"fact {k} of that kind.", "flat") for k in range(9)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con, sql, most = duckdb.connect(), catalogue.ORACLES["recursive_answer"], 10
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    more = sql[: sql.index("w0 AS (")] + ", ".join(map(catalogue._round_sql, range(most))) + sql[sql.index(" SELECT source, CAST(part") : sql.index("SELECT * FROM d0")] + " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(most)) + ")"
    got = catalogue.QUERIES["recursive_answer"](spark, str(tmp_path)).toArrow()
    assert rows(got) == rows(con.sql(more).to_arrow_table())
    ended = zip(got.column("source").to_pylist(), got.column("rounds").to_pylist())
    assert {*ended} == {("deep", 7), ("flat", 0)} and {r[0] for r in con.sql(sql).fetchall()} == {"flat"}
