"""Every query with SQL gives the rows of that SQL in DuckDB."""

import duckdb
import pytest
from compare import compare, duck
from lodestone.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, sf, con, name):
    assert not compare(spark, con, sf, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["manhattan_rank", "manhattan_topk"])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_round_as_their_type(spark, tmp_path, name, kind):
    """0.3195 times 1000 is 319.5 as a float, and less as the double of that float."""
    rows = [(1, [0.3195] * 64), (2, [-0.3195] * 64), (3, [0.0125] * 64), (4, [0.1] * 64), (5, [0.2195] * 64), (6, [0.0005] * 64)]
    spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    run, sql = catalogue.queries()[name], catalogue.oracle_sql()[name]
    assert not compare(spark, con, str(tmp_path), run, sql)
    assert [tuple(r) for r in run(spark, str(tmp_path)).collect()] == con.execute(sql).fetchall()
