"""Queries over part tables whose keys go on, against their SQL twins."""

import os

import pytest

from matchloom.plans import catalogue

PART = "/root/testdata/{}/part.parquet"
pytestmark = pytest.mark.skipif(not os.path.isfile(PART.format("sf0.001")), reason="no test tables here")


@pytest.fixture(scope="module")
def long_keys(tmp_path_factory):
    """Eleven products to each of 200 event ids of six digits."""
    return made(tmp_path_factory.mktemp("long_keys"), "sf0.001", (100_000, *range(1_000_000, 1_002_000, 200)))


def made(folder, sf, shifts):
    import duckdb

    duckdb.sql(f"copy (select p_partkey + s as p_partkey, * exclude p_partkey from '{PART.format(sf)}', unnest({list(shifts)}) t(s)) to '{folder}/part.parquet' (format parquet)")
    return str(folder)


def differ(spark, folder, name):
    """Rows of the query that SQL hasn't, and the other way round."""
    import duckdb

    got = catalogue.queries()[name](spark, folder).toPandas()
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{folder}/part.parquet'")
    columns = ", ".join(sorted(got.columns))
    con.execute(f"create table want as select {columns} from ({catalogue.oracle_sql()[name]})")
    assert len(got) == con.execute("select count(*) from want").fetchall()[0][0]
    con.register("got", got)
    return con.execute(f"select * from (select {columns} from got except all select * from want) union all select * from (select * from want except all select {columns} from got)").fetchall()


@pytest.mark.parametrize("name", ["q_route", "q_problem_class", "q_pipeline_summary", "q_audit_summary", "q_decisions"])
def test_shared_event_ids(spark, long_keys, name):
    assert not differ(spark, long_keys, name)


@pytest.fixture(scope="module")
def many_rows(tmp_path_factory):
    return made(tmp_path_factory.mktemp("many_rows"), "sf0.1", range(0, 120_000, 20_000))


@pytest.mark.parametrize("name", ["q_benchmark_catalog", "q_benchmark_events"])
def test_numbers_without_gaps(spark, many_rows, name):
    """Of so many rows that a range exchange only samples them for its bounds."""
    assert not differ(spark, many_rows, name)
