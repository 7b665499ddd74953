"""Numbers of references repeat in the test tables; every row counts once, and picks among equals are the first of the table."""

import os

import duckdb
import pytest

from lodestone.operators import lookup
from lodestone.plans import queries

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """The small tables with every line item twice, the second time of another supplier, so of another function and root."""
    d = tmp_path_factory.mktemp("repeated")
    for name in os.listdir(SF):
        if name != "lineitem.parquet":
            os.symlink(f"{SF}/{name}", d / name)
    duckdb.execute(f"""copy (select * replace (l_suppkey + k as l_suppkey) from '{SF}/lineitem.parquet', range(2) t(k) order by k, file_row_number)
      to '{d}/lineitem.parquet' (format parquet)""")
    return str(d)


def test_field_references_of_repeated_numbers(spark, repeated):
    got, want = same(spark, connect(repeated), queries.QUERIES["field_refs_owner_narrowed"], queries.ORACLE["field_refs_owner_narrowed"], repeated)
    assert len(want[1]) > 1 and got == want


@pytest.fixture(scope="module")
def at_places(tmp_path_factory):
    """Line items moved to the places of parts, forty of each number; rows of a number differ in supplier, in no order."""
    d = tmp_path_factory.mktemp("places")
    for name in os.listdir(SF):
        if name != "lineitem.parquet":
            os.symlink(f"{SF}/{name}", d / name)
    duckdb.execute(f"""copy (select l.* replace (p_partkey % 50 + 50 * (p_partkey % 6) as l_orderkey, p_partkey as l_partkey,
      hash(p_partkey, k) % 40 as l_suppkey, cast(p_size % 9 as int) as l_linenumber) from '{SF}/part.parquet', range(40) t(k),
      (from '{SF}/lineitem.parquet' limit 1) l order by k, hash(p_partkey)) to '{d}/lineitem.parquet' (format parquet)""")
    return str(d)


@pytest.mark.parametrize("name", ["ref_at_batch", "scope_at_batch"])
def test_first_of_equal_references(spark, at_places, name):
    con = connect(at_places)
    con.execute("set threads = 1")  # with more, what the SQL gives for equal numbers changes from run to run
    got, want = same(spark, con, queries.QUERIES[name], queries.ORACLE[name], at_places)
    assert got == want
    key, func = want[0].index("req_id"), want[0].index("enclosing_func")
    first = {}
    for part, supplier in duckdb.execute(f"select l_partkey, l_suppkey from '{at_places}/lineitem.parquet' order by file_row_number").fetchall():
        first.setdefault(part, f"fn{supplier % 40}" if supplier % 5 else None)
    assert {r[key]: r[func] for r in got[1]} == first


def test_id_of_several_places(spark):
    refs = spark.createDataFrame([(5, "a.c", "x", 1, 1, "f", False, "value", "", "ts", [])], """ord int, file string, name string, line int, col int,
      enclosing_func string, is_local boolean, role string, owner string, source string, obj_chain array<string>""")
    cursors = spark.createDataFrame([(1, "a.c", "x", 9, 9), (1, "a.c", "x", 1, 1), (2, "b.c", "x", 1, 1)], "req_id int, file string, name string, line int, col int")
    assert {r.req_id: r.ord for r in lookup.ref_at(refs, cursors).collect()} == {1: 5, 2: None}
