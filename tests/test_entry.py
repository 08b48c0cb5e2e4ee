import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["filter", "inner_using", "check_datapoint_all", "flow_to_stock", "ds_if"])
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


WHOLE = ["intersect", "setdiff", "symdiff", "union_first_wins", "ds_plus_ds", "ds_multi_bool", "join_apply", "full_join", "registered_functions", "check_hierarchy", "check_hierarchy_always_null", "hierarchy"]


@pytest.mark.parametrize("name", WHOLE + ["script_order", "join_left_chain", "eval_routine", "provider", "intervals", "periods_of_dates", "truncate_periods", "zones", "round_beyond", "matches_whole", "pivot_cells", "hierarchy_rule_priority", "check_dataset_priority"])
def test_whole_tables_against_duckdb(spark, name):
    script = entry.queries()[name].script
    assert "event_id <" not in script and "event_id >" not in script and "custkey <" not in script and "mod(o_custkey, 50)" not in script
    test_against_duckdb(spark, name)


def test_filter_reaches_the_scan(spark):
    plan = entry.queries()["sub_filter_scalar"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_import_without_llm(tmp_path):
    root = Path(entry.__file__).parent
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tabulon.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone()); sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
assert "filter" in e.queries() and not any(k.startswith("op") for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
