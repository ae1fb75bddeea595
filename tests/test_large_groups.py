"""Queries with lists, on groups of more items than a part holds, against their SQL."""

import duckdb
import pytest

from roentgrid.plans.instance_queries import e1, e3, e7, e10, e11
from roentgrid.plans.registry import ORACLES
from roentgrid.plans.views import Data


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("large"))
    # Study 1000 has 5000 images and boxes of a phrase, image 10 some 6000 boxes of a class.
    n = "id as l_partkey, 7 + id % 50 as l_suppkey"
    rest = "cast(1 + id % 30 as double) as l_quantity, 0.05 as l_discount, 'A' as l_returnflag, 'O' as l_linestatus"
    big = spark.range(5000).selectExpr("1000L as l_orderkey", *n.split(", "), "cast(4 + id % 2 as int) as l_linenumber", *rest.split(", "))
    small = spark.range(60).selectExpr("1 + id % 9 as l_orderkey", *n.split(", "), "cast(1 + id % 7 as int) as l_linenumber", *rest.split(", "))
    big.unionByName(small).repartition(3).write.parquet(f"{at}/lineitem.parquet")
    keys = spark.range(1, 10).union(spark.range(1000, 1001))
    keys.selectExpr("id as o_orderkey", "id % 5 as o_custkey", "'O' as o_orderstatus", "'1-URGENT' as o_orderpriority").write.parquet(f"{at}/orders.parquet")
    events = spark.range(12000).selectExpr("id as event_id", "10L as user_id", "'error' as event_type", "50.0D as value")
    few = spark.range(20000, 20100).selectExpr(
        "id as event_id", "id % 9 as user_id", "element_at(array('error', 'purchase', 'view', 'click', 'signup'), cast(1 + id % 5 as int)) as event_type", "50.0D as value"
    )
    events.unionByName(few).repartition(3).write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("name, query", [("e1_studies", e1), ("e3_frontal_lateral", e3), ("e7_phrase_instances", e7), ("e10_pseudo_reports", e10), ("e11_class_phrases", e11)])
def test_large_groups_against_sql(spark, folder, name, query):
    got = query(Data(spark, folder))
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]}) q").fetchall()

    def in_order(rows):
        return sorted((tuple(r) for r in rows), key=repr)

    assert in_order(got.select(*columns).collect()) == in_order(want)
    assert max(r[columns.index("n_parts")] or 0 for r in want) > 1
    assert max(len(v) for r in want for v in r if isinstance(v, str)) > 4096 * 20
