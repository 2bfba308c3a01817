"""Steps whose cost must not grow faster than their input, or fall on one task."""

import duckdb
from pyspark.sql import functions as F

from cloakframe.operators import sanitize as SZ
from cloakframe.plans import queries as Q
from cloakframe.plans import stage_queries  # noqa: F401  adds to Q
from cloakframe.plans.derive import view, with_clause

DIR = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_customers_are_spread_before_they_are_paired(spark):
    assert "REPARTITION_BY_NUM" in _plan(Q.QUERIES["check_violations"](spark, DIR))
    duck = duckdb.connect()
    duck.execute(f"create view customer as select * from '{DIR}/customer.parquet'")
    df = view(spark, DIR, "v_constraints")
    want = duck.execute(with_clause(f"SELECT {', '.join(df.columns)} FROM v_constraints")).fetchall()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)


def test_mentions_without_entity_go_to_all_tasks(spark):
    m = spark.range(1000).selectExpr("concat('n', id) as id", "cast(null as string) as entity_id", "cast(null as string) as protected_value_id")
    e = spark.createDataFrame([("e", "ACTIVE")], "id string, status string")
    a = spark.createDataFrame([("a", "e", "A", True, 1)], "id string, entity_id string, alias string, is_primary boolean, created_at long")
    v = spark.createDataFrame([("v", "@T-1")], "id string, public_token string")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, x in off.items():
        spark.conf.set(k, x)
    try:
        c = SZ.mention_context(m, e, a, v)
        per = [r[1] for r in c.groupBy(F.spark_partition_id()).count().collect()]
        assert c.filter("entity_status is null and alias is null and value_token is null").count() == 1000
    finally:
        for k in off:
            spark.conf.unset(k)
    assert sum(per) == 1000 and max(per) < 500


def test_requests_are_read_once_and_once_for_pages(spark):
    assert _plan(Q.QUERIES["worker_events"](spark, DIR)).count("FileScan parquet") <= 2
