import pytest

from oracle import same
from vellum.plans import catalogue, holdings  # noqa: F401  (registers its queries)

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    same(spark, catalogue.QUERIES[name], catalogue.SQL[name], SMALL)


def test_rows_only_queries_run(spark):
    rows = {name: catalogue.QUERIES[name](spark, SMALL).collect() for name in set(catalogue.QUERIES) - set(catalogue.SQL)}
    assert set(rows) == {"search_evidence", "context_block"} and all(rows.values())
    cited = {r["query_id"]: r["context"] for r in rows["context_block"]}
    for r in rows["search_evidence"]:
        assert f"[{r['position']}] {r['citation']}\n{r['excerpt']}" in cited[r["query_id"]]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8


def test_search_pushes_filters_to_partitions(spark, tmp_path):
    from vellum.operators.search import Filters

    spark.createDataFrame([("a", "chunk", True), ("b", "file_summary", False)], "id string, doc_type string, is_current boolean").write.partitionBy("doc_type", "is_current").parquet(str(tmp_path / "r"))
    plan = spark.read.parquet(str(tmp_path / "r")).where(Filters(("chunk",)).condition())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan
