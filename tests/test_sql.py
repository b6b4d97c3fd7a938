import pytest
from oracle import same

from netspark.plans import general, network, network_sql

QUERIES = general.QUERIES | network.QUERIES
SQL = general.SQL | network_sql.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    same(spark, sf, QUERIES, SQL, name)


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(SQL) == {"louvain", "louvain_quality", "pagerank", "rwr", "hits", "bfs_random"}


def test_diff_with_values_has_the_found_cases(spark, sf):
    key = ["comparison", "gene_id", "field", "issue"]
    a, b = QUERIES["p5_diff"](spark, sf).select(*key), QUERIES["p5_found"](spark, sf)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
