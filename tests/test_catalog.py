import shutil

import oracle
import pytest
from helixframe.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    assert oracle.differences(catalog.QUERIES[name](spark, FOLDER), con, catalog.SQL[name]) == ""


def test_lines_given_twice_count_once_in_cuts(spark, tmp_path):
    folder = tmp_path / "twice"
    shutil.copytree(FOLDER, folder, copy_function=shutil.copyfile)
    li = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    again = li.where("l_extendedprice > 60000 or l_orderkey % 2 = 0").union(li)
    (folder / "lineitem.parquet").unlink()
    again.coalesce(1).toPandas().astype({"l_shipdate": "datetime64[us]"}).to_parquet(folder / "lineitem.parquet", index=False)
    con = oracle.connect(str(folder))
    for name in ("sigma_rule_apply", "extreme_bg", "row_similarity"):
        assert oracle.differences(catalog.QUERIES[name](spark, str(folder)), con, catalog.SQL[name]) == "", name
