"""Every registered query beside its SQL on the smallest tables.

Set POINTSMAN_SF to another scale; fitted queries without SQL must give rows.
"""

import os

import pytest

from pointsman.catalog.load import QUERIES, SQL
from tests.oracle import connect, difference

SF_DIR = f"/root/testdata/sf{os.environ.get('POINTSMAN_SF', '0.001')}"
# Long protocols of many fits; their parts are tested against brute force.
LONG = {"reproduce_all", "learner_ablation", "fit_gbt", "feature_importance_sorted", "fit_random_forest", "fit_gbt_per_model", "fit_embedding_gbt"}
# Too few samples of the smallest tables for a unique least-squares solution, which the SQL elimination needs.
NOT_UNIQUE = {"fit_ols"} if SF_DIR.endswith("0.001") else set()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LONG))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    spark.catalog.clearCache()
    if name in SQL and name not in NOT_UNIQUE:
        assert difference(got, con.execute(SQL[name]).df()) is None
    else:
        assert len(got) > 0
