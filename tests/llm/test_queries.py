from pathlib import Path

import pytest

from tidepane.llm.queries import ORACLES, QUERIES
from verify_oracles import rows_of, views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", ORACLES)
def test_queries_agree_with_their_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = views(FOLDER).execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
