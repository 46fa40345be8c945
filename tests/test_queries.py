"""Every query beside its SQL on the smallest tables; those without SQL give rows."""

import pytest

from compare import differences
from fernglass.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE_SQL:
        assert differences(df, ORACLE_SQL[name], DATA) == ""
    else:
        assert df.count() > 0


def test_sql_has_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
