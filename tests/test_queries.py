"""Every registered query of the engine against its SQL."""

import pytest
from oracle import SF, assert_same, connection

import __spark_entry__
from tidelog import catalog_queries as cq


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", list(cq.QUERIES))
def test_query(spark, con, name):
    df = cq.QUERIES[name](spark, SF)
    if name in cq.ORACLES:
        assert_same(con, df, cq.ORACLES[name])
    else:
        assert df.count() >= 1


def test_codecs_lose_nothing(spark):
    for name in ("w07_codec", "w08_entity_codec"):
        row = cq.QUERIES[name](spark, SF).first()
        assert row.differences == 0 and row.commands > 0


def test_integrity(spark):
    assert cq.QUERIES["s13_verify_integrity"](spark, SF).first().intact


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["entity_id", "tag", "v_int", "v_str", "v_blob"] and df.count() > 0


def test_every_query_is_registered():
    assert set(cq.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
