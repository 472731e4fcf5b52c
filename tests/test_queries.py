"""Every query with an oracle agrees with it."""

import pytest
from oracle import connect, same

from ashlar.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).sql(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_all_features():
    from ashlar.functions.minute_features import FAMILIES, features

    assert {f: len(features((f,))) for f in FAMILIES} == {"round_number": 52, "fomo_fud": 104, "retail_pattern": 91, "herding": 125, "microstructure": 41, "sentiment_cycle": 53, "attention": 108}
    assert len(features()) == 574
