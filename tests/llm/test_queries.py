"""The training-data queries against their SQL."""

import pytest

from tesserae.llm import queries

from ..oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(sf_dir, queries.SQL[name])
