"""The pN_ queries on the small tables: equal to SQL where SQL can say it; columns, keys and bounds for the others."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from twins import DATA, connection, same  # noqa: E402

from tamarack.llm.queries import ORACLE, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    same(spark, connection(), QUERIES[name], ORACLE[name])


@pytest.mark.parametrize(("name", "columns"), [("p5_found", ["tmdb_id", "row_id"]), ("p6_found", ["row_id", "tmdb_id"]), ("p7_found", ["tmdb_id", "field"]), ("p8_ids", ["doc_id", "ids"]), ("p10_found", ["doc_id"])])
def test_columns_and_keys(spark, name, columns):
    df = QUERIES[name](spark, DATA)
    assert df.columns == columns
    rows = [str(tuple(r)) for r in df.collect()]
    assert len(rows) == len(set(rows))


def test_all_on_empty_tables(spark, tmp_path):
    for t in os.listdir(DATA):
        if t.endswith(".parquet"):
            spark.read.parquet(f"{DATA}/{t}").limit(0).write.parquet(f"{tmp_path}/{t}")
    for name, f in QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name
