"""Every query over empty tables: it ends, with the columns that it has over full ones."""

import glob
import os

import pytest

from rolloutframe import plans


@pytest.fixture(scope="session")
def nothing(spark, small, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for f in glob.glob(f"{small}/*.parquet"):
        spark.read.parquet(f).limit(0).coalesce(1).write.parquet(str(root / os.path.basename(f)))
    return str(root)


STREAMED = {n for n in plans.QUERIES if n[:3] in {"K01", "K02", "K03", "K05", "K06", "K07", "K10", "K11", "K12", "K14", "K15", "X01", "A14", "A15", "A22"}}


@pytest.mark.parametrize("group", range(8))
def test_batch_queries(spark, nothing, group):
    wrong = []
    for name in sorted(set(plans.QUERIES) - STREAMED)[group::8]:
        try:
            plans.QUERIES[name](spark, nothing).collect()
        except Exception as e:
            wrong.append((name, str(e)[:200]))
    assert not wrong
