import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagtrail.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, shuffle_partitions=4, memory="8g", app="tests",
                            **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("cp"))})
    yield session
    session.stop()


@pytest.fixture(params=["broadcast", "shuffle"])
def joins(spark, request):
    """Joins as Spark picks them; and all by shuffle, with every partition that can be split."""
    shuffle = {"spark.sql.autoBroadcastJoinThreshold": "-1",
               "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
               "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
               "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
               "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    used = shuffle if request.param == "shuffle" else {}
    for key, value in used.items():
        spark.conf.set(key, value)
    yield request.param
    for key in used:
        spark.conf.unset(key)


@pytest.fixture
def rows():
    """Sorted list of plain tuples."""
    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)
    return collect
