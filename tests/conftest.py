import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from weft.session import local_session

    s = local_session("*", shuffle_partitions=8, app="weft-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def items_schema():
    return ("item_id long, instruction string, context string, output string, category string, "
            "tags array<string>, difficulty string, source_section string")


def make_items(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
