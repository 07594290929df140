import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from stockroom.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
