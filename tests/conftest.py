import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from leadlens.session import build_session

    ck = tempfile.mkdtemp(prefix="leadlens-test-ckpt-")
    s = build_session("local[4]", app="leadlens-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ck})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def cat_small(spark):
    from leadlens.sources.tables import Catalog

    return Catalog(spark, SF_SMALL)


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
