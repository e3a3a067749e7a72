import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from civictext.session import build_session, checkpoint_dir

    s = build_session("local[4]", app="civictext-tests", shuffle_partitions=4,
                      extra={"spark.sql.shuffle.partitions": "4"})
    checkpoint_dir(s)
    yield s
    s.stop()
