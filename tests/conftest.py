import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpusvox.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=4,
                  # tiny buckets so every ordered-sequence test crosses bucket edges
                  extra={"corpusvox.seq.rowsPerBucket": "3"})
    yield s
    s.stop()


SMOKE = "/root/testdata/sf0.001"
