import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sqlkiln.session import get_spark
    scratch = tempfile.mkdtemp(prefix="sqlkiln-test-")
    s = get_spark("local[4]", 4, extra={"spark.sql.warehouse.dir": os.path.join(scratch, "wh"),
                                        "spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="sqlkiln-run-")
