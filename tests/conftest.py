import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from citeweave.session import get_spark
    s = get_spark("local[8]", 8, app_name="citeweave-tests",
                  extra={"spark.driver.memory": "8g",
                         "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="citeweave-wh-")})
    # tests run in local mode: an unset checkpoint folder gets a scratch one
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="citeweave-test-ckpt-"))
    yield s
    s.stop()
