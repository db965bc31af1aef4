import tempfile

import pytest

from churnscope.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", 4, app="llm-tests")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="llm-test-ckpt-"))
    return s
