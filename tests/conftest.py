import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strataline.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "8", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.conf.set("spark.sql.codegen.wholeStage", "false")  # compiling costs more than tiny tables take
    s.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    ship(s)
    return s
