import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from tallyweave.session import session

    s = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.driver.memory": "4g",
            # compiling code takes longer than tiny tables do
            "spark.sql.codegen.wholeStage": "false",
            "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
