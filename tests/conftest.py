import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidings import get_session

    session = get_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression."""

    def value(expr, schema="x int", row=(1,)):
        return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]

    return value


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
