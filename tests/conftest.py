import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from terrachron.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def small_groups(spark):
    """Force the split path of oversized groups."""
    from terrachron.operators.skew import GROUP_ROWS_SETTING

    spark.conf.set(GROUP_ROWS_SETTING, "10")
    yield
    spark.conf.unset(GROUP_ROWS_SETTING)
