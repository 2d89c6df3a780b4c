import pytest

from tidemark.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(
        master="local[4]",
        warehouse=str(tmp_path_factory.mktemp("warehouse")),
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
