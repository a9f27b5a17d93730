import pytest

from sealframe.session import builder


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("checkpoints")
    s = (
        builder("tests").master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", str(shared)).config("spark.sql.warehouse.dir", str(shared / "warehouse")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
