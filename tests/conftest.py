import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    own = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{own}/warehouse").config("spark.checkpoint.dir", f"file://{own}/shared").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
