import pytest

from logweir.session import session_builder


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("shared")
    spark = (
        session_builder("tests")
        .master("local[8]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "5000")
        .config("spark.checkpoint.dir", str(base / "checkpoint"))
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def values(spark):
    """Evaluate SQL text over a list of strings, one result per string."""

    def run(build, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "n int, x string")
        return [r[0] for r in rows.orderBy("n").selectExpr(build("x")).collect()]

    return run
