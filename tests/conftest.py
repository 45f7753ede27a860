import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def files_of(spark):
    def make(**texts):
        """name=text; a name ending in _cpp is a C++ file."""
        rows = [(f"/t/{n}.{'cpp' if n.endswith('_cpp') else 'c'}", "cpp" if n.endswith("_cpp") else "c", t)
                for n, t in texts.items()]
        return spark.createDataFrame(rows, "file_path string, language string, code string")
    return make
