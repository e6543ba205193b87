import pytest


@pytest.fixture(autouse=True, scope="session")
def scratch(spark, tmp_path_factory):
    """A shared folder of the tests' own, as a cluster would name one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
