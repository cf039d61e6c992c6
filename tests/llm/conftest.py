import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Where checkpoints go in tests: a folder of the run, since no cluster names one."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
