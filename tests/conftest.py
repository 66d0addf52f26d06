import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from trialweave.cluster import ship_package

    top = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.local.dir", str(top / "local")).config("spark.sql.warehouse.dir", str(top / "warehouse")).config("spark.checkpoint.dir", str(top / "shared")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield ship_package(session)
    session.stop()
