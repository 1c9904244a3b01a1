import os
import shutil
import tempfile

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="loomgrid-test-")
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": f"file://{folder}/checkpoints",
        "spark.sql.warehouse.dir": f"file://{folder}/warehouse",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
    shutil.rmtree(folder, ignore_errors=True)


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def boxes(spark, rows, idx="det_idx"):
    """(image, class, idx, x1, y1, x2, y2[, score or is_ignore]) rows as a table."""
    kind = {8: "score double" if idx == "det_idx" else "is_ignore boolean", 7: None}[len(rows[0])]
    ddl = f"image_id bigint, class_id int, {idx} bigint, x1 double, y1 double, x2 double, y2 double" + (f", {kind}" if kind else "")
    return spark.createDataFrame(rows, ddl)
