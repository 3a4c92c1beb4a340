import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def image(spark):
    """(rows of a 2-D array) -> DataFrame(image_id, y, x, v)."""

    def make(a, image_id=0, name="v"):
        import numpy as np
        import pandas as pd

        y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
        return spark.createDataFrame(
            pd.DataFrame({"image_id": np.int64(image_id), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), name: a.ravel().astype(float)})
        )

    return make


def to_array(df, value):
    import numpy as np

    p = df.select("y", "x", value).toPandas()
    out = np.full((p.y.max() + 1, p.x.max() + 1), np.nan)
    out[p.y, p.x] = p[value]
    return out
