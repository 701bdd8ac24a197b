"""The shared folder, scratch tables and times."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyweave import session
from tallyweave.functions import text


def test_scratch_tables_are_released(spark):
    session.release(spark)
    df = session.cut(spark.range(3).withColumn("x", F.col("id") * 2))
    places = [Path(p.removeprefix("file:")) for p in {str(Path(f.removeprefix("file:")).parent) for f in df.inputFiles()}]
    places = [Path("/" + str(p).lstrip("/")) for p in places]
    assert df.count() == 3 and all(p.is_dir() for p in places)
    assert session.release(spark) == 1 and not any(p.exists() for p in places) and session.release(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    none = SimpleNamespace(get=lambda *_: None)
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://x:7077"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.shared_dir(SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master=master)))


def test_times_as_text(spark):
    row = spark.sql("SELECT timestamp_seconds(0) AS t, CAST(NULL AS TIMESTAMP) AS n").select(text.utc_text(F.col("t")), text.utc_text(F.col("n"))).first()
    assert tuple(row) == ("1970-01-01T00:00:00+00:00", None)
