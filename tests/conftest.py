from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from threadlens.schema import MESSAGE, RAW_MESSAGE  # noqa: E402
from threadlens.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture
def no_broadcast(spark):
    """Joins shuffle both sides, and every shuffle partition is a task, as with large tables."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def make_raw(spark):
    """Raw messages from dicts; ``ts`` is an ISO text."""

    def make(*rows):
        from pyspark.sql import functions as F

        out = []
        for i, r in enumerate(rows):
            d = dict.fromkeys(RAW_MESSAGE.names)
            d.update(channel_id="c", file_idx=0, msg_idx=i, format="json", is_system=False, parts=["x"])
            d.update(r)
            if d["grp_file_idx"] is None:
                d["grp_file_idx"] = d["file_idx"]
            out.append(tuple(d[n] for n in RAW_MESSAGE.names))
        schema = ", ".join(
            f"{f.name} {'string' if f.name == 'ts' else f.dataType.simpleString()}" for f in RAW_MESSAGE.fields
        )
        df = spark.createDataFrame(out, schema)
        return df.withColumn("ts", F.to_timestamp("ts"))

    return make


@pytest.fixture
def make_msgs(spark):
    """Assembled messages from dicts; ``ts`` is an ISO text."""

    def make(*rows):
        from pyspark.sql import functions as F

        out = []
        for i, r in enumerate(rows):
            d = dict.fromkeys(MESSAGE.names)
            d.update(channel_id="c", file_idx=0, msg_idx=i, format="json", is_system=False, parts=["x"],
                     has_reply=False)
            d.update(r)
            if d["grp_file_idx"] is None:
                d["grp_file_idx"] = d["file_idx"]
            if d["author_name"] is None:
                d["author_name"] = d["author_id"]
            out.append(tuple(d[n] for n in MESSAGE.names))
        schema = ", ".join(
            f"{f.name} {'string' if f.name == 'ts' else f.dataType.simpleString()}" for f in MESSAGE.fields
        )
        return spark.createDataFrame(out, schema).withColumn("ts", F.to_timestamp("ts"))

    return make
