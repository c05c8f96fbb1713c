import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perilmap.llm.common import small_batches

KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.fixture
def settings(spark):
    before = {k: spark.conf.get(k) for k in KEYS}
    yield spark.conf
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_of_many_texts_travel_in_small_batches(spark, settings):
    """A thousand blocks of a megabyte are no small batch."""

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    small_batches(spark)
    blocks = spark.range(0, 40, 1, 1).select(F.array(F.struct(F.repeat(F.lit("x"), 1_000_000).alias("text"))).alias("block"))
    rows = blocks.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in rows) == 40 and max(r["size"] for r in rows) < 10_000_000


def test_smaller_settings_stay(spark, settings):
    for k, v in zip(KEYS, ("10", "1000"), strict=True):
        settings.set(k, v)
    small_batches(spark)
    assert settings.get(KEYS[0]) == "10" and settings.get(KEYS[1]).rstrip("b") == "1000"
