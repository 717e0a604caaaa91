import os

from lattica.llm import common


def test_a_session_can_sweep_its_tables(spark):
    kept = common.stored(spark.range(3).toDF("x"), "kept")
    gone = common.stored(spark.range(3).toDF("x"), "gone")
    common.dropped(gone)
    assert os.path.exists(kept._lattica_path) and not os.path.exists(gone._lattica_path)
    assert common.sweep(spark) >= 2 and not os.path.exists(kept._lattica_path)
    assert common.sweep(spark) == 0


def test_batches_are_small_unless_the_session_says_otherwise(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert common.mapped(spark.range(5), lambda batches: batches, "id long").count() == 5
    assert spark.conf.get(name) == str(common.BATCH_BYTES)
    spark.conf.set(name, "1000000")
    common.mapped(spark.range(5), lambda batches: batches, "id long")
    assert spark.conf.get(name) in ("1000000", "1000000b")
    spark.conf.set(name, str(common.BATCH_BYTES))
