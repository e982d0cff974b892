from gradus.llm.common import modest_batches

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_a_session_keeps_the_batch_size_that_it_has_set(spark):
    before = spark.conf.get(KEY) if KEY in spark.conf.getAll else None
    try:
        spark.conf.set(KEY, "10000")
        modest_batches(spark)
        assert spark.conf.get(KEY) == "10000"
        spark.conf.unset(KEY)
        modest_batches(spark)
        assert spark.conf.get(KEY) == "2000"
    finally:
        spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)
