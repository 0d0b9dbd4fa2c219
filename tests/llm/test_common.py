import pyarrow as pa

from sluiceway.llm import common as C


def test_prepare_bounds_the_bytes_of_a_batch(spark):
    before = spark.conf.get(C.BATCH_CONF)
    try:
        for given, kept in (("64m", C.BATCH_BYTES), ("1k", 1024)):
            spark.conf.set(C.BATCH_CONF, given)
            C.prepare(spark)
            assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(C.BATCH_CONF)) == kept

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        spark.conf.set(C.BATCH_CONF, "4k")
        rows = spark.range(0, 100, 1, 1).selectExpr("repeat('x', if(id = 50, 100000, 1000)) as text")
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 100 and max(got) < 10
    finally:
        spark.conf.set(C.BATCH_CONF, before)
