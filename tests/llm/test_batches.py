import pyarrow as pa

from ledgerfold.session import BATCH_BYTES, BATCH_LIMIT, ship


def largest(frame):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])

    found = frame.mapInArrow(sizes, "size bigint, n bigint").collect()
    return max(r["size"] for r in found), sum(r["n"] for r in found)


def test_long_texts_go_to_workers_by_few(spark):
    """4,000 texts of 5 KB stood in one batch of 20 MB, some times over in an executor."""
    own = spark.newSession()
    long = own.range(0, 4000, 1, 1).selectExpr("repeat('x', 5000) AS text")
    ship(own)
    size, n = largest(long)
    assert size < 2 * BATCH_BYTES and n == 4000


def test_a_limit_of_the_session_is_kept(spark):
    own = spark.newSession()
    own.conf.set(BATCH_LIMIT, "1m")
    ship(own)
    assert own.conf.get(BATCH_LIMIT) == "1m"
    assert largest(own.range(0, 4000, 1, 1).selectExpr("repeat('x', 5000) AS text"))[0] < 2 << 20
