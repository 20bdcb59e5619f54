"""What a task holds at once does not grow with the size of a row."""

import pyarrow as pa
from pyspark.sql import functions as F

from foliospark.llm import tables
from foliospark.llm.neardup import near_duplicates
from foliospark.llm.words import BLOCK_BYTES, text_blocks, word_hashes

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_bytes(df):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    return [r["n"] for r in df.mapInArrow(sizes, "n long").collect()]


def test_arrow_batches_of_wide_rows_are_bounded(spark):
    wide = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    spark.conf.unset(LIMIT)
    try:
        assert near_duplicates(wide.limit(4)).filter("kept").count() == 1
        found = batch_bytes(wide)
        assert len(found) > 1 and max(found) < 2 * tables.BATCH_BYTES
        spark.conf.set(LIMIT, "1000000")
        near_duplicates(wide.limit(4))
        assert spark.conf.get(LIMIT).startswith("1000000")  # a user's own limit stands
    finally:
        spark.conf.unset(LIMIT)


def test_blocks_are_small_and_a_long_text_stays_whole():
    texts = pa.array(["a b " * 500] * 1000 + ["c " * BLOCK_BYTES, "d"])
    blocks = list(text_blocks(texts))
    assert max(len(data) for _, data, offsets in blocks if len(offsets) > 2) <= 1 << 19
    assert sum(len(word_hashes(data, offsets)[0]) for _, data, offsets in blocks) == 1000 * 1000 + BLOCK_BYTES + 1
