"""Items of a benchmark that share an id."""

import pytest

from loomdex.llm import decontaminate


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_two_texts_of_one_item_count_once(spark, block):
    docs = spark.createDataFrame([(1, "x red green blue y one two three four")], "doc_id long, text string")
    items = [(7, "red green blue"), (7, "one two three four"), (8, "green blue")]
    row = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=block).first()
    assert (row.n_hit, row.n_items, row.item_ids) == (7, 2, ["7", "8"])
    assert [tuple(m) for m in row.longest] == [("7", 5, 4), ("8", 2, 2)]
