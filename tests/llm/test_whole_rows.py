"""Rows that share ids, in the stages that meet rows again by id and text."""

from collections import Counter

from loomdex.llm import minhash, mixing


def test_rows_without_words_all_stay(spark):
    rows = [(1, None, "a"), (1, None, "b"), (None, "", "a"), (None, "", "a"), (None, " \n", "c"), (2, "some words", "a"), (2, "some words", "b")]
    kept = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter(map(tuple, kept[:])) - Counter(rows) == Counter()
    assert Counter(tuple(r) for r in kept if not (r.text or "").strip()) == Counter(rows[:5])
    assert sum(r.doc_id == 2 for r in kept) == 1


def test_repeated_rows_come_back_with_what_is_taken_of_each(spark):
    rows = [(1, "a b c", "s", 1), (1, "a b c", "s", 2), (1, "a b c", "t", 3), (None, "d e", None, 4), (None, "d e", None, 5)]
    rows += [(10 + i, "w " * (1 + i % 5), "st"[i % 2], 10 + i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    wanted = Counter(map(tuple, mixing.mix(docs, keep=("doc_id", "source")).where("taken > 0").collect()))
    got = mixing.mixed(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "row").collect()
    assert Counter(tuple(r)[:-1] for r in got) == wanted and len({r.row for r in got}) == len(got)
