"""The pipeline, each stage against brute force on what the stage before kept."""

import re

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from loomdex.llm import toxicity
from loomdex.llm.labelled import fold
from loomdex.session import materialize
from pyspark.sql import functions as F
from tests.llm.test_pairs import expected_near
from tests.llm.test_rows import expected_hits
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        found.append((name, materialize(stage(spark, found[-1][1], "/root/testdata/sf0.001"), name)))
    return dict(found)


def test_all_but_the_last_stage_keep_the_columns(stages):
    columns = stages["documents"].columns
    assert all(df.columns == columns for name, df in stages.items() if name != "mixing")
    assert corpus_pipeline.ORACLE_SQL is None and contract.queries()["pipeline"] is corpus_pipeline.run


def test_toxicity_stage_drops_what_scores_high(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    lexicon = toxicity.learn(stages["documents"], labels, fold(F.col("doc_id"), 3) != 1)
    automaton = lexicon.automaton()
    kept = {r.doc_id for r in stages["documents"].collect()
            if toxicity.chance(toxicity.np.array([toxicity.features(toxicity.folded(r.text), automaton)]), lexicon.curve)[0] < 0.7}
    assert {r.doc_id for r in stages["toxicity"].collect()} == kept


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == {i for i, _, _, own in expected_near(rows) if own}


def test_decontamination_stage_drops_contaminated_documents(spark, stages):
    rows = [(r.doc_id, r.text) for r in stages["near_duplicates"].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert {r.doc_id for r in stages["decontamination"].collect()} == {f[0] for f in expected_hits(rows, items) if not f[-1]}


def test_secret_stage_masks_planted_tokens_and_keeps_all_else(stages):
    before, after = ({r.doc_id: r.text for r in stages[n].collect()} for n in ("decontamination", "secrets"))
    planted = re.compile('(token = ")[0-9a-f]{40}"')
    assert after == {i: planted.sub(r'\1<secret>"', t) for i, t in before.items()}


def test_mixing_stage_takes_near_targets(stages):
    rows = stages["mixing"].collect()
    assert rows and all(r.taken in (r.size, 2 * r.size) and r.size == len(r.text.split()) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    longest = max(r.size for r in rows)
    assert all(abs(taken - target) <= longest for taken, target in by.values())


@pytest.mark.parametrize("name", sorted(n for n in contract.oracle_sql() if n.startswith("op")))
def test_query_equals_sql(spark, name):
    db = connect("/root/testdata/sf0.001")
    assert differences(contract.queries()[name](spark, "/root/testdata/sf0.001"), db, contract.oracle_sql()[name]) == []


def test_all_ten_queries_are_registered():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in contract.queries())] == []
