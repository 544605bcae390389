"""The corpus pipeline, stage by stage against plain versions, and as a query."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from scripts.compare_oracle import compare, oracle_connection
from tests.llm import brute
from tests.llm.conftest import edge_rows, same_rows
from tests.llm.test_tokens import COLUMNS, check_packing, pieces_of
from zonepulse.llm.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")


def through(spark, docs, folder, sf_dir):
    """Each stage's input and output, written and read again."""
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        steps[name] = (docs, out)
        docs = out
    return steps


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def check_steps(steps):
    columns = steps["quality"][0].columns
    for name in ("quality", "exact_dedup", "near_dedup", "suffix_dedup"):
        assert steps[name][1].columns == columns
    before, after = steps["exact_dedup"]
    groups = brute.exact_groups(pairs(before))
    same_rows([(i, brute.normalised(t)) for i, t in pairs(after)], [(ids[0], k) for k, ids in groups.items()])
    before, after = steps["near_dedup"]
    rows = pairs(before)
    found = brute.near_components([(n, t) for n, (_, t) in enumerate(rows)], 5, 80)
    assert after.count() == len({c for _, _, c in found})
    before, after = steps["suffix_dedup"]
    want = brute.suffix_dedup(pairs(before), 200)
    changed = {w[0]: w for w in want if w[2]}
    assert after.count() == len(want)
    whole = {i: t or "" for i, t in pairs(before) if i not in changed}
    assert {i: t or "" for i, t in pairs(after) if i not in changed} == whole
    for i, t in pairs(after):
        if i in changed:  # the halves of characters at the cuts are gone too
            assert 0 <= changed[i][1] - changed[i][2] - len((t or "").encode()) <= 6 * changed[i][3]
    before, after = steps["packing"]
    check_packing([tuple(r) for r in after.select(*COLUMNS).collect()], pieces_of(pairs(before), 2048), 2048)


@needs_data
def test_stages_on_documents(spark, tmp_path):
    steps = through(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path, SF)
    check_steps(steps)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps["quality"][1].select("doc_id").collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good)  # 60 labels to learn from
    assert sum(i in kept for i in bad) <= 0.1 * len(bad) + 1


@needs_data
def test_stages_on_edge_cases(spark, tmp_path, edge_docs):
    docs = edge_docs.where("length(text) < 5000 or text is null")
    sf = tmp_path / "sf"
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
    steps = through(spark, docs, tmp_path, str(sf))
    assert steps["quality"][1].count() == sum(len(t or "") < 5000 for _, t in edge_rows())
    check_steps(steps)


def test_stages_on_an_empty_table(spark, tmp_path, no_docs):
    sf = tmp_path / "sf"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
    for _, out in through(spark, no_docs, tmp_path, str(sf)).values():
        assert out.count() == 0


@needs_data
def test_run_is_registered(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert corpus_pipeline.run(spark, SF).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    line, ok = compare(spark, oracle_connection(SF), name, SF)
    assert ok, line
