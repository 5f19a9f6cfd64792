import os
import subprocess
import sys

import corpus_pipeline
from hubtrace.llm import line_dedup, pii, quality_classifier, simhash
from llm_docs import CLASHING, ODD, docs_of

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_one_by_one(spark):
    """Each stage against what its operator says about the same input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "simhash_near_dedup", "pii", "packing"]

    good = stages["quality_classifier"](spark, docs, SF).cache()
    judged = quality_classifier.quality_classifier(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in judged if r["predicted"] == 1}
    assert 100 < good.count() < docs.count()

    lines = stages["line_dedup"](spark, good, SF).cache()
    done = line_dedup.line_dedup(good).collect()
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {r["doc_id"]: r["text"] for r in done if not r["emptied"]}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = stages["simhash_near_dedup"](spark, lines, SF).cache()
    groups = {r["component_id"] for r in simhash.near_duplicates(lines).collect()}
    assert {r["doc_id"] for r in single.collect()} == groups

    masked = stages["pii"](spark, single, SF).cache()
    assert masked.count() == single.count()
    assert not any(any(pii.base_spans(r["text"]).values()) for r in masked.collect())

    packed = stages["packing"](spark, masked, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in masked.collect()}
    for frame in (good, lines, single, masked):
        assert frame.columns == columns

    whole = corpus_pipeline.run(spark, SF)
    key = lambda r: (r["doc_id"], r["piece"], r["n_tokens"], r["bucket"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, packed))


def test_stages_take_odd_and_empty_tables(spark):
    for rows in (ODD, []):
        docs = docs_of(spark, rows, CLASHING)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = stage(spark, docs, SF)
            assert docs.columns == columns, name
            assert all(r[c] == "x" for r in docs.collect() for c in CLASHING), name
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_entry_without_the_subpackage(tmp_path):
    """The other queries still register when the llm folders and the pipeline are gone."""
    subprocess.run(["cp", "-r", f"{ROOT}/hubtrace", f"{ROOT}/__spark_entry__.py", f"{ROOT}/hubtrace_oracle.py", tmp_path], check=True)
    subprocess.run(["find", tmp_path, "-name", "llm", "-exec", "rm", "-r", "{}", "+"], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    count, extra, _ = out.split()
    assert int(count) >= 37 and extra == "False"
