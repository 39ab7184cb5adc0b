import os
import subprocess
import sys

import corpus_pipeline
import test_decontaminate
import test_neardup
import test_secrets
from millrace.llm import mixing, quality

FOLDER = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    kept = stages["quality classifier"](spark, docs, FOLDER)
    scores = quality.score(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert ids(kept) == ids(scores.where("predicted = 1")) and kept.columns == docs.columns
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    passed = set(ids(kept))
    assert sum((i in passed) == bool(q) for i, q in truth.items()) > 0.95 * len(truth)

    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = stages["n-gram Jaccard join"](spark, docs, FOLDER)
    assert ids(kept) == sorted({rows[c][0] for c, _ in test_neardup.by_hand(rows)}) and kept.columns == docs.columns

    kept = stages["benchmark decontamination"](spark, docs, FOLDER)
    texts = dict(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    gone = set(texts) - set(ids(kept))
    some = sorted(gone) + [i for i in sorted(texts) if i not in gone][:60]
    assert {r[0] for r in test_decontaminate.by_hand([(i, texts[i]) for i in some], items) if r[-1]} == gone and gone

    kept = stages["secret scans"](spark, docs, FOLDER)
    assert ids(kept) == sorted(i for i, t in rows if not test_secrets.by_hand(t)[4]) and kept.columns == docs.columns

    kept = stages["mixing sources to target weights"](spark, docs, FOLDER)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, mixing.mix(docs).where("taken > 0").collect()))


def test_run_is_its_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema if stage is not corpus_pipeline.source_mix else None)
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, docs.collect()))


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_rest_works_without_these_folders():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("millrace.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert len(q) > 150 and "pipeline" not in q and not any(n.startswith("op") and n[2].isdigit() for n in q)
assert not any(m.startswith("millrace.llm") for m in sys.modules)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' in q and 'op2_jaccard_join' in q"], cwd=ROOT, check=True)
