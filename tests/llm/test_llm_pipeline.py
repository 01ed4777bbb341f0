"""The pipeline's stages on the small tables, and what is left without the subpackage."""

import os
import subprocess
import sys
from collections import Counter

import pytest
from edge import SCHEMA, WORD, collect, documents, rows

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm.packing import VOCABULARY, load_encoding
from tidemark.llm.queries import ORACLE, QUERIES

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_stages_in_order_and_what_each_keeps(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in collect(docs)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r["doc_id"]: r for r in collect(docs)}
        assert after.keys() <= before.keys() and all(WORD.search(r["text"]) for r in after.values())
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        if name == "line_dedup":
            assert all(r["n_chars"] == len(r["text"]) for d, r in after.items() if r["text"] != before[d]["text"])
            assert any(r["text"] != before[d]["text"] for d, r in after.items())
        before = after
    with open(VOCABULARY, "rb") as f:
        encode = load_encoding(f.read()).encode_ordinary
    placed = Counter()
    for r in collect(corpus_pipeline.packing(spark, docs, SF)):
        placed[r["doc_id"]] += r["n_tokens"]
    assert placed == Counter({d: len(encode(r["text"])) for d, r in before.items()})


def test_run_equals_the_stages(spark):
    got = collect(corpus_pipeline.run(spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    key = ("doc_id", "start", "n_tokens")
    assert sorted(tuple(r[k] for k in key) for r in got) == sorted(tuple(r[k] for k in key) for r in collect(docs))


def test_stages_take_awkward_documents(spark):
    for docs in (documents(spark, null_id=False, repeat=False).select("doc_id", "text", "lang"), spark.createDataFrame(rows([]), SCHEMA).select("doc_id", "text", "lang")):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert docs.count() <= n or name == "packing"


def test_queries_are_registered_once():
    assert [f"op{n}_" for n in range(1, 14)] == [f"{q.split('_')[0]}_" for q in sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0]))]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_the_rest_imports_without_the_subpackage(tmp_path):
    (tmp_path / "tidemark").mkdir()
    for p in os.listdir(os.path.join(ROOT, "tidemark")):
        if p not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "tidemark", p), tmp_path / "tidemark" / p)
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(ROOT, "__spark_entry__.py")).read())
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), [x for x in q if x.startswith('op') or x == 'pipeline'])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split(" ", 1)[1].strip() == "[]" and int(done.stdout.split()[0]) > 40


def test_short_lines_repeat_only_once(spark):
    docs = spark.createDataFrame([(1, "Les.\nown one"), (2, "own two\nLes."), (3, "own three\n\u4e00\u4e8c\u4e09"), (4, "\u4e00\u4e8c\u4e09\nown  four")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in collect(corpus_pipeline.line_dedup(spark, docs, SF))}
    assert got == {1: "Les.\nown one", 2: "own two", 3: "own three\n\u4e00\u4e8c\u4e09", 4: "own  four"}


def test_texts_with_letters_stay_without_labels(spark):
    docs = documents(spark).select("doc_id", "text", "lang")
    left = Counter(r["text"] for r in collect(corpus_pipeline.language_id(spark, docs, SF)))
    assert left == Counter(r["text"] for r in collect(docs) if any(c.isalpha() for c in r["text"] or ""))


def test_stages_take_labelled_awkward_documents(spark):
    docs = documents(spark).selectExpr("doc_id", "text", "case when doc_id % 2 = 0 then 'xx' when doc_id % 3 = 0 then 'yy' end as lang")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() > 20, name
