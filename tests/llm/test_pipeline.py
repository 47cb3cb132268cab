"""The pipeline stage by stage on the smallest tables, and its import guard."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_packing import check_layout
from test_simhash import brute_classes, brute_fingerprint
from test_suffixes import brute as brute_repeats
from weir.llm import toxicity

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_do_what_they_say(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    assert names == ["toxicity", "near_duplicates", "repeated_passages", "packing"]

    kept = corpus_pipeline.pinned(stages["toxicity"](spark, docs, data))
    assert kept.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    fine = {r.doc_id for r in toxicity.graded(docs, model).collect() if not r.rejected}
    assert {r.doc_id for r in kept.collect()} == fine

    single = corpus_pipeline.pinned(stages["near_duplicates"](spark, kept, data))
    assert single.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    label = brute_classes(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    first = {d for d in fps if label[d] == d}
    assert {r.doc_id for r in single.collect()} == first

    cut = corpus_pipeline.pinned(stages["repeated_passages"](spark, single, data))
    assert cut.columns == docs.columns
    want = {r[0]: r[5].decode("utf-8", "ignore") for r in brute_repeats([(d, texts[d]) for d in first], 100)}
    rows = cut.collect()
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)

    packed = stages["packing"](spark, cut, data).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes, ids = {}, {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
        ids[r.doc_id] = ids.get(r.doc_id, []) + r.ids
    assert ids == {d: library.encode(t, add_special_tokens=False).ids + [0] for d, t in want.items()}
    assert sizes == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    assert check_layout(packed, 2048) <= 1.1 * sum(sizes.values()) / 2048 + 1


def test_run_applies_all_stages(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


def test_stages_on_an_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.pinned(stage(spark, docs, data))
        assert docs.count() == 0, name


def test_stages_bear_any_rows_and_column_names(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 40")
    odd = spark.createDataFrame([(None, None), (900, None), (901, ""), (902, "\u00e9"), (903, "word " * 30_000), (3, None)], "doc_id long, text string")
    rows = docs.unionByName(odd, allowMissingColumns=True).unionByName(docs.limit(3)).withColumns({
        "_null": F.lit(1), "two words": F.lit("x"), "a.b": F.lit(2.0), "kept": F.lit("k"), "c0": F.lit(None).cast("int"), "`q`": F.lit(True)})
    n = rows.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        rows = corpus_pipeline.pinned(stage(spark, rows, data))
        assert rows.columns[-6:] == ["_null", "two words", "a.b", "kept", "c0", "`q`"] and 0 < rows.count() <= n
        values = {tuple(r)[-6:] for r in rows.collect()}
        assert values == {(1, "x", 2.0, "k", None, True)}, name
    left = {r.doc_id for r in rows.collect()}
    assert None in left and 902 in left and not {900, 901} & left          # no words: the least id of them stays, 3
    assert corpus_pipeline.STAGES[3][1](spark, rows, data).count() >= rows.count()


def test_the_rest_works_without_these_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": ""})
