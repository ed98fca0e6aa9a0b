import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402

from lociweave.llm import chat_prefix, queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"
N = {1: "doc_id", 2: "doc_id", 3: "doc_id", 4: "sequence_id", 5: "doc_id", 6: "doc_id", 7: "doc_id", 8: "doc_id", 9: "doc_id", 10: "conv_id"}


def write(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    body = " ".join(f"w{k}" for k in range(3000))
    leak = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, "you idiot, you moron, you stupid worthless loser"), (2, "clean text"), (3, "clean  text"), (4, body), (5, body + " more"), (6, f"before {leak} after"), (7, None), (8, ""),
        (None, "nameless"), (9, "one two three"),
    ]
    write(spark, tmp_path, [(i, t, "en", "s", 1) for i, t in docs], [(2, 1, 0)], [(1, leak)])
    kept, table = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == list(cp.COLUMNS), name
        table.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in table.collect()})
    assert kept == [{2, 3, 4, 5, 6, 7, 8, None, 9}, {2, 4, 5, 6, 7, None, 9}, {2, 4, 6, 7, None, 9}, {2, 4, 7, None, 9}]
    out = cp.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == kept[-1]
    assert sum(len(np.frombuffer(r["ids"], "<u4")) for r in out) == sum({r["doc_id"]: r["doc_tokens"] for r in out}.values())


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_every_query_runs_over_whole_tables(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for k, column in N.items():
        name = next(q for q in queries.QUERIES if q.startswith(f"op{k}_"))
        out = queries.QUERIES[name](spark, SMALL)
        if column == "doc_id" and k != 9:
            assert out.count() == n, name
        elif k == 9:
            assert out.select("doc_id").distinct().count() == n
        assert column in out.columns


def test_template_names_are_escaped():
    assert chat_prefix.TURN[0] == "<" == chat_prefix.END[0]
