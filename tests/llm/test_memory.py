import random
import tracemalloc
from functools import partial

import pyarrow as pa
from pyspark.sql import functions as F

from lociweave.llm import simhash, tokens
from lociweave.llm._shared import BATCH_BYTES


def test_texts_go_to_python_in_small_batches(spark):
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 600).alias("text"))
    simhash.fingerprints(docs)

    def sizes(batches):
        for rows in batches:
            yield pa.RecordBatch.from_arrays([pa.array([rows.num_rows]), pa.array([rows.nbytes])], ["n", "bytes"])

    got = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 4000 and max(r["bytes"] for r in got) < 1.1 * BATCH_BYTES


def test_a_large_shard_is_searched_in_little_memory():
    r = random.Random(3)
    nodes = [(r.getrandbits(64), k, k, None, 100) for k in range(4096)]
    tracemalloc.start()
    try:
        simhash._shortest(nodes[:2048], nodes[2048:], 0, 0.8)
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()


def test_pairs_of_a_shard_leave_in_small_batches():
    n = 300
    bits = simhash._parities(simhash.shingle_set(b"a b c d e f g h"))
    cols = [pa.array([0] * n, kind) for kind in (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())]
    cols += [pa.array(range(n)), pa.array(range(n)), pa.array([4] * n), pa.array([0] * n), pa.array([bits] * n)]
    rows = pa.RecordBatch.from_arrays(cols, ["combo", "part", "i", "j", "sub", "name", "component", "n", "at", "few"])
    got = list(simhash._search(partial(simhash._across, least=0.8), 5)(iter([rows])))
    pairs = [p for x in got for p in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    assert len(pairs) == n * (n - 1) // 2 == len({frozenset(p) for p in pairs})
    assert max(x.num_rows for x in got) <= 4096


def test_the_slower_library_is_loaded_only_where_needed():
    e = tokens.Encoder(tokens.default_vocabulary())
    ids = e.ids("some words")
    assert "_own" not in vars(e)
    assert ids == e.plain_ids("some words") and "_own" in vars(e)


def test_few_links_are_closed_as_by_stars(spark):
    r = random.Random(8)
    pairs = [(r.randrange(-300, 300) << 40, r.randrange(-300, 300) << 40) for _ in range(260)] + [(k, k + 1) for k in range(40)] + [(7, 7), (9999, 9999)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    stars = {tuple(x) for x in simhash.components(links, at_once=0).collect()}
    at_once = simhash.components(links).collect()
    assert {tuple(x) for x in at_once} == stars and len(at_once) == len(stars) > 200
    assert simhash.components(links.limit(0)).collect() == []


def test_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long").repartition(5)
    context = spark.sparkContext
    context.setJobGroup("few-links", "links of one chain")
    try:
        assert simhash.components(links).count() == 200
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("few-links")) <= 10
