import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from lociweave.llm import _shared, exact_dedup, simhash

DOCS = "doc_id long, text string, kept string, row long, group_size long, fp long, h long, component_id long"


def docs(spark, rows, parts=3):
    """Rows with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in rows], DOCS).repartition(parts)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (None, "a b"), (None, "zz"), (7, "zz "), (8, "x" * 200_000), (4, "x" * 200_000), (6, "only"), (6, "only"), (10, " ")]


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((i, low(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids), key=str)


def test_exact_against_brute_force(spark):
    got = exact_dedup.mark_duplicates(docs(spark, ROWS)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(ROWS)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_many_rounds(spark):
    """More slots, several rounds, one text in a third of the rows."""
    r = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"t{r.randrange(300)}") for i in range(900)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 50)
        got = exact_dedup.mark_duplicates(docs(spark, rows, 7)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(((x["doc_id"], x["keep_id"], x["group_size"], x["text_sha256"]) for x in got), key=str) == brute(rows)


def test_exact_drop_keeps_columns_and_rows(spark):
    got = exact_dedup.drop_duplicates(docs(spark, ROWS))
    assert got.columns == docs(spark, []).columns
    ids = sorted(str(r["doc_id"]) for r in got.collect())
    assert ids == sorted(map(str, [3, 1, 7, 4, 6, 10, None])), ids
    assert exact_dedup.drop_duplicates(docs(spark, [])).count() == 0
    assert exact_dedup.mark_duplicates(docs(spark, [])).count() == 0


def test_drops_with_clashing_names(spark):
    names = ("own_key", "may", "gone_id", "gone_key", "own", "word", "bits", "probe")
    odd = docs(spark, ROWS).select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    for drop in (exact_dedup.drop_duplicates, simhash.drop_near_duplicates):
        got = drop(odd)
        assert got.columns == odd.columns and {tuple(r)[2:] for r in got.collect()} == {names}
    assert sorted(str(r["doc_id"]) for r in exact_dedup.drop_duplicates(odd).collect()) == sorted(map(str, [3, 1, 7, 4, 6, 10, None]))


def test_bit_filters_miss_nothing(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    for held, words in ((df.filter("id < 3000"), _shared.BitFilter.WORDS), (df.filter("id < 15000"), 1 << 10)):
        had = _shared.BitFilter.WORDS
        try:
            _shared.BitFilter.WORDS = words
            told = _shared.BitFilter(held, "h", held.count()).told(df, F.col("h"), "may")
            n, hit = held.count(), told.join(held, "id", "left_semi").filter("may").count()
            assert hit == n and told.columns == ["h", "id", "may"]
            if words > 1 << 10:
                assert told.filter("may").count() < 1.1 * n
        finally:
            _shared.BitFilter.WORDS = had


def test_runs_merge_like_one_sort():
    r = np.random.default_rng(5)
    for n in (0, 1, 7, 200):
        rows = np.zeros(n, exact_dedup.RECORD)
        rows["key"] = [f"{k:048d}".encode() for k in r.integers(0, max(1, n // 3), n)]
        rows["no_id"], rows["doc_id"], rows["row"], rows["size"] = r.integers(0, 2, n), r.integers(0, 5, n), np.arange(n), 1
        parts = [exact_dedup.sorted_run(rows[k::5]) for k in range(5)]
        assert exact_dedup.merge_runs(parts).tobytes() == exact_dedup.sorted_run(rows).tobytes()


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints():
    for t in ("", " ", "One", "one TWO", "a b c", "a b c a b c a b c", "É à b c d", "x " * 5000, "ÀB Cd\x0bE f"):
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t), t


def linked(codes, radius):
    up = {c: c for c in codes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    codes = sorted(set(codes))
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= radius:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {c: root(c) for c in codes}


def some_codes(seed, n):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)] + [0, (1 << 64) - 1]
    while len(out) < 3 * n:
        out.append(r.choice(out) ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    return out


def test_bk_tree_finds_all_in_the_radius():
    codes = some_codes(2, 60)
    tree = simhash.BKTree(codes)
    asked = np.array(codes[::5], np.uint64)
    for radius in (0, 1, 3, 6):
        got = sorted((at, q) for at, hit, _ in tree.near(asked, radius) for q in hit.tolist())
        assert got == [(k, q) for k, c in enumerate(codes) for q, a in enumerate(codes[::5]) if (c ^ a).bit_count() <= radius]
    assert list(simhash.BKTree().near(asked, 3)) == []


def test_forests_connect_what_links_connect():
    for seed in range(30):
        codes = list(dict.fromkeys(some_codes(seed, 12)))
        for tree, queries in ((codes, None), (codes[::2], codes[1::2])):
            edges = [(a, b) for a in tree for b in (tree if queries is None else queries) if (a ^ b).bit_count() <= 3]
            up = {c: c for c in codes}

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in edges:
                up[max(root(a), root(b))] = min(root(a), root(b))
            got = dict(simhash._forest(tree, queries, 3))
            assert {c: got.get(c, c) for c in codes} == {c: root(c) for c in codes}


def test_shortest_forests():
    """As long as that of all links taken by length, whether looked at one by one or through a tree."""
    r = random.Random(8)
    for n in (5, 12, 40, 90):
        codes = list(dict.fromkeys(some_codes(n, n)))[:n]
        every = [(c, k, k // 2 if k % 7 == 0 else k, [k + 1] if k % 5 == 0 else None, r.randint(8, 10)) for k, c in enumerate(codes)]
        for tree, queries in ((every, None), (every[::2], every[1::2])):
            pairs = []
            for a in tree:
                for b in queries or every:
                    d = (a[0] ^ b[0]).bit_count()
                    if a[1] != b[1] and d <= 6 and 10 * min(a[4], b[4]) >= 9 * max(a[4], b[4]) and b[1] not in (a[3] or ()) and a[1] not in (b[3] or ()):
                        pairs.append((d, a, b))
            up = {v[2]: v[2] for v in every}

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x

            want = []
            for d, a, b in sorted(pairs, key=lambda x: x[0]):
                if root(a[2]) != root(b[2]):
                    up[root(a[2])] = root(b[2])
                    want.append(d)
            both = {v[1]: [*(v[3] or ()), *(w[1] for w in every if v[1] in (w[3] or ()))] for v in every}
            tree, queries = ([(*v[:3], both[v[1]], v[4]) for v in x] if x else None for x in (tree, queries))
            got = simhash._shortest(tree, queries, 6, 0.9)
            assert sorted((codes[a] ^ codes[b]).bit_count() for a, b in got) == sorted(want), (n, queries is None)


@pytest.mark.parametrize(("blocks", "tree_nodes"), [(4, 2048), (4, 8), (5, 8), (6, 64)])
def test_components_against_brute_force(spark, blocks, tree_nodes):
    codes = some_codes(blocks, 60)
    signed = {c - (1 << 64) if c >> 63 else c: c for c in codes}
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.forest(nodes, 3, tree_nodes, blocks)).collect()}
    want = linked(codes, 3)
    for a in signed:
        for b in signed:
            assert (got.get(a, a) == got.get(b, b)) == (want[signed[a]] == want[signed[b]])


def test_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (500, 502)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500, 502: 500}


def test_near_duplicates_end_to_end(spark):
    r = random.Random(3)
    base = " ".join(f"w{r.randrange(5000)}" for _ in range(3000))
    near = base + " tail"
    rows = [(4, base), (2, near), (9, base), (3, "short one"), (8, None), (7, ""), (None, "lonely words here now"), (5, "é" * 50_000)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = linked(list(fps.values()), 3)
    for x in got:
        assert x["fingerprint"] == f"{fps[x['doc_id']]:016x}"
        same = [i for i in fps if i is not None and want[fps[i]] == want[fps[x["doc_id"]]]]
        assert x["component_id"] == min(same, default=None)
    assert {x["doc_id"]: x["component_id"] for x in got}[9] == 2
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == ["2", "3", "5", "7", "None"] and kept.columns == docs(spark, []).columns
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    """Only the copy goes, not another text with its doc_id or without one."""
    r = random.Random(4)
    a, b, c = (" ".join(f"{k}{r.randrange(5000)}" for _ in range(2000)) for k in "abc")
    rows = [(1, a), (5, a + " x"), (5, b), (None, a + " y"), (None, c), (None, c + " z")]
    got = simhash.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted(x["text"] for x in got) == sorted([a, b, c, c + " z"])


def test_a_hot_text_is_split(spark):
    """A text in two thirds of the rows doesn't meet in one task of the last join."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k) for k in conf}
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(6000)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for f in (exact_dedup.mark_duplicates, simhash.near_duplicates):
            out = f(docs(spark, rows, 6))
            assert len(out.collect()) == 6000
            assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
