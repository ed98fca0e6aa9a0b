import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402

from lociweave.llm import simhash  # noqa: E402


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return bool(a & b) and len(a & b) / len(a | b) >= 0.8


def changed(r, text, n):
    w = text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def some_rows(seed=21):
    r = random.Random(seed)
    rows = []
    for _ in range(25):
        base = " ".join(f"w{r.randrange(3000)}" for _ in range(300))
        rows += [base, changed(r, base, 4), changed(r, base, 6), changed(r, base, 9), changed(r, base, 30)]
    hot = " ".join(f"w{r.randrange(3000)}" for _ in range(300))
    rows += [changed(r, hot, 3) for _ in range(40)]
    rows += ["a b c", "A  b c", "a b d", "", None, " "]
    r.shuffle(rows)
    return list(enumerate(rows))


def expected(rows):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if alike(a, b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(i for i in up if root(i) == i)


def test_similar_against_all_pairs(spark):
    rows = some_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = expected(rows)
    assert len(want) < len(rows) - 60
    for parts in (2048, 7):
        assert sorted(x["doc_id"] for x in simhash.drop_similar(frame, tree_nodes=parts).collect()) == want
    assert simhash.drop_similar(frame.limit(0)).count() == 0


def test_stage_drops_copies_beyond_three_bits(spark):
    r = random.Random(22)
    base = " ".join(f"w{r.randrange(3000)}" for _ in range(300))
    near = next(t for t in iter(lambda: changed(r, base, 5), None) if (simhash.fingerprint(t.encode()) ^ simhash.fingerprint(base.encode())).bit_count() > 3)
    assert alike(base, near)
    rows = [(2, base, "en", "s", 1), (1, near, "en", "s", 1), (3, changed(r, base, 60), "en", "s", 1), (None, "x y z", "en", "s", 1), (4, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"] for x in cp.drop_near_copies(spark, docs, "").collect()} == {1, 3, None, 4}


def bits_apart(a, b):
    # pairs of the stage are told apart by fingerprints of five words
    a, b = (simhash.fingerprint(t.encode(), 5) for t in (a, b))
    return (a ^ b).bit_count()


def test_links_beyond_the_radius_are_found(spark):
    r, rows = random.Random(23), []
    while len(rows) < 12:
        words = [f"w{r.randrange(10**6)}" for _ in range(13)]
        a, b = " ".join(words), " ".join([*words[:-1], f"w{r.randrange(10**6)}"])
        if bits_apart(a, b) > simhash.SIMILAR_RADIUS:  # 8 of 10 five-word shingles are in both
            assert alike(a, b)
            rows += [a, b]
    rows += [changed(r, t, 1) for t in rows[:4]]
    rows = list(enumerate(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = expected(rows)
    assert len(want) <= len(rows) - 6
    assert sorted(x["doc_id"] for x in simhash.drop_similar(frame).collect()) == want


def test_no_link_depends_on_the_trees(spark):
    r, rows = random.Random(24), some_rows(24)
    passage = " ".join(f"p{k}" for k in range(60))  # in many texts that are no copies
    rows += list(enumerate((passage + " " + " ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(5, 40))) for _ in range(60)), len(rows)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = expected(rows)
    for parts in (2048, 7):
        kept = simhash.drop_similar(frame, radius=2, anchors=1, rounds=1, tree_nodes=parts)
        assert sorted(x["doc_id"] for x in kept.collect()) == want


def test_bounds_hold_for_sets():
    import numpy as np

    r = np.random.default_rng(25)
    for n in (1, 2, 5, 40, 300, 3000):
        for k in sorted({0, 1, n // 12, n // 9, n // 5}):
            x = np.unique(r.integers(0, 1 << 63, n, np.uint64))
            y = np.unique(np.concatenate([x[min(k, n - 1) :], r.integers(0, 1 << 63, k, np.uint64)]))
            both = len(np.intersect1d(x, y))
            assert simhash._differ(simhash._parities(x), simhash._parities(y)) <= len(x) + len(y) - 2 * both
            if both >= 0.8 * (len(x) + len(y) - both):
                known = np.sort(r.choice(x, n // 2, replace=False))
                for often in ((known[:0], known[:0]), (known, r.integers(4, 9, n // 2))):
                    assert np.intersect1d(simhash._prefix(x, 0.8, often), simhash._prefix(y, 0.8, often)).size
