import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest

from lociweave.functions.synthetic import synthetic_profile
from lociweave.operators import branching, distance, encode, margin, mst, network, nj, recraft, tree, weights
from lociweave.plans import pipelines, queries
from lociweave.plans.estimate import check_report
from lociweave.plans.params import Heuristic, Matrix, Method, Missing, Params
from lociweave.sources import profiles

#: Four samples in a row, each one locus from the next.
CHAIN = "#n\ta\tb\tc\td\nP\t1\t1\t1\t1\nQ\t1\t1\t1\t2\nR\t1\t1\t3\t2\nS\t4\t1\t3\t2"
KERNELS = (branching.ordered_branching, branching.dense_branching, branching.lazy_branching)


def total(cost, edges):
    return sum(cost[s, t] for s, t in edges)


def cheapest(cost):
    n, best = len(cost), float("inf")
    for up in itertools.product(range(-1, n), repeat=n):
        if up.count(-1) != 1 or any(up[v] == v for v in range(n)):
            continue
        for v in range(n):
            x, steps = v, 0
            while x != -1 and steps <= n:
                x, steps = up[x], steps + 1
            if steps > n:
                break
        else:
            best = min(best, sum(cost[up[v], v] for v in range(n) if up[v] >= 0))
    return best


def test_branchings_are_optimal():
    r = random.Random(3)
    for _ in range(120):
        n = r.randint(2, 5)
        cost = np.array([[r.randint(0, 6) for _ in range(n)] for _ in range(n)], float)
        for f in KERNELS:
            edges = f(cost)
            assert len({t for _, t in edges}) == n - 1 == len(edges)
            assert total(cost, edges) == cheapest(cost), f.__name__


def test_branchings_cost_the_same():
    r = random.Random(4)
    for n in range(2, 31, 4):
        cost = np.array([[r.randint(0, 49) for _ in range(n)] for _ in range(n)], float)
        assert len({total(cost, f(cost)) for f in KERNELS}) == 1


def test_branching_of_a_chain(spark):
    """2 to 0 to 3 to 1 costs 6; any other root needs an edge of 8."""
    chain = np.full((4, 4), 8.0)
    for s, t, c in ((2, 0, 2), (0, 3, 1), (3, 1, 3)):
        chain[s, t] = c
    for f in KERNELS:
        assert sorted(f(chain)) == [(0, 3), (2, 0), (3, 1)]
    text = "\n".join("\t".join(map(str, row)) for row in chain)
    assert sorted(map(tuple, pipelines.branching_of_matrix(spark, text=text).collect())) == [(0, 3), (2, 0), (3, 1)]


def plain_kruskal(rows):
    up, out = {}, []

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for c, i, j in sorted((c, i, j) for i, j, c in rows):
        if root(i) != root(j):
            up[root(j)] = root(i)
            out.append((i, j, c))
    return sorted(out)


def test_kruskal_against_a_loop():
    r = random.Random(15)
    for _ in range(60):
        n = r.randint(2, 25)
        rows = [(i, j, float(r.randint(1, 4))) for i in range(n) for j in range(i + 1, n) if r.random() < 0.4]
        got = mst.kruskal(pd.DataFrame(rows, columns=["i", "j", "cost"]))
        assert sorted(map(tuple, got.itertuples(index=False))) == plain_kruskal(rows)


def test_kruskal_in_parts(spark):
    r = random.Random(5)
    rows = [(i, j, float(r.randint(1, 9))) for i in range(30) for j in range(i + 1, 30)]
    edges = spark.createDataFrame(rows, "i long, j long, cost double")
    got = [(x["i"], x["j"]) for x in mst.spanning_tree(edges.repartition(7)).orderBy("ord").collect()]
    want = mst.kruskal(pd.DataFrame(rows, columns=["i", "j", "cost"])).sort_values(["i", "cost", "j"])
    assert got == list(zip(want["i"], want["j"])) and len(got) == 29


@pytest.mark.parametrize(
    ("given", "want"),
    [
        # weights by neighbours at 1, then 2: Q, R, P, S; the edges are the row itself, from P on
        ({"method": "MSTree"}, ["(((S:1,R:0):1,Q:0):1,P:0);"]),
        # the same order by harmonic means; Q absorbs P and R, and R absorbs S; the first branch is Q's to R
        ({"method": "MSTreeV2"}, ["((S:1,R:0):1,P:1,Q:0);"]),
        ({"method": "MSTreeV2", "recraft_mode": "native", "native": True}, ["((S:1,R:0):1,P:1,Q:0);"]),
        ({"method": "MSTreeV2", "missing": 1}, []),  # no locus has a gap, so none is kept
    ],
)
def test_chain_by_hand(spark, given, want):
    got = pipelines.run(profiles.read_profile(spark, text=CHAIN), **given)
    assert [r["newick"] for r in got.collect()] == want


def test_groups_and_edge_cases(spark):
    run = lambda text, **k: [r["newick"] for r in pipelines.run(profiles.read_profile(spark, text=text), **k).collect()]
    assert run("#n\ta\tb\nx\t1\t1\ny\t1\t1", method="MSTree") == ["(x:0,y:0);"]
    assert run("#n\ta\nx\t1", method="MSTree") == ["x:0;"]
    assert run("#n\ta\tb\nx\t1\t1\ny\t1\t2\nz\t1\t1", method="MSTreeV2") == ["(y:1,(x:0,z:0):0);"]
    assert run("#n\ta\tb\nx\t1\t1\ny\t1\t2", method="NJ") == ["(x:1.004975,y:0);"]
    assert run("#n\ta\tb\nx\t1\t1\ny\t1\t2\nz\t1\t1", method="RapidNJ") == ["((x:0,z:0):1.004975,y:0);"]


def test_orientation_against_passes():
    r = random.Random(6)
    for _ in range(50):
        n = r.randint(2, 12)
        edges = [(r.randrange(v), v, float(r.randint(0, 4))) for v in range(1, n)]
        out = tree.oriented(edges, n)
        assert len(out) == n - 1 and len({c for _, c, _ in out}) == n - 1
    with pytest.raises(ValueError):
        tree.oriented([(0, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)], 4)
    with pytest.raises(ValueError):
        tree.oriented([(0, 1, 1.0)], 3)


def test_same_tree():
    assert tree.same_tree("((a:1,b:1):1,c:1,d:1);", "((c:1,d:1):1,b:1,a:1);")
    assert not tree.same_tree("((a:1,b:1):1,c:1,d:1);", "((a:1,c:1):1,b:1,d:1);")
    assert not tree.same_tree("((a:1,b:1):1,c:1,d:1);", "((a:1,b:1):2,c:1,d:1);")
    assert tree.same_tree("((a:1,b:1):1,c:1,d:1);", "((a:1,b:1):2,c:1,d:1);", lengths=False)


def test_neighbour_joining_of_an_additive_matrix():
    names = list("abcd")
    d = np.array([[0, 3, 6, 7], [3, 0, 7, 8], [6, 7, 0, 5], [7, 8, 5, 0]], float)
    assert tree.same_tree(nj.neighbour_joining(d, names), "((a:1,b:2):3,c:2,d:3);")
    assert nj.neighbour_joining(np.zeros((0, 0)), []) == ";" and nj.neighbour_joining(np.zeros((1, 1)), ["x"]) == "x;"
    assert nj.neighbour_joining(np.array([[0.0, 2], [2, 0]]), ["x", "y"]) == "(x:2,y:0);"


def test_joined_trees_are_rooted_and_tidied(spark):
    text = "((x:0.05,b:2):4,c:2,d:9);"
    out = nj.post_processed(text, {"x": ["x1", "x2"], "b": ["b"], "c": ["c"], "d": ["d"]})
    root = tree.parse_newick(out)
    leaves = {n.name: n.length for n in tree.walk(root) if not n.children}
    assert sorted(leaves) == ["b", "c", "d", "x1", "x2"] and len(root.children) > 2
    assert leaves["x1"] == leaves["x2"] == 0 and leaves["b"] == 2.05 and leaves["d"] == 9
    made = synthetic_profile(spark, 12, 40, mutation=0.3, duplicates=0.2, seed=4)
    plain = tree.parse_newick(pipelines.run(made, method="NJ").first()["newick"])
    rooted = tree.parse_newick(pipelines.neighbour_joining(made, Params.of(method="NJ"), post_process=True).first()["newick"])
    assert sorted(n.name for n in tree.walk(plain) if not n.children) == sorted(n.name for n in tree.walk(rooted) if not n.children)
    assert tree.splits(plain) == tree.splits(rooted)


def test_shortcuts_and_lent_rows():
    # C takes over nothing: it is absorbed by B before it could lend
    d = np.array([[0, 1, 2], [1, 0, 1], [2, 1, 0]], np.float32)
    w = np.array([1 / 3, 0, 2 / 3])
    assert network.shortcut_pairs(d, w) == [(1, 0), (1, 2)]
    assert network.asymmetric_network(d, w) == [(1, 0, 1.0), (1, 2, 1.0)]
    assert network.cutoff(2999) == 2 and network.cutoff(3000) == 5 and network.cutoff(30_000) == 20


def test_stored_lengths():
    w = np.array([0.0, 0.5])
    for dist, want in ((3, 2.0), (21, 21.0)):
        d = np.array([[0, dist], [dist, 0]], np.float32)
        assert [x for s, t, x in network.asymmetric_network(d, w) if (s, t) == (0, 1)] == ([want] if dist > 2 else [])


def test_contemporary_and_recraft_keep_a_tree():
    assert recraft.contemporary((1.0, 1.0), 2.0, 2.0, 10) is True
    assert recraft.contemporary((1.0, 1.0), 5.0, 1.0, 10) is False
    r = np.random.default_rng(7)
    for mode in ("compat", "native"):
        codes = r.integers(1, 4, (25, 40))
        d = (codes[:, None] != codes[None]).sum(2).astype(np.float32)
        w = np.arange(25) / 25
        edges = network.asymmetric_network(d, w)
        out = recraft.recraft(edges, d, w, 40, mode)
        assert len(out) == 24 and len(tree.oriented(out, 25)) == 24


def test_margins(spark):
    edges = [(0, 1), (1, 2), (0, 3)]
    ranges = spark.createDataFrame(margin.subtree_ranges(edges), "node long, parent long, tin long, tout long")
    d = [[0, 1, 5, 2], [1, 0, 2, 2], [9, 1, 0, 3], [2, 3, 2, 0]]
    dist = spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(d) for j, x in enumerate(r) if i != j], "i long, j long, d double")
    got = {(r["parent"], r["child"]): (r["delta"], r["k"]) for r in margin.margins(ranges, dist).collect()}
    # 2 hangs below 1, so it can't be 1's parent; 3 is as near to 2 as 1 is; 1 is as near to 3 as 0 is
    assert got == {(0, 1): (2, 1), (1, 2): (0, 2), (0, 3): (0, 2)}


def test_params():
    p = Params.of(method="MSTreeV2").resolved()
    assert (p.method, p.matrix, p.heuristic.value, p.recraft) == (Method.MSTREE, Matrix.ASYMMETRIC, "harmonic", True)
    p = Params.of(method="MSTreeV2", matrix="blockwise", recraft=True).resolved()
    assert (p.method, p.matrix, p.recraft) == (Method.MSTREE, Matrix.BLOCKWISE, False)
    with pytest.raises(ValueError):
        Params.of(method="none")
    with pytest.raises(ValueError):
        Params.of(missing=9)


def test_check_report(spark):
    rows = spark.createDataFrame([("distance", "symmetric", 1, 7, 10)], "method string, matrix string, n_proc long, n_loci long, n_profile long")
    assert check_report(rows, 1e9).first()["report"] == '{"time":5.0,"memory":5.24288E7,"affordable":true}'


def some_codes(seed, n=60, loci=70, alleles=4):
    r = np.random.default_rng(seed)
    codes = np.unique(r.integers(0, alleles, (n, loci)) * (r.random((n, loci)) < 0.9), axis=0).astype(np.uint8)
    return codes[codes.any(axis=1)]  # as nodes are


def test_network_of_a_matrix_that_is_made_as_it_is_asked_for(monkeypatch):
    """The same branches as from the whole matrix, with shortcuts and without, and when
    no in-edges of smaller components are held."""
    for seed in range(12):
        codes = some_codes(seed, alleles=4 if seed % 2 else 2, loci=70 if seed % 3 else 9)
        rule = (Matrix.ASYMMETRIC, Missing.PAIR_DELETE, codes.shape[1], 0.5, None, None)
        lazy = distance.Made(distance.Bits(codes), *rule)
        whole = distance.kernel(codes, codes, *rule)
        np.fill_diagonal(whole, 0)
        n = len(whole)
        assert (lazy.block(np.arange(n)) == whole).all() and (lazy[:, 3] == whole[:, 3]).all() and (lazy[5] == whole[5]).all()
        assert all(lazy[i, j] == whole[i, j] for i in range(n) for j in range(n))
        w = np.random.default_rng(seed).permutation(n) / n
        monkeypatch.setattr(network, "cutoff", lambda n: 2 if seed % 4 else -1)
        want = network.asymmetric_network(whole, w)
        assert network.asymmetric_network(lazy, w, short=network.shortcut_pairs(whole, w)) == want
        assert recraft.recraft(want, lazy, w, codes.shape[1]) == recraft.recraft(want, whole, w, codes.shape[1])
        cost = network.quantised(whole, w)
        for held in (0, 12 * n * 3, 1 << 30):
            assert branching.ordered_branching(cost, held) == branching.ordered_branching(network.Quantised(lazy, w), held) == branching.ordered_branching(cost)


def test_arborescence_writes_no_matrix(spark, monkeypatch):
    """The matrix of the network was written to the shared folder, 4 n^2 bytes."""
    labels = []
    monkeypatch.setattr(pipelines, "stash", lambda df, label, stash=pipelines.stash: labels.append(label) or stash(df, label))
    for name in ("arborescence", "weights_harmonic_exact", "mstreev2_newick"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert "matrix" not in labels


def test_spanning_tree_of_a_matrix_that_is_made(spark):
    """The same tree as from all edges; costs of 0 are none."""
    for seed in range(8):
        codes = some_codes(seed, n=50, loci=5 if seed % 2 else 40, alleles=3)
        m = distance.Made(distance.Bits(codes), Matrix.SYMMETRIC, Missing.PAIR_DELETE, codes.shape[1], 0.5, None, None)
        n = len(m)
        w = np.random.default_rng(seed).permutation(n) / n if seed % 3 else np.zeros(n)
        rows = [(i, j, float(np.floor(float(m[i, j]) + 0.5) + min(w[i], w[j]))) for i in range(n) for j in range(i + 1, n)]
        want = mst.kruskal(pd.DataFrame([x for x in rows if x[2]], columns=["i", "j", "cost"]))
        assert sorted(map(tuple, mst.prim(m, w).itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))
    assert len(mst.prim(distance.Made(distance.Bits(codes[:1]), *m.rule), w[:1])) == 0


def test_weights_of_strips(spark):
    """As from rows of the matrix, by either heuristic."""
    made = synthetic_profile(spark, 40, 9)
    nodes = encode.nodes_of(made)
    make, dist = distance.made(nodes), distance.distances(nodes)
    for heuristic in Heuristic:
        a, b = weights.weights_made(nodes, make, heuristic), weights.weights(nodes, dist, heuristic)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_joining_by_bounds_is_joining_all_pairs():
    for seed in range(6):
        r = np.random.default_rng(seed)
        n = 90
        x = r.random((n, 4)) if seed % 2 else some_codes(seed, n=n, loci=30)[:, :30].astype(float)
        n = len(x)
        d = np.abs(x[:, None] - x[None]).sum(-1) + r.random((n, n)) * 1e-3
        d = d + d.T
        np.fill_diagonal(d, 0)
        names = [f"x{k}" for k in range(n)]
        assert nj.neighbour_joining(d, names, few=4) == nj.neighbour_joining(d, names, few=n)


def test_joining_makes_few_passes_over_the_matrix():
    """1,500 nodes took a pass over all pairs each: 1,500^3 / 3 pairs, several minutes."""
    r = np.random.default_rng(9)
    x = r.random((1500, 5))
    d = np.abs(x[:, None] - x[None]).sum(-1)
    start = time.process_time()
    text = nj.neighbour_joining(d, [f"x{k}" for k in range(1500)], few=50)
    assert time.process_time() - start < 10 and text.count(",") == 1499


def test_rounds_over_columns_that_are_made(spark):
    """The same arborescence and margins as from the whole matrix, whatever is held."""
    for seed in range(10):
        codes = some_codes(seed, n=50, alleles=4 if seed % 2 else 2, loci=64 if seed % 3 else 9)
        rule = (Matrix.ASYMMETRIC, Missing.PAIR_DELETE, codes.shape[1], 0.5, None, None)
        bits = distance.Bits(codes)
        whole = distance.Made(bits, *rule).block(slice(None))
        n = len(whole)
        w = np.random.default_rng(seed).permutation(n) / n
        cost = np.floor(whole.astype(float) + 0.5) + w[:, None]
        want = branching.dense_branching(cost)
        for held in (0, 1 << 30):
            got = branching.round_branching(network.Rounded(distance.Made(bits, *rule), w), (codes.shape[1] + 2.0) * (n + 1), held)
            assert len({t for _, t in got}) == len(got) == n - 1
            assert abs(total(cost, got) - total(cost, want)) < 1e-6
    ranges = margin.subtree_ranges(want)
    dist = spark.createDataFrame([(i, j, float(whole[i, j])) for i in range(n) for j in range(n) if i != j], "i long, j long, d double")
    plain = margin.margins(spark.createDataFrame(ranges, "node long, parent long, tin long, tout long"), dist)
    got = margin.margins_made(spark, np.array(ranges), n, lambda: distance.Made(bits, *rule))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_margins_and_text_write_no_matrix(spark, monkeypatch):
    """Both gathered the matrix: 24 n^2 bytes in a task, and the text of a block of rows."""
    monkeypatch.setattr(distance, "rectangles", None)
    assert queries.QUERIES["margin_report"](spark, "/root/testdata/sf0.001").count()
    assert queries.QUERIES["phylip_text"](spark, "/root/testdata/sf0.001").count() == 501
