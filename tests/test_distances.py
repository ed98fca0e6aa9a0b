import numpy as np
import pytest

from lociweave.functions.synthetic import synthetic_profile
from lociweave.operators import distance, encode, weights
from lociweave.plans.params import Heuristic, Matrix, Missing
from lociweave.sources import profiles, sinks


def matrix(spark, text, kind=Matrix.SYMMETRIC, missing=Missing.PAIR_DELETE, block=2):
    nodes = encode.nodes_of(profiles.read_profile(spark, text=text), missing)
    names = {r["node_id"]: r["name"] for r in nodes.collect()}
    return {(names[r["i"]], names[r["j"]]): r["d"] for r in distance.distances(nodes, kind, missing, block=block).collect()}


#: Four samples; loci q, r and s are each missing in one of them.
SPARSE = "#n\tp\tq\tr\ts\nK\t1\t2\t1\t1\nL\t1\t-\t2\t1\nM\t2\t2\t-\t-\nP\t2\t1\t1\t2"
GAPS = "#n\ta\tb\tc\td\nA\t1\t0\t1\t1\nB\t2\t1\t0\t1\nC\t1\t1\t1\t2\nD\t0\t2\t1\t1\nE\t3\t3\t0\t0"


def test_presence_weighted(spark):
    """Worked by hand: q is in K, M and P, so two others both have it with a chance of
    3 x 2 / (4 x 3) = 0.5; r and s alike.  L to P: p, r and s differ and q is missing in L,
    3.5 of P's four loci.  M to K: p differs, r and s are missing in M.  P to M: of M's
    two loci q differs.  L to M: p differs, q is missing in L."""
    d = matrix(spark, SPARSE, Matrix.ASYMMETRIC_WGMLST)
    assert [d[x] for x in (("L", "P"), ("M", "K"), ("P", "M"), ("L", "M"))] == [3.5, 2.0, 2.0, 3.0]


def test_symmetric_plain(spark):
    d = matrix(spark, "#n\ta\tb\tc\td\te\nu\t3\t3\t3\t3\t3\nv\t3\t3\t3\t9\t9\nw\t9\t9\t9\t9\t9")
    assert [round(d[p]) for p in (("u", "v"), ("u", "w"), ("v", "w"))] == [2, 5, 3]
    assert all(d[x, x] == 0 and d[x, y] == d[y, x] for x in "uvw" for y in "uvw")


def test_against_cells(spark):
    """Every rule against a plain loop over the cells."""
    loci = 4
    raw = {"A": [1, 0, 1, 1], "B": [2, 1, 0, 1], "C": [1, 1, 1, 2], "D": [0, 2, 1, 1], "E": [3, 3, 0, 0]}
    for kind, missing in [(Matrix.SYMMETRIC, m) for m in (Missing.PAIR_DELETE, Missing.AS_ALLELE, Missing.ABSOLUTE_DISTANCE)] + [(Matrix.ASYMMETRIC, m) for m in (Missing.PAIR_DELETE, Missing.ABSOLUTE_DISTANCE)]:
        got = matrix(spark, GAPS, kind, missing)
        for x, a in raw.items():
            for y, b in raw.items():
                if x == y:
                    continue
                both = [(p, q) for p, q in zip(a, b) if p and q]
                pd_ = sum(p != q for p, q in both)
                neq = sum(p != q for p, q in zip(a, b))
                gone = sum(p != q for p, q in zip(a, b) if q)
                want = {
                    (Matrix.SYMMETRIC, Missing.PAIR_DELETE): (pd_ + 0.01) * loci / (len(both) + 0.01),
                    (Matrix.SYMMETRIC, Missing.AS_ALLELE): neq,
                    (Matrix.SYMMETRIC, Missing.ABSOLUTE_DISTANCE): pd_,
                    (Matrix.ASYMMETRIC, Missing.PAIR_DELETE): gone * loci / sum(q > 0 for q in b),
                    (Matrix.ASYMMETRIC, Missing.ABSOLUTE_DISTANCE): gone,
                }[kind, missing]
                assert got[x, y] == pytest.approx(want, rel=1e-6), (kind, missing, x, y)


def test_expressions_agree_with_the_kernel(spark):
    nodes = encode.nodes_of(profiles.read_profile(spark, text=GAPS))
    for missing in (Missing.PAIR_DELETE, Missing.AS_ALLELE, Missing.ABSOLUTE_DISTANCE):
        a = sorted(map(tuple, distance.distances(nodes, missing=missing).collect()))
        assert a == sorted(map(tuple, distance.distances_sql(nodes, missing).collect()))


def test_shuffled_tiles_give_the_same(spark, monkeypatch):
    made = synthetic_profile(spark, 60, 20, mutation=0.2, missing=0.1, seed=3)
    nodes = encode.nodes_of(made)
    n = nodes.count()
    kinds = ((Matrix.ASYMMETRIC, Missing.PAIR_DELETE), (Matrix.SYMMETRIC, Missing.PAIR_DELETE), (Matrix.BLOCKWISE, Missing.PAIR_DELETE), (Matrix.SYMMETRIC, Missing.AS_ALLELE))
    cells = lambda: [sorted(map(tuple, distance.distances(nodes, *k, block=3).collect())) for k in kinds]
    strips = cells()
    rects = distance.rectangles(nodes, *kinds[0], block=7)
    whole = distance.as_matrix(iter(rects.toArrow().to_batches()), n)
    monkeypatch.setattr(distance, "BROADCAST_BYTES", 0)
    assert cells() == strips and all(len(c) == n * n for c in strips)
    assert whole.tolist() == [[d for i, _, d in strips[0] if i == k] for k in range(n)]
    assert sorted(map(tuple, distance.cells_of(distance.rectangles(nodes, *kinds[0], block=7)).collect())) == strips[0]


def test_codes_of_any_width():
    r = np.random.default_rng(2)
    for top in (3, 254, 255, 70_000):
        a, b = r.integers(0, top + 1, (9, 130)), r.integers(0, top + 1, (300, 130))
        b[:9] = np.where(r.random((9, 130)) < 0.5, a, b[:9])
        both = (a[:, None] > 0) & (b[None] > 0)
        differ = (both & (a[:, None] != b[None])).sum(2)
        got = distance.kernel(distance.packed(a), distance.packed(b), Matrix.SYMMETRIC, Missing.ABSOLUTE_DISTANCE, 130, 0.5, None, None)
        assert (got == differ).all()


def test_blockwise_runs():
    a, b = np.array([[1, 1, 1, 5, 2, 0, 0]]), np.array([[2, 2, 2, 5, 1, 3, 3]])
    # deltas -1 -1 -1 0 1 -3 -3: three runs over six places
    assert distance.kernel(a, b, Matrix.BLOCKWISE, Missing.PAIR_DELETE, 7, 0.5, None, None)[0, 0] == 3 + 3 * 0.5


def test_phylip(spark):
    nodes = encode.nodes_of(profiles.read_profile(spark, text="#n\ta\tb\nx\t1\t1\ny\t1\t2\nz\t1\t1"), Missing.ABSOLUTE_DISTANCE)
    cells = sinks.phylip_cells(nodes, distance.distances(nodes, missing=Missing.ABSOLUTE_DISTANCE))
    lines = [r["line"] for r in sinks.phylip_lines(cells).orderBy("row_node", "row_name").collect()]
    assert lines == ["    3", "x          0.000000 0.000000 1.000000", "z          0.000000 0.000000 1.000000", "y          1.000000 1.000000 0.000000"]


def test_no_nodes(spark):
    assert matrix(spark, "n\ta") == {}


def _frames(spark, m, sizes):
    nodes = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "node_id long, n_str int")
    dist = spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(m) for j, x in enumerate(r)], "i long, j long, d double")
    return nodes, dist


def test_weights_by_hand(spark):
    """Four points on a line, at 7, 0, 3 and 2.  Sums of 1 / (d + 0.1) beside the own 10:
    0.581, 0.940, 1.476 and 1.581, so the last is most central and the first least.  The
    last two have a neighbour at 1, the last and the second one at 2: the same order."""
    at = [7, 0, 3, 2]
    m = [[abs(x - y) for y in at] for x in at]
    nodes, dist = _frames(spark, m, [1] * 4)
    for h in Heuristic:
        got = [r["weight"] for r in weights.weights(nodes, dist, h).orderBy("node_id").collect()]
        assert got == [0.75, 0.5, 0.25, 0.0]
    ids = np.arange(4)
    halves = [(ids[:2], ids), (ids[2:], ids[2:]), (ids[2:], ids[:2])]
    rects = spark.createDataFrame([tuple(bytearray(x.tobytes()) for x in (i, j, np.array(m, np.float32)[np.ix_(i, j)])) for i, j in halves], distance.RECTANGLES)
    assert [r["rank"] for r in weights.harmonic_exact(nodes, rects).orderBy("node_id").collect()] == [3, 2, 1, 0]


def test_larger_groups_win_ties(spark):
    nodes, dist = _frames(spark, [[0, 2], [2, 0]], [1, 3])
    assert [r["rank"] for r in weights.harmonic(nodes, dist).orderBy("node_id").collect()] == [1, 0]
