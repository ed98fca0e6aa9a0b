import numpy as np
import pytest

from lociweave.functions.synthetic import synthetic_profile
from lociweave.operators import distance, nj
from lociweave.plans import pipelines
from lociweave.plans.params import Matrix, Missing, Params


def _codes(n, loci, groups, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 6, (groups, loci))
    codes = np.where(rng.random((n, loci)) < 0.3, rng.integers(1, 12, (n, loci)), base[rng.integers(0, groups, n)])
    return np.unique(np.where(rng.random((n, loci)) < 0.03, 0, codes), axis=0)


def _both(codes, few, missing=Missing.PAIR_DELETE):
    n, bits = len(codes), distance.Bits(distance.packed(codes))
    m = distance.Made(bits, Matrix.SYMMETRIC, missing, codes.shape[1], 0.5, (codes > 0).all(0), None)
    labels, leaves = [f"v{k}" for k in range(n)], nj._Leaves(m)
    total = nj.totals_of(leaves, np.arange(n))
    first = nj.lists_of(leaves, np.arange(n), total / (n - 2))
    return nj.neighbour_joining_made(lambda: m, labels, total, first, few), nj.neighbour_joining(m.block(np.arange(n)), labels, few)


@pytest.mark.parametrize("missing", [Missing.PAIR_DELETE, Missing.AS_ALLELE, Missing.ABSOLUTE_DISTANCE])
@pytest.mark.parametrize("loci", [6, 64, 90])
def test_made_joins_are_those_of_the_matrix(loci, missing):
    for seed in range(2):
        made, whole = _both(_codes(150, loci, 9, seed), 40, missing)
        assert made == whole


def test_few_rows_are_held(monkeypatch):
    held = []
    monkeypatch.setattr(nj._Rows, "close", lambda self, at, close=nj._Rows.close: (close(self, at), held.append(sum(c.nbytes for c in self.chunks)))[0])
    codes = _codes(1500, 64, 9, 4)
    made, whole = _both(codes, 100)
    assert made == whole
    assert 0 < max(held) < 2 * len(codes) ** 2 / 7 + nj.CHUNK * 8 * len(codes)


def test_pipeline_joins_in_place(spark, monkeypatch):
    made = synthetic_profile(spark, 120, 60, missing=0.05, duplicates=0.2, seed=3)
    whole = pipelines.neighbour_joining(made, Params.of(method="NJ")).first()["newick"]
    monkeypatch.setattr(nj, "FEW", 30)
    calls = []
    monkeypatch.setattr(nj, "starts", lambda *a, starts=nj.starts: calls.append(1) or starts(*a))
    assert pipelines.neighbour_joining(made, Params.of(method="NJ")).first()["newick"] == whole and calls
