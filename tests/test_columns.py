import tracemalloc

import numpy as np
import pytest

from lociweave.operators import branching, distance, network
from lociweave.plans.params import Matrix, Missing


def _made(n, loci, missing, seed):
    rng = np.random.default_rng(seed)
    codes = np.where(rng.random((n, loci)) < 0.1, 0, rng.integers(1, 12, (n, loci)))
    return distance.Made(distance.Bits(distance.packed(codes)), Matrix.ASYMMETRIC, missing, loci, 0.5, None, None), rng.permutation(n) / n


@pytest.mark.parametrize("missing", [Missing.PAIR_DELETE, Missing.ABSOLUTE_DISTANCE])
@pytest.mark.parametrize("loci", [6, 64, 90])
def test_columns_are_those_of_blocks(loci, missing):
    m, _ = _made(80, loci, missing, loci)
    whole = m.block(np.arange(80))
    for t in range(80):
        assert np.array_equal(m[:, t], whole[:, t], equal_nan=True) and m.column(t).dtype == np.float32


def test_cheapest_sources_spare_a_column_a_node(spark):
    m, w = _made(300, 64, Missing.PAIR_DELETE, 3)
    for kind, search in ((network.Quantised, branching.ordered_branching), (network.Rounded, lambda c, cheap=None: branching.round_branching(c, 66.0 * 301, cheap=cheap))):
        cheap = distance.cheapest_sources(spark, 300, lambda kind=kind: kind(m, w))
        cost, asked = kind(m, w), []
        into = cost.into
        cost.into = lambda t, into=into, asked=asked: (asked.append(t), into(t))[1]
        assert search(cost, cheap=cheap) == search(kind(m, w))
        assert len(asked) <= 310


class _Nested:
    """In-edges of which every round closes one cycle."""

    def __init__(self, n):
        self.n = n

    def __len__(self):
        return self.n

    def into(self, t):
        return np.maximum(np.arange(self.n), t).astype(float)


def test_rounds_keep_no_copy_of_all_groups():
    tracemalloc.start()
    edges = branching.round_branching(_Nested(1200), 1e7, 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(edges) == 1199 and peak < 8 << 20


def test_rounded_cells_are_half_up():
    values = np.array([0.5, 2.5, 1.00005, 48.12345, 0.5], np.float32)
    assert distance.rounded(values, 0).tolist() == [1.0, 3.0, 1.0, 48.0, 1.0]
    assert distance.rounded(np.array([0.03125, 0.09375], np.float32), 4).tolist() == [0.0313, 0.0938]
