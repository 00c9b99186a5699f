import numpy as np
import pytest

from sylvine.functions import forest
from sylvine.functions.forest import Forest, calibrate, node_vectors, tree_seed

F = Forest(n_trees=3, depth=6, dim=64)
X = np.random.default_rng(1).standard_normal((200, 64))


def test_routing_is_prefix_then_deepening():
    from dataclasses import replace

    whole, part = F.route(X), replace(F, depth=4).route(X)
    assert (whole >> 2 == part).all()
    assert (replace(F, depth=4).deepen(X, part, 2) == whole).all()
    assert whole.min() >= 0 and whole.max() < 64


@pytest.mark.parametrize("options", [{"version": 0}, {"tree_sub": 32}, {"tree_sub": 32, "tree_sub_groups": 2}, {"node_perm": True}, {"sub_dim": 80}])
def test_variants_split_and_repeat(options):
    a, b = (Forest(n_trees=2, depth=5, dim=64, **options).route(X) for _ in range(2))
    assert (a == b).all() and len(np.unique(a[:, 0])) > 8


def test_node_vectors_are_unit_and_seeded():
    for version in (0, 3):
        v = node_vectors(np.array([1, 2, 0], np.uint64), 15, version)
        assert np.allclose((v * v).sum(1), 1, atol=1e-6) and not np.allclose(v[0], v[1])
    assert tree_seed(2) == 2 * 99991 + 7


def test_medians_balance_leaves():
    from dataclasses import replace

    shifted = X + 2.0
    table = calibrate(F, shifted, 4)
    plain, even = (np.bincount(replace(F, depth=4, medians=m).route(shifted)[:, 0], minlength=16).max() for m in (None, table))
    assert even < plain and even < 40


def test_probes_are_distinct_and_start_at_the_main_leaf():
    main = F.route(X[:5])
    for t in range(3):
        for options, n in (((4,), 5), ((20, 0, True), 21), ((9, 4), 3)):
            rows, leaves, scores = F.probe(X[:5], t, *options)
            first = np.searchsorted(rows, np.arange(5))
            assert (np.bincount(rows) == n).all() and (leaves[first] == main[:, t]).all() and (scores >= 0).all()
            assert all(len(set(leaves[rows == r])) == n for r in range(5))
    with pytest.raises(ValueError):
        Forest(depth=29)


@pytest.mark.parametrize("kind", [{}, {"sub_dim": 5, "depth": 3}, {"node_perm": True}, {"tree_sub": 32, "tree_sub_groups": 2}, {"medians": np.full((3, 7), 0.01)}])
def test_shallow_trees_route_and_probe_as_node_by_node(monkeypatch, kind):
    """One product for all nodes of a tree leaves signs open near 0: copies, zeros and what isn't a number go the longer way."""
    x = np.random.default_rng(5).standard_normal((200, 64))
    x[20:40], x[40:45], x[45, 3], x[46, 2], x[47] = x[0], 0, np.nan, np.inf, 1e200
    tried = Forest(**({"n_trees": 3, "depth": 4} | kind))
    found = [tried.route(x), *tried.probe(x, 1, 2), *tried.probe(x, 2, 3, multi=True)]
    monkeypatch.setattr(forest, "SHALLOW", 0)
    plain = [tried.route(x), *tried.probe(x, 1, 2), *tried.probe(x, 2, 3, multi=True)]
    assert all(np.array_equal(a, b, equal_nan=a.dtype == float) for a, b in zip(found, plain, strict=True))
