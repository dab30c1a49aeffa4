from __future__ import annotations

import itertools

import numpy as np

from uptakelens.llm import skip_chain as sc


def made(seed: int, n: int, chain, skip, hubs: int, fixed=()) -> tuple[sc.Graph, sc.Weights]:
    draw = np.random.default_rng(seed)
    features = np.array([np.repeat(np.arange(n), 2), draw.integers(0, 5, 2 * n)])
    held = np.full(n, -1)
    for node, label in fixed:
        held[node] = label
    pairs = [np.array(x, np.int64).reshape(-1, 2).T for x in (chain, skip)]
    weights = sc.Weights(draw.normal(size=(5, 3)), draw.normal(size=(3, 3)), draw.normal(size=(3, 3)), draw.normal(size=3))
    return sc.Graph(n, features, held, *pairs, hubs), weights


def marginals(graph: sc.Graph, weights: sc.Weights) -> np.ndarray:
    """Every labelling of nodes and hubs weighed."""
    own = sc.unaries(graph, weights)
    out = np.zeros(own.shape)
    for labels in itertools.product(range(own.shape[1]), repeat=len(own)):
        score = sum(own[i, k] for i, k in enumerate(labels))
        score += sum(weights.chain[labels[a], labels[b]] for a, b in graph.chain.T)
        score += sum(weights.skip[labels[a], labels[graph.n + h]] for a, h in graph.skip.T)
        for i, k in enumerate(labels):
            out[i, k] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_exact_on_trees():
    for seed in range(5):
        graph, weights = made(seed, 6, [(0, 1), (1, 2), (3, 4)], [(2, 0), (4, 0), (5, 0)], 1, [(0, seed % 3)])
        found = np.exp(sc.passed(graph, weights, 60)[0])
        np.testing.assert_allclose(found, marginals(graph, weights), atol=1e-6)


def test_close_on_loops():
    graph, weights = made(3, 5, [(0, 1), (1, 2), (2, 3)], [(0, 0), (2, 0), (1, 1), (3, 1), (4, 1)], 2)
    weak = sc.Weights(*(0.5 * np.asarray(w) for w in vars(weights).values()))
    found = np.exp(sc.passed(graph, weak, 60)[0])
    np.testing.assert_allclose(found, marginals(graph, weak), atol=0.05)


def test_a_graph_does_not_depend_on_its_neighbours():
    graph, weights = made(1, 4, [(0, 1), (2, 3)], [(0, 0), (2, 0)], 1)
    other, _ = made(2, 4, [(0, 1), (2, 3)], [(1, 0), (2, 0)], 1)
    both = sc.Graph(
        8, np.concatenate([graph.features, other.features + [[4], [0]]], axis=1), np.concatenate([graph.fixed, other.fixed]),
        np.concatenate([graph.chain, other.chain + 4], axis=1), np.concatenate([graph.skip, other.skip + [[4], [1]]], axis=1), 2,
    )
    alone = np.concatenate([sc.labels(graph, weights), sc.labels(other, weights)])
    assert sc.labels(both, weights).tolist() == alone.tolist()


def test_nothing():
    graph = sc.Graph(0, np.zeros((2, 0), int), np.zeros(0, int), np.zeros((2, 0), int), np.zeros((2, 0), int), 0)
    _, weights = made(0, 1, [], [], 0)
    assert sc.labels(graph, weights).tolist() == []


def test_learns_that_tied_nodes_agree():
    """Nodes without a sign take the label of the evidence they are tied to."""
    n = 200
    fixed = np.where(np.arange(n) % 2 == 0, (np.arange(n) // 2) % 3, -1)
    truth = np.repeat((np.arange(n // 2)) % 3, 2)
    skip = np.array([np.arange(n), np.repeat(np.arange(n // 2), 2)])
    graph = sc.Graph(n, np.array([np.arange(n), np.zeros(n, int)]), fixed, np.zeros((2, 0), int), skip, n // 2)
    weights = sc.fitted(graph, truth, truth[::2], 1, 3)
    assert (sc.labels(graph, weights) == truth).all()
