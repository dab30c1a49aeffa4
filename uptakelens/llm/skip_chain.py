"""A skip-chain conditional random field over sparse binary features.

Nodes carry features and, if they are evidence, a fixed label. Chain edges join neighbours; all
nodes that share a key are joined with one entity variable of their own, the hub of the key. Where
a skip chain would have a potential for every two such nodes, this has one for each node, and two
steps still lead from any of them to any other, however far apart.

Weights are fitted twice. Pseudo-likelihood predicts every free node and every hub from its
features and the true labels of its neighbours, which is a convex problem. From there the
likelihood itself is climbed: observed less expected numbers of labels and pairs of labels, the
expected ones from the messages. Labels are found by loopy sum-product message passing over a
whole batch of graphs at once; the number of rounds is fixed, so that a graph's result doesn't
depend on its batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS = 24
DAMPING = 0.5
#: Log potential that rules a label out.
NEVER = -1e4


@dataclass(frozen=True)
class Graph:
    """Nodes of any number of documents. `features` has node and feature numbers, `fixed` a label
    or -1, `chain` pairs of nodes (left, right), `skip` pairs of node and hub."""

    n: int
    features: np.ndarray
    fixed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    n_hubs: int


@dataclass(frozen=True)
class Weights:
    """Log potentials: of a feature and label, of neighbours, of a node and its hub, of a hub."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    hub: np.ndarray


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by number."""
    columns = [np.bincount(at, values[:, k], n) for k in range(values.shape[1])]
    return np.stack(columns, axis=1) if n else np.zeros((0, values.shape[1]))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def unaries(graph: Graph, weights: Weights) -> np.ndarray:
    """Log potentials of the nodes, and after them of the hubs."""
    node, feature = graph.features
    own = summed(node, weights.unary[feature], graph.n)
    held = np.flatnonzero(graph.fixed >= 0)
    own[held] = NEVER
    own[held, graph.fixed[held]] = 0
    return np.concatenate([own, np.tile(weights.hub, (graph.n_hubs, 1))])


def passed(graph: Graph, weights: Weights, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Log marginals (normalised) of nodes and hubs after so many rounds of messages, and of the
    pairs of labels along chain edges and then skip edges."""
    own = unaries(graph, weights)
    total, labels = len(own), own.shape[1]
    pairs = np.concatenate([graph.chain.T, graph.skip.T + [0, graph.n]]).astype(np.int64)
    m, n_chain = len(pairs), graph.chain.shape[1]
    runs = [(slice(0, n_chain), weights.chain), (slice(n_chain, m), weights.skip)]
    source, target = pairs.T.reshape(-1), pairs[:, ::-1].T.reshape(-1)
    sent, out = np.zeros((2, m, labels)), np.zeros((2, m, labels))
    for k in range(rounds + 1 if m else 0):
        heard = own + summed(target, sent.reshape(-1, labels), total)
        out = heard[source].reshape(2, m, labels) - sent[::-1]
        if k == rounds:
            break
        new = np.empty_like(sent)
        for at, table in runs:
            new[0, at] = log_sum(out[0, at, :, None] + table, 1)
            new[1, at] = log_sum(out[1, at, :, None] + table.T, 1)
        new -= log_sum(new, 2)[:, :, None]
        sent = DAMPING * sent + (1 - DAMPING) * new
    marginal = own + summed(target, sent.reshape(-1, labels), total)
    both = np.empty((m, labels, labels))
    for at, table in runs:
        both[at] = out[0, at, :, None] + out[1, at, None, :] + table
    both -= log_sum(both.reshape(m, labels * labels), 1)[:, None, None]
    return marginal - log_sum(marginal, 1)[:, None], both


def _climbed(theta: list[np.ndarray], gradient, steps: int, rate: float, l2: float) -> list[np.ndarray]:
    """Weights after so many steps of Adam up the gradient, less an l2 penalty."""
    mean, square = ([np.zeros(t.shape) for t in theta] for _ in range(2))
    for step in range(1, steps + 1):
        for k, g in enumerate(gradient(Weights(*theta))):
            g = g - l2 * theta[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            scale = np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8
            theta[k] = theta[k] + rate * mean[k] / (1 - 0.9**step) / scale
    return theta


def fitted(
    graph: Graph, truth: np.ndarray, hub_truth: np.ndarray, n_features: int, n_labels: int, l2: float = 1.0
) -> Weights:
    """Weights for graphs whose labels are known, from zero by pseudo-likelihood, then by likelihood."""
    node, feature = graph.features
    one_hot = np.eye(n_labels)
    y, z = one_hot[truth], one_hot[hub_truth.astype(np.int64)].reshape(-1, n_labels)
    left, right = graph.chain
    member, hub = graph.skip
    free = (graph.fixed < 0)[:, None]
    before, after = summed(right, y[left], graph.n), summed(left, y[right], graph.n)
    of_hub, of_members = summed(member, z[hub], graph.n), summed(hub, y[member], graph.n_hubs)

    def pseudo(w: Weights) -> list[np.ndarray]:
        score = summed(node, w.unary[feature], graph.n) + before @ w.chain + after @ w.chain.T + of_hub @ w.skip.T
        error = (y - np.exp(score - log_sum(score, 1)[:, None])) * free
        hub_score = w.hub + of_members @ w.skip
        hub_error = z - np.exp(hub_score - log_sum(hub_score, 1)[:, None])
        return [
            summed(feature, error[node], n_features),
            before.T @ error + error.T @ after,
            error.T @ of_hub + of_members.T @ hub_error,
            hub_error.sum(axis=0),
        ]

    def likelihood(w: Weights) -> list[np.ndarray]:
        marginal, both = passed(graph, w, ROUNDS // 3)
        error = np.concatenate([y, z]) - np.exp(marginal)
        pairs, n_chain = np.exp(both), graph.chain.shape[1]
        return [
            summed(feature, (error[: graph.n] * free)[node], n_features),
            y[left].T @ y[right] - pairs[:n_chain].sum(axis=0),
            y[member].T @ z[hub] - pairs[n_chain:].sum(axis=0),
            error[graph.n :].sum(axis=0),
        ]

    zero = [np.zeros(s) for s in ((n_features, n_labels), (n_labels, n_labels), (n_labels, n_labels), (n_labels,))]
    start = _climbed(zero, pseudo, 200, 0.1, l2)
    return Weights(*_climbed(start, likelihood, 60, 0.1, l2))


def labels(graph: Graph, weights: Weights) -> np.ndarray:
    """The likeliest label of every node."""
    return np.argmax(np.round(passed(graph, weights, ROUNDS)[0][: graph.n], 6), axis=1)
