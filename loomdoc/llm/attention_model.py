"""A small causal self-attention model over subword units, trained and run in numpy.

One layer: embeddings and positions, one attention head, a residual ReLU layer. The output is in two steps: a softmax over the most frequent units, one entry for each
cluster of the next ones and one for all others; then, for a unit in a cluster, a softmax over that cluster. What is in no cluster has its share of the corpus counts.
Output biases start at the logarithms of corpus counts, so that an untrained model is the corpus's unigram model.

A text is scored in windows of ``WINDOW`` units of which the last ``STEP`` are predicted and the others repeat the units before them: each unit is scored once,
with at least ``WINDOW - STEP`` units of context (marks stand before the text's begin).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, STEP, WIDTH, HIDDEN = 32, 28, 16, 24
LEAD = WINDOW - STEP

#: Units with an output of their own, clusters, and units of a cluster.
HEAD, CLUSTERS, MEMBERS = 47, 16, 96
OUTPUTS, UNITS, RARE = HEAD + CLUSTERS + 1, HEAD + CLUSTERS * MEMBERS + 1, HEAD + CLUSTERS * MEMBERS

#: Windows of a scoring batch, and of the batches whose clusters are scored together.
SCORED, GATHERED = 64, 1536

_MASK = np.where(np.arange(WINDOW)[None, :] <= np.arange(STEP)[:, None] + LEAD, 0, -1e4).astype(np.float32)
_PLACES = np.arange(WINDOW + 1)

#: Each unit's entry in the first softmax, and its cluster (or none).
_CLUSTER = np.full(UNITS, CLUSTERS)
_CLUSTER[HEAD:RARE] = np.arange(CLUSTERS).repeat(MEMBERS)
_ENTRY = np.append(np.append(np.arange(HEAD), HEAD + _CLUSTER[HEAD:RARE]), OUTPUTS - 1)

#: No logit counts for more, so that no sum of exponentials overflows.
_MOST = 60


@dataclass
class Units:
    """Which unit a token id is, and the logarithm of a rare id's share of all rare ones. The end mark is the last id, and unit 0."""

    unit: np.ndarray
    rare: np.ndarray
    head_bias: np.ndarray
    cluster_bias: np.ndarray


def units_of(counts: np.ndarray) -> Units:
    """Units by falling counts; ``counts`` has the corpus count of every id, the end mark's last."""
    order = np.argsort(-counts[:-1], kind="stable")[: RARE - 1]
    order = np.append(len(counts) - 1, order[counts[order] > 0])
    unit = np.full(len(counts), RARE, np.int32)
    unit[order] = np.arange(len(order))
    kept = np.zeros(RARE)
    kept[: len(order)] = counts[order]
    weight = np.where(unit == RARE, counts + 0.5, 0)
    with np.errstate(divide="ignore"):
        rare = np.log(weight / max(weight.sum(), 0.5))
    tail = kept[HEAD:].reshape(CLUSTERS, MEMBERS)
    head = np.concatenate([kept[:HEAD], tail.sum(1), [counts[unit == RARE].sum()]]) + 0.5
    return Units(unit, rare, np.log(head / head.sum()).astype(np.float32), np.log((tail + 0.5) / (tail + 0.5).sum(1, keepdims=True)).astype(np.float32))


def begin(units: Units, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters before training."""
    rng = np.random.default_rng(seed)
    some = lambda *shape, scale=WIDTH**-0.5: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": some(UNITS, WIDTH, scale=0.3), "place": some(WINDOW, WIDTH, scale=0.1), "query": some(WIDTH, WIDTH), "key": some(WIDTH, WIDTH), "value": some(WIDTH, WIDTH), "mix": some(WIDTH, WIDTH),
        "up": some(WIDTH, HIDDEN), "up_bias": np.zeros(HIDDEN, np.float32), "down": some(HIDDEN, WIDTH, scale=0.1), "head": some(WIDTH, OUTPUTS, scale=0.05), "head_bias": units.head_bias.copy(),
        "cluster": some(CLUSTERS, WIDTH, MEMBERS, scale=0.05), "cluster_bias": units.cluster_bias.copy(),
    }


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p.reshape(-1) for p in params.values()])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, p in like.items():
        out[name] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
        at += p.size
    return out


def windows(units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts that stand one after the other in ``units``, each closed by an end mark of its own.

    Returns windows of ``WINDOW + 1`` units (each place's target is the next place), which of the ``STEP`` targets count, and each window's text.
    """
    several = -(-sizes // STEP)
    room = several * STEP + LEAD + 1
    starts = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()), np.int32)
    offset = np.cumsum(sizes) - sizes
    flat[np.arange(len(units)) + (starts + LEAD + 1 - offset).repeat(sizes)] = units
    text = np.arange(len(sizes)).repeat(several)
    number = np.arange(len(text)) - (np.cumsum(several) - several).repeat(several)
    valid = np.arange(STEP)[None, :] < (sizes[text] - number * STEP)[:, None]
    return flat[(starts[text] + number * STEP)[:, None] + _PLACES[None, :]], valid, text


def _forward(p: dict[str, np.ndarray], inputs: np.ndarray) -> dict[str, np.ndarray]:
    x = p["embed"][inputs]
    x += p["place"]
    near = x[:, LEAD:]
    flat = x.reshape(-1, WIDTH)
    key, value = (flat @ p["key"]).reshape(x.shape), (flat @ p["value"]).reshape(x.shape)
    query = near.reshape(-1, WIDTH) @ (p["query"] * np.float32(WIDTH**-0.5))
    weight = np.matmul(query.reshape(near.shape), key.transpose(0, 2, 1))
    weight += _MASK
    if weight.max() > _MOST:
        np.minimum(weight, _MOST, out=weight)
    np.exp(weight, out=weight)
    total = weight @ np.ones(WINDOW, np.float32)
    seen = np.matmul(weight, value)
    seen /= total[..., None]
    seen = seen.reshape(-1, WIDTH)
    mixed = seen @ p["mix"]
    mixed += near.reshape(-1, WIDTH)
    up = mixed @ p["up"]
    up += p["up_bias"]
    np.maximum(up, 0, out=up)
    out = up @ p["down"]
    out += mixed
    return {"x": x, "key": key, "value": value, "query": query, "weight": weight, "total": total, "seen": seen, "mixed": mixed, "up": up, "out": out}


def _softmax(logits: np.ndarray, target: np.ndarray, safe: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the targets, the sums of exponentials, and (in place) the exponentials. ``safe`` logits are known to overflow nothing."""
    if not safe and logits.size and logits.max() > _MOST:
        np.minimum(logits, _MOST, out=logits)
    own = logits[np.arange(len(target)), target].astype(np.float64)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    return own - np.log(total), total


def _bounded(out: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit of these rows can exceed ``_MOST``, by the lengths of rows and columns."""
    if not len(out):
        return True
    longest = np.sqrt(np.einsum("ij,ij->i", out, out).max() * np.einsum("ij,ij->j", weights, weights).max())
    return bool(longest + bias.max() < _MOST)


def _clusters(unit: np.ndarray):
    """The rows of each cluster that has some."""
    own = _CLUSTER[unit]
    tail = np.flatnonzero(own < CLUSTERS)
    own = own[tail]
    order = np.argsort(own.astype(np.int8), kind="stable")
    tail, edges = tail[order], np.searchsorted(own[order], np.arange(CLUSTERS + 1))
    for k in range(CLUSTERS):
        if edges[k] < edges[k + 1]:
            rows = tail[edges[k] : edges[k + 1]]
            yield k, rows, unit[rows] - HEAD - k * MEMBERS


def log_probabilities(p: dict[str, np.ndarray], taken: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the targets that count, in order, without a rare id's share among the rare.

    The layer and the first softmax run over few windows at a time, whose arrays stay in a core's cache; what goes on into the clusters is gathered for several such batches.
    """
    parts = []
    head = np.concatenate([p["head"], p["head_bias"][None, :]])
    for at in range(0, len(taken), GATHERED):
        found, outs, targets = [], [], []
        for low in range(at, min(at + GATHERED, len(taken)), SCORED):
            now, counts = taken[low : min(low + SCORED, at + GATHERED)], valid[low : min(low + SCORED, at + GATHERED)].reshape(-1)
            out = _forward(p, now[:, :-1])["out"]
            target = now[:, LEAD + 1 :].reshape(-1)
            if not counts.all():
                out, target = out[counts], target[counts]
            # a column of ones takes the bias into the product
            found.append(_softmax(np.column_stack([out, np.ones(len(out), np.float32)]) @ head, _ENTRY[target], _bounded(out, p["head"], p["head_bias"]))[0])
            outs.append(out[_CLUSTER[target] < CLUSTERS])
            targets.append(target)
        found, outs, target = np.concatenate(found), np.concatenate(outs), np.concatenate(targets)
        tail = np.flatnonzero(_CLUSTER[target] < CLUSTERS)
        for k, rows, member in _clusters(target[tail]):
            logits = outs[rows] @ p["cluster"][k]
            logits += p["cluster_bias"][k]
            found[tail[rows]] += _softmax(logits, member)[0]
        parts.append(found)
    return np.concatenate(parts) if parts else np.zeros(0)


def gradients(p: dict[str, np.ndarray], taken: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean loss (nats a target) and its gradients."""
    f = _forward(p, taken[:, :-1])
    g = {}
    counts, target = valid.reshape(-1), taken[:, LEAD + 1 :].reshape(-1)
    n = max(1, int(counts.sum()))
    share = (counts / np.float32(n)).astype(np.float32)
    out = f["out"]
    logits = out @ p["head"] + p["head_bias"]
    own = _ENTRY[target]
    found, total = _softmax(logits, own)
    logits *= (share / total)[:, None]
    logits[np.arange(len(own)), own] -= share
    g["head"], g["head_bias"] = out.T @ logits, logits.sum(0)
    d_out = logits @ p["head"].T
    g["cluster"], g["cluster_bias"] = np.zeros_like(p["cluster"]), np.zeros_like(p["cluster_bias"])
    for k, rows, member in _clusters(np.where(counts, target, 0)):
        logits = out[rows] @ p["cluster"][k] + p["cluster_bias"][k]
        more, total = _softmax(logits, member)
        found[rows] += more
        logits *= (share[rows] / total)[:, None]
        logits[np.arange(len(rows)), member] -= share[rows]
        g["cluster"][k], g["cluster_bias"][k] = out[rows].T @ logits, logits.sum(0)
        d_out[rows] += logits @ p["cluster"][k].T
    g["down"] = f["up"].T @ d_out
    d_up = (d_out @ p["down"].T) * (f["up"] > 0)
    g["up"], g["up_bias"] = f["mixed"].T @ d_up, d_up.sum(0)
    d_mixed = d_out + d_up @ p["up"].T
    g["mix"] = f["seen"].T @ d_mixed
    x, weight = f["x"], f["weight"] / f["total"][..., None]
    near = x[:, LEAD:]
    d_seen = (d_mixed @ p["mix"].T).reshape(near.shape)
    d_value = np.matmul(weight.transpose(0, 2, 1), d_seen).reshape(-1, WIDTH)
    d_weight = np.matmul(d_seen, f["value"].transpose(0, 2, 1))
    d_weight -= (d_weight * weight).sum(-1, keepdims=True)
    d_weight *= weight
    d_query = np.matmul(d_weight, f["key"]).reshape(-1, WIDTH) * np.float32(WIDTH**-0.5)
    d_key = np.matmul(d_weight.transpose(0, 2, 1), f["query"].reshape(near.shape)).reshape(-1, WIDTH)
    flat = x.reshape(-1, WIDTH)
    g["query"], g["key"], g["value"] = near.reshape(-1, WIDTH).T @ d_query, flat.T @ d_key, flat.T @ d_value
    d_x = (d_key @ p["key"].T + d_value @ p["value"].T).reshape(x.shape)
    d_x[:, LEAD:] += (d_mixed + d_query @ p["query"].T).reshape(near.shape)
    g["place"] = d_x.sum(0)
    ids = taken[:, :-1].reshape(-1)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(ids[order]) > 0))
    g["embed"] = np.zeros_like(p["embed"])
    g["embed"][ids[order][first]] = np.add.reduceat(d_x.reshape(-1, WIDTH)[order], first, axis=0)
    return float(-found[counts].sum() / n), g


class Training:
    """Adam steps over windows as they come, from parameters on. ``rate`` holds for the first ``slowing`` steps, more or less, and falls with the root of the steps from there."""

    def __init__(self, p: dict[str, np.ndarray], rate: float, batch: int, slowing: int, seed: int = 1):
        self.p, self.rate, self.batch, self.slowing = {k: v.copy() for k, v in p.items()}, rate, batch, slowing
        self.first, self.second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        self.rng, self.steps, self.seen = np.random.default_rng(seed), 0, 0

    def learn(self, taken: np.ndarray, valid: np.ndarray) -> None:
        """One pass over all these windows, shuffled."""
        if not len(taken):
            return
        for now in np.array_split(self.rng.permutation(len(taken)), -(-len(taken) // self.batch)):
            self._step(gradients(self.p, taken[now], valid[now])[1])
        self.seen += int(valid.sum())

    def _step(self, g: dict[str, np.ndarray]) -> None:
        self.steps += 1
        lr = np.float32(self.rate / np.sqrt(1 + self.steps / self.slowing) / (1 - 0.9**self.steps))
        even = np.float32(1 / (1 - 0.99**self.steps))
        for k, d in g.items():
            self.first[k] += np.float32(0.1) * (d - self.first[k])
            self.second[k] += np.float32(0.01) * (d * d - self.second[k])
            self.p[k] -= lr * self.first[k] / (np.sqrt(self.second[k] * even) + np.float32(1e-8))
