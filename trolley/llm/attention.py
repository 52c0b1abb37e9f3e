"""A small causal self-attention model of token classes, trained and run in numpy.

A token's probability is that of its class given the context, times that of the token within
its class given the class of the token before. Classes hold equal shares of the square roots of
the token counts, so frequent tokens have a class of their own. The class probabilities start
from counted pairs of classes; attention over the tokens of a window adds what the context
before the last token tells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 24
OVERLAP = 4
STRIDE = WINDOW - OVERLAP
CLASSES = 64
INPUTS = 1024
#: Pairs of so many most frequent ids are counted one by one.
PAIRED = 2048
WIDTH = 16
HIDDEN = 32
BATCH = 128
#: Logits stop here, so that their exponentials are finite.
MOST = 60.0
FLOAT = np.float32


@dataclass
class Counted:
    """What counting the corpus says, with natural logs of probabilities."""

    #: Class, input number, and place among the paired ids (or their number) of each id.
    class_of: np.ndarray
    input_of: np.ndarray
    paired: np.ndarray
    #: Of each class after each id, and of each id within its class after each class.
    prior: np.ndarray
    within: np.ndarray
    #: Of each paired id within its class after each paired id, and by how much the other ids of
    #: a class lose to those, after each id.
    pair_within: np.ndarray
    rest: np.ndarray

    def inside(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The log probability of each id within its class, given the id before."""
        a, b = self.paired[before], self.paired[ids]
        scores = self.pair_within[np.minimum(a, PAIRED - 1), np.minimum(b, PAIRED - 1)]
        other = np.flatnonzero((a == PAIRED) | (b == PAIRED))
        before, ids = before[other], ids[other]
        of = self.class_of[ids]
        scores[other] = self.within[self.class_of[before], ids] + self.rest[before, of]
        return scores


def by_count(counts: np.ndarray, most: int) -> np.ndarray:
    """The place of each id by its count, at most ``most``."""
    place = np.empty(len(counts), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return np.minimum(place, most)


def classes_of(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each id, by the ids' counts."""
    order = np.argsort(-counts, kind="stable")
    mass = np.sqrt(counts[order].astype(np.float64))
    share = np.cumsum(mass) / max(mass.sum(), 1e-300)
    binned = np.minimum((share * classes).astype(np.int64), classes - 1)
    # A class that a frequent id jumps over is left to the ids after it.
    binned = np.minimum(np.arange(len(order)), np.maximum.accumulate(binned))
    class_of = np.empty(len(counts), np.int16)
    class_of[order] = np.minimum(binned, classes - 1)
    return class_of


def counted(
    counts: np.ndarray,
    class_of: np.ndarray,
    after: np.ndarray,
    to_class: np.ndarray,
    pairs: np.ndarray,
) -> Counted:
    """Smoothed log probabilities from counts.

    ``after[c, x]`` is how often id ``x`` follows an id of class ``c``, ``to_class[x, c]`` how
    often one of class ``c`` follows id ``x``, and ``pairs[i, j]`` how often the ``j``-th most
    frequent id follows the ``i``-th.
    """
    classes, ids = after.shape
    size = np.bincount(class_of, minlength=classes)
    total = np.bincount(class_of, counts, classes)
    alone = ((counts + 0.1) / (total + 0.1 * size)[class_of]).astype(FLOAT)
    of_pair = np.stack([np.bincount(class_of, row, classes) for row in after])
    within = (after + 5.0 * alone) / (of_pair + 5.0).astype(FLOAT)[:, class_of]
    single = (total + 1) / (total.sum() + classes)
    broad = (of_pair + 5.0 * single) / (of_pair.sum(axis=1, keepdims=True) + 5.0)
    prior = (to_class + 5.0 * broad.astype(FLOAT)[class_of]) / (to_class.sum(axis=1, keepdims=True) + 5.0)
    paired = by_count(counts, PAIRED)
    top = np.argsort(paired, kind="stable")[:PAIRED]
    top_class = class_of[top]
    seen = np.zeros((ids, classes), FLOAT)
    seen[top] = np.stack([np.bincount(top_class, row[: len(top)], classes) for row in pairs[: len(top)]])
    rest = 3.0 / (seen + 3.0)
    pair_within = np.ones((PAIRED, PAIRED), FLOAT)
    pair_within[: len(top), : len(top)] = (
        pairs[: len(top), : len(top)] / (seen[top] + 3.0)[:, top_class]
        + rest[top][:, top_class] * within[np.ix_(top_class, top)]
    )
    logs = [np.log(values, out=values) for values in (prior, within, pair_within, rest)]
    return Counted(class_of, by_count(counts, INPUTS - 1).astype(np.int16), paired, *logs)


SHAPES = {
    "embed": (INPUTS, WIDTH),
    "place": (WINDOW, WIDTH),
    "qkv": (WIDTH, 3 * WIDTH),
    "apart": (WINDOW,),
    "mix": (2 * WIDTH, HIDDEN),
    "bias": (HIDDEN,),
    "out": (HIDDEN, CLASSES),
}
FUTURE = np.triu(np.full((WINDOW, WINDOW), -1e9, FLOAT), 1)
NUMBERS = np.arange(INPUTS * WIDTH).reshape(INPUTS, WIDTH)
DISTANCE = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0)


def fresh(seed: int = 9) -> dict[str, np.ndarray]:
    """Weights whose model is that of the counted pairs: the last layer is zero."""
    rng = np.random.default_rng(seed)
    weights = {
        name: (rng.normal(size=shape) * (0.5 if name == "embed" else shape[0] ** -0.5)).astype(
            FLOAT
        )
        for name, shape in SHAPES.items()
    }
    for name in ("place", "apart", "bias", "out"):
        weights[name][...] = 0
    return weights


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[name].reshape(-1) for name in SHAPES])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    return {name: part.astype(FLOAT) for name, part in views(values).items()}


def views(values: np.ndarray) -> dict[str, np.ndarray]:
    found, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        found[name] = values[at : at + size].reshape(shape)
        at += size
    return found


def forward(weights: dict[str, np.ndarray], before: np.ndarray, prior: np.ndarray) -> tuple:
    """Class logits for windows; ``before`` has the inputs and ``prior`` the counted logits."""
    x = weights["embed"].take(before, axis=0)
    x += weights["place"]
    q, k, v = np.split(_times(x, weights["qkv"]), 3, axis=2)
    share = (q * FLOAT(WIDTH**-0.5)) @ k.transpose(0, 2, 1)
    share += weights["apart"][DISTANCE] + FUTURE
    share = _exp(share)
    share_sum = share.sum(axis=2, keepdims=True)
    seen = np.empty((*x.shape[:2], 2 * WIDTH), FLOAT)
    seen[:, :, :WIDTH] = x
    np.divide(share @ v, share_sum, out=seen[:, :, WIDTH:])
    hidden = _times(seen, weights["mix"])
    hidden += weights["bias"]
    np.maximum(hidden, 0, out=hidden)
    logits = _times(hidden, weights["out"])
    logits += prior
    return logits, (x, q, k, v, share, share_sum, seen, hidden)


def _flat(a: np.ndarray) -> np.ndarray:
    """All places of all windows one after another."""
    return a.reshape(-1, a.shape[-1])


def _times(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``a @ weights`` as one product, not one for each window."""
    return (_flat(a) @ weights).reshape(*a.shape[:-1], weights.shape[1])


def _exp(logits: np.ndarray) -> np.ndarray:
    """The exponentials of ``logits``, which they replace."""
    if logits.max(initial=0) > MOST:
        np.minimum(logits, MOST, out=logits)
    return np.exp(logits, out=logits)


def gradients(
    weights: dict[str, np.ndarray],
    before: np.ndarray,
    prior: np.ndarray,
    target: np.ndarray,
    counts: np.ndarray,
) -> tuple[dict[str, np.ndarray], float]:
    """Of the mean loss over the positions that count, and that loss."""
    logits, (x, q, k, v, share, share_sum, seen, hidden) = forward(weights, before, prior)
    share /= share_sum
    p = _flat(logits)
    every, aim = np.arange(len(p)), target.reshape(-1)
    at = p[every, aim]
    _exp(p)
    total = p.sum(axis=1, keepdims=True)
    n = max(1, int(counts.sum()))
    loss = float(((np.log(total[:, 0]) - at) * counts.reshape(-1)).sum() / n)
    p /= total
    p[every, aim] -= 1
    p *= (counts / n).reshape(-1, 1)
    grads = {"out": _flat(hidden).T @ p}
    to_hidden = p @ weights["out"].T
    to_hidden *= _flat(hidden) > 0
    grads["mix"] = _flat(seen).T @ to_hidden
    grads["bias"] = to_hidden.sum(axis=0)
    to_seen = (to_hidden @ weights["mix"].T).reshape(seen.shape)
    to_x, to_read = to_seen[:, :, :WIDTH], to_seen[:, :, WIDTH:]
    to_v = share.transpose(0, 2, 1) @ to_read
    to_share = to_read @ v.transpose(0, 2, 1)
    to_share -= (share * to_share).sum(axis=2, keepdims=True)
    to_logit = to_share
    to_logit *= share
    grads["apart"] = np.bincount(
        DISTANCE.reshape(-1), to_logit.sum(axis=0).reshape(-1), WINDOW
    ).astype(FLOAT)
    to_logit *= FLOAT(WIDTH**-0.5)
    to_qkv = np.empty((*x.shape[:2], 3 * WIDTH), FLOAT)
    to_qkv[:, :, :WIDTH] = to_logit @ k
    to_qkv[:, :, WIDTH : 2 * WIDTH] = to_logit.transpose(0, 2, 1) @ q
    to_qkv[:, :, 2 * WIDTH :] = to_v
    grads["qkv"] = _flat(x).T @ _flat(to_qkv)
    to_x = to_x + _times(to_qkv, weights["qkv"].T)
    grads["place"] = to_x.sum(axis=0)
    grads["embed"] = np.zeros_like(weights["embed"])
    # With one index for each number: add.at is much slower on rows.
    number = NUMBERS.take(before.reshape(-1), axis=0)
    np.add.at(grads["embed"].reshape(-1), number.reshape(-1), to_x.reshape(-1))
    return grads, loss


class Adam:
    """Steps of weights that lie in one array, of which ``weights`` has views."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.all, self.rate, self.step = flat(weights), rate, 0
        self.weights = views(self.all)
        self.mean, self.square = np.zeros_like(self.all), np.zeros_like(self.all)

    def __call__(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        rate = self.rate * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
        g = flat(grads)
        self.mean += 0.1 * (g - self.mean)
        self.square += 0.001 * (g * g - self.square)
        change = np.sqrt(self.square)
        change += 1e-8
        np.divide(rate * self.mean, change, out=change)
        self.all -= change


def windows_of(counts: np.ndarray) -> np.ndarray:
    """How many windows each text of ``counts`` ids has."""
    n = np.maximum(0, -(-(counts - OVERLAP) // STRIDE))
    return np.where(counts > 0, np.maximum(n, 1), 0)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of ``counts`` ids that lie one after another.

    The place of each window's first id, how many of its places hold ids, and the first place
    that it scores. A text's windows overlap by ``OVERLAP`` ids, and each id is scored once.
    """
    n = windows_of(counts)
    text = np.repeat(np.arange(len(counts)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(counts) - counts)[text] + number * STRIDE
    size = np.minimum(counts[text] - number * STRIDE, WINDOW)
    return start, size, np.where(number > 0, OVERLAP, 0)


def token_scores(
    weights: dict[str, np.ndarray], known: Counted, before: np.ndarray, ids: np.ndarray, counts: np.ndarray
) -> np.ndarray:
    """The natural log of the probability of each id; ``before`` holds the id before each."""
    scores = known.inside(before, ids).astype(np.float64)
    inputs, to_class = known.input_of[before], known.class_of[ids].astype(np.int64)
    start, size, first = windows(counts)
    place = np.arange(WINDOW)
    for low in range(0, len(start), BATCH):
        some = slice(low, low + BATCH)
        at = start[some, None] + np.minimum(place, size[some, None] - 1)
        logits, _ = forward(weights, inputs[at], known.prior.take(before[at], axis=0))
        picked = np.take_along_axis(logits, to_class[at][:, :, None], 2)[:, :, 0]
        value = picked - np.log(_exp(logits).sum(axis=2))
        counted_ = (place >= first[some, None]) & (place < size[some, None])
        scores[at[counted_]] += value[counted_]
    return scores


def train(
    weights: dict[str, np.ndarray], known: Counted, sample: np.ndarray, rate: float, seed: int
) -> dict[str, np.ndarray]:
    """``weights`` after a pass over ``sample``: rows of an id and the ``WINDOW`` ids after it.

    Places after the end of a text are -1.
    """
    step = Adam(weights, rate)
    order = np.random.default_rng(seed).permutation(len(sample))
    for low in range(0, len(order), BATCH // 2):
        rows = sample[order[low : low + BATCH // 2]]
        counts = (rows[:, 1:] >= 0).astype(FLOAT)
        rows = np.maximum(rows, 0)
        before, ids = rows[:, :-1], rows[:, 1:]
        grads, _ = gradients(
            step.weights,
            known.input_of[before],
            known.prior.take(before, axis=0),
            known.class_of[ids].astype(np.int64),
            counts,
        )
        step(grads)
    return step.weights
