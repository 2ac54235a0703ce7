"""A linear-chain conditional random field over words, in numpy: features by hash, exact forward-backward in blocks.

Chains of any length are cut into blocks of equal length. Each block's product
of transfer matrices is formed for all blocks at once, messages pass from block
to block, and the posteriors inside the blocks follow from them. The result is
that of forward-backward over the whole chain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BLOCK = 32
_BUCKETS = 1 << 16
_NGRAMS = (1, 2, 3, 4)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one after another, and where each word's begin (one more at the end).

    Each word is put between marks, so an n-gram (1 to 4 letters) at its edge
    is an affix and differs from the same letters inside. The last feature of
    a word is its place in the lexicon (sorted word hashes), or "unknown".
    """
    marked = [f"\x02{w}\x03" for w in words]
    lengths = np.array([len(w) for w in marked], np.int64)
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    room = ends[word] - np.arange(len(letters))  # letters from here to the word's end
    owners, numbers = [], []
    rolling = np.zeros(len(letters), np.uint64)
    for n in _NGRAMS:
        rolling[: len(letters) - n + 1] = rolling[: len(letters) - n + 1] * _MULTIPLIERS[0] + letters[n - 1 :] + np.uint64(1)
        at = np.flatnonzero(room >= n)
        mixed = (rolling[at] ^ (rolling[at] >> np.uint64(31))) * _MULTIPLIERS[n - 1]
        owners.append(word[at])
        numbers.append((mixed >> np.uint64(48)).astype(np.int64) % _BUCKETS)
    hashes = word_hashes(letters, starts, lengths)
    place = np.minimum(np.searchsorted(lexicon, hashes), max(0, len(lexicon) - 1))
    known = lexicon[place] == hashes if len(lexicon) else np.zeros(len(words), bool)
    owners.append(np.arange(len(words)))
    numbers.append(_BUCKETS + np.where(known, place + 1, 0))
    owners, numbers = np.concatenate(owners), np.concatenate(numbers)
    order = np.argsort(owners, kind="stable")
    return numbers[order], np.searchsorted(owners[order], np.arange(len(words) + 1))


def word_hashes(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word: a sum of letters times powers of an odd number, mixed."""
    within = np.arange(len(letters)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max(initial=1)), _MULTIPLIERS[1], np.uint64))
    sums = np.add.reduceat(letters * powers[within], starts) if len(starts) else np.zeros(0, np.uint64)
    return (sums ^ (sums >> np.uint64(29))) * _MULTIPLIERS[2]


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes under which a lexicon lists these words."""
    if not words:
        return np.zeros(0, np.uint64)
    marked = [f"\x02{w}\x03" for w in words]
    lengths = np.array([len(w) for w in marked], np.int64)
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return word_hashes(letters, np.cumsum(lengths) - lengths, lengths)


@dataclass
class Model:
    """labels: what words are labelled with; weights: a row of label weights per feature; transition: log weights."""

    labels: list[str]
    lexicon: np.ndarray
    weights: np.ndarray
    transition: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log weights of the labels of each of these words."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        numbers, begins = features(words, self.lexicon)
        return np.add.reduceat(self.weights[numbers], begins[:-1], axis=0)


def posteriors(emissions: np.ndarray, begins: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word of the chains, and, if asked for, expected label pairs summed over all chains.

    emissions: log weights per word, chains one after another; begins: first word
    of each chain and one more at the end. A chain starts from all labels alike.
    """
    k = emissions.shape[1]
    lengths = np.diff(begins)
    blocks = -(-lengths // _BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    total = int(first[-1])
    out, expected = np.zeros((len(emissions), k), np.float32), np.zeros((k, k))
    if not total:
        return out, expected
    chain = np.repeat(np.arange(len(lengths)), blocks)
    start = begins[chain] + (np.arange(total) - first[chain]) * _BLOCK
    size = np.minimum(_BLOCK, begins[chain + 1] - start)
    steps = np.minimum(start[:, None] + np.arange(_BLOCK), len(emissions) - 1).T  # (_BLOCK, total)
    valid = np.arange(_BLOCK)[:, None] < size
    weight = np.exp(emissions - emissions.max(1, keepdims=True)).astype(np.float32)
    a = np.exp(transition - transition.max()).astype(np.float32)

    product = np.broadcast_to(np.eye(k, dtype=np.float32), (total, k, k)).copy()
    for t in range(_BLOCK):
        on = np.flatnonzero(valid[t])
        new = (product[on].reshape(-1, k) @ a).reshape(-1, k, k) * weight[steps[t, on]][:, None, :]
        product[on] = new / new.max((1, 2), keepdims=True)
    incoming, outgoing = np.empty((total, k), np.float32), np.empty((total, k), np.float32)
    order = np.argsort(-blocks, kind="stable")
    active = [int(x) for x in np.searchsorted(-blocks[order], -np.arange(int(blocks.max())), "left")]
    state = np.full((len(blocks), k), 1 / k, np.float32)
    for s, n in enumerate(active):
        own = order[:n]
        at = first[own] + s
        incoming[at] = state[own]
        new = np.einsum("ni,nij->nj", state[own], product[at])
        state[own] = new / new.sum(1, keepdims=True)
    state = np.full((len(blocks), k), 1 / k, np.float32)
    for s in range(len(active) - 1, -1, -1):
        own = order[: active[s]]
        at = first[own] + s
        outgoing[at] = state[own]
        new = np.einsum("nij,nj->ni", product[at], state[own])
        state[own] = new / new.sum(1, keepdims=True)

    forward = np.empty((_BLOCK, total, k), np.float32)
    state = incoming
    for t in range(_BLOCK):
        new = (state @ a) * weight[steps[t]]
        state = np.where(valid[t][:, None], new / np.maximum(new.sum(1, keepdims=True), 1e-30), state)
        forward[t] = state
    state = outgoing
    for t in range(_BLOCK - 1, -1, -1):
        on = valid[t]
        both = forward[t] * state
        both /= np.maximum(both.sum(1, keepdims=True), 1e-30)
        out[steps[t, on]] = both[on]
        carried = weight[steps[t]] * state
        if pairs:
            before = forward[t - 1] if t else incoming
            joint = before[:, :, None] * a * carried[:, None, :]
            joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-30)
            counted = on if t else on & (start > begins[chain])
            expected += joint[counted].sum(0, dtype=np.float64)
        new = carried @ a.T
        state = np.where(on[:, None], new / np.maximum(new.sum(1, keepdims=True), 1e-30), state)
    return out, expected


def fit(
    chains: list[list[str]], labels: list[int], names: list[str], rounds: int = 3, epochs: int = 8, rate: float = 0.5, decay: float = 1e-4
) -> Model:
    """A model of chains of words that carry one label each, though some of their words belong to another.

    The first round takes every word to have its chain's label, with
    transitions left flat. Later rounds take the labels that the last model
    finds likely in each chain, with a bonus for the chain's own, as targets of
    words and of neighbouring pairs. Each round raises the conditional
    likelihood of its targets by full-batch steps with per-weight rates.
    """
    k = len(names)
    vocabulary: dict[str, int] = {}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for chain in chains for w in chain], np.int64)
    begins = np.concatenate(([0], np.cumsum([len(c) for c in chains]))).astype(np.int64)
    words = list(vocabulary)
    lexicon = np.unique(hash_words([w for w, n in zip(words, np.bincount(ids, minlength=len(words))) if n > 1]))
    model = Model(names, lexicon, np.zeros((_BUCKETS + 1 + len(lexicon), k), np.float32), np.zeros((k, k), np.float32))
    if not len(ids):
        return model
    numbers, at = features(words, lexicon)
    owner = np.repeat(np.arange(len(words)), np.diff(at))
    own = np.repeat(np.array(labels), np.diff(begins))
    hard = np.eye(k, dtype=np.float32)[own]
    squares, squares_t = np.full_like(model.weights, 1e-8), np.full((k, k), 1e-8)
    count = len(ids)
    for round_ in range(rounds):
        if round_ == 0:
            targets, target_pairs = hard, None
        else:
            sticky = np.log(np.eye(k) * 0.9 + 0.1 / k).astype(np.float32)
            emission = np.add.reduceat(model.weights[numbers], at[:-1], axis=0)[ids]
            targets, target_pairs = posteriors(emission + hard, begins, sticky if round_ == 1 else model.transition, pairs=True)
        for _ in range(epochs):
            emission = np.add.reduceat(model.weights[numbers], at[:-1], axis=0)
            found, found_pairs = posteriors(emission[ids], begins, model.transition, pairs=target_pairs is not None)
            residual = targets - found
            by_word = np.stack([np.bincount(ids, residual[:, j], len(words)) for j in range(k)], 1)
            gradient = np.stack([np.bincount(numbers, by_word[owner, j], len(model.weights)) for j in range(k)], 1) / count
            gradient -= decay * model.weights / len(model.weights)
            squares += gradient**2
            model.weights += (rate * gradient / np.sqrt(squares)).astype(np.float32)
            if target_pairs is not None:
                step = (target_pairs - found_pairs) / count
                squares_t += step**2
                model.transition += (rate * step / np.sqrt(squares_t)).astype(np.float32)
    return model
