"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words: a word is the sum of an embedding of its hash and the mean embedding of its character
trigrams, so unknown words are judged by their characters. The network reads windows of words in both
directions, pools the states by attention and gives one logit for each window.

Texts are scored in all windows, one from every word on. At each step of the recurrence the inputs of neighbouring windows are
neighbouring words, so a block of windows reads a slice of the words and nothing is laid out. Training takes windows at every `STRIDE` words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from pagesieve.llm.shingles import mix, word_spans

WORDS, GRAMS = 1 << 13, 1 << 12
DIM, HIDDEN = 16, 8
#: Words of a window; in training, a window at every eighth word.
WINDOW, STRIDE = 32, 8
#: Words of at most so many trigrams are added up together.
FEW = 8
#: So many windows are read at a time.
BLOCK = 1536

_FLOAT = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _power() -> tuple[np.ufunc, float]:
    """The cheaper of exp and exp2, and what an exponent of e is multiplied by for it: numpy has exp2 in vectors on few processors."""
    found = np.lib.introspect.opt_func_info(func_name="^exp2$", signature="^float32$").get("exp2", {})
    wide = any(kind["current"].startswith("AVX512") for kind in found.values())
    return (np.exp2, float(np.log2(np.e))) if wide else (np.exp, 1.0)


@dataclass
class Words:
    """The words of a run of texts: the kind of each word, and each kind's bucket and trigrams."""

    kind: np.ndarray
    bucket: np.ndarray
    grams: np.ndarray
    first_gram: np.ndarray
    counts: np.ndarray  # words by text


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    hashes, starts, ends, counts = word_spans(data, offsets)
    # The kinds ascending; any occurrence of one will do.
    order = np.argsort(hashes)
    kinds, kind = hashes[order], np.empty(len(hashes), np.int64)
    fresh = np.append(True, kinds[1:] != kinds[:-1])[: len(kinds)]
    kind[order] = np.cumsum(fresh) - 1
    kinds, first = kinds[fresh], order[fresh]
    begin, sizes = starts[first], (ends - starts)[first]
    low = data.astype(np.uint32)
    low = np.where((low >= 65) & (low <= 90), low + 32, low)
    # Trigrams with one edge on either side: as many as the word has bytes.
    total = np.cumsum(sizes)
    first_gram = total - sizes
    place = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(first_gram, sizes)
    at = np.repeat(begin, sizes) + place
    left = np.where(place > 0, low[np.maximum(at - 1, 0)], 0)
    right = np.where(place < np.repeat(sizes, sizes) - 1, low[np.minimum(at + 1, len(low) - 1)], 0) if len(at) else at
    grams = mix((left.astype(np.uint64) << np.uint64(16)) | (low[at].astype(np.uint64) << np.uint64(8)) | right.astype(np.uint64))
    return Words(kind, (kinds >> np.uint64(51)).astype(np.int64), (grams >> np.uint64(52)).astype(np.int64), first_gram, counts)


def windows(counts: np.ndarray, stride: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first word and length of the windows of each text, one at every `stride` words up to its end."""
    many = np.where(counts > 0, np.maximum(0, -(-(counts - WINDOW) // stride)) + 1, 0)
    owner = np.repeat(np.arange(len(counts)), many)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    first = np.repeat(np.cumsum(counts) - counts, many) + turn * stride
    return owner, first, np.minimum(WINDOW, counts[owner] - turn * stride)


def _laid_out(words: Words, first: np.ndarray) -> np.ndarray:
    """The kinds of the words of each window; past the end of the last text, its last word."""
    return words.kind[np.minimum(first[:, None] + np.arange(WINDOW), len(words.kind) - 1)]


@dataclass
class Network:
    """The weights; `names` in the order in which they are trained."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0

    @classmethod
    def fresh(cls, seed: int = 6) -> Network:
        draw = np.random.default_rng(seed)
        near = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(_FLOAT)
        w = {"word": near(WORDS, DIM) * 0.3, "gram": near(GRAMS, DIM)}
        for side in "fb":
            w |= {f"x{side}": near(DIM, 3 * HIDDEN), f"h{side}": near(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, _FLOAT)}
        return cls(w | {"look": near(2 * HIDDEN), "out": near(2 * HIDDEN), "bias": np.zeros(1, _FLOAT)})

    def embed(self, words: Words) -> np.ndarray:
        """The input vector of each kind of word."""
        sizes = np.diff(np.append(words.first_gram, len(words.grams)))
        sums, gram = np.zeros((len(words.bucket), DIM), _FLOAT), self.weights["gram"]
        # The longer words each at once; of the others all second trigrams, then all third ones of those that have them, and so on.
        long = np.flatnonzero(sizes > FEW)
        if len(long):
            ends = np.cumsum(sizes[long])
            begins = ends - sizes[long]
            at = np.arange(ends[-1]) + np.repeat(words.first_gram[long] - begins, sizes[long])
            sums[long] = np.add.reduceat(gram[words.grams[at]], begins, axis=0)
        order = np.argsort(-sizes, kind="stable")[len(long) :]
        first, rest = words.first_gram[order], np.zeros((len(order), DIM), _FLOAT)
        for k in range(1, FEW):
            n = np.searchsorted(-sizes[order], -k)
            rest[:n] += gram[words.grams[first[:n] + k]]
        sums[order] = gram[words.grams[first]] + rest
        return self.weights["word"][words.bucket] + sums / sizes[:, None].astype(_FLOAT)

    def _run(self, side: str, inputs: np.ndarray, places: np.ndarray, sizes: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each place, for windows of kinds `places`; `keep` collects what the gradient needs."""
        w, n = self.weights, len(places)
        recur = w[f"h{side}"]
        projected = inputs @ w[f"x{side}"] + w[f"c{side}"]
        state, out = np.zeros((n, HIDDEN), _FLOAT), np.empty((WINDOW, n, HIDDEN), _FLOAT)
        whole = bool((sizes == WINDOW).all())
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            gates, back = projected[places[:, t]], state @ recur
            zr = sigmoid(gates[:, : 2 * HIDDEN] + back[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(gates[:, 2 * HIDDEN :] + r * back[:, 2 * HIDDEN :])
            inside = None if whole else (t < sizes)[:, None]
            after = new + z * (state - new)
            if keep is not None:
                keep.append((t, state, z, r, new, back[:, 2 * HIDDEN :], inside))
            state = after if whole else np.where(inside, after, state)
            out[t] = state
        return out

    def logits(self, inputs: np.ndarray, places: np.ndarray, sizes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        w = self.weights
        steps = {s: [] for s in "fb"} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self._run(s, inputs, places, sizes, steps[s]) for s in "fb"], axis=2)
        look = states @ w["look"]
        look = np.where(np.arange(WINDOW)[:, None] < sizes, look, -1e9)
        look = np.exp(look - look.max(axis=0))
        look /= look.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", look, states)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "look": look, "pooled": pooled}
        return pooled @ w["out"] + w["bias"][0]

    def gradients(self, inputs: np.ndarray, places: np.ndarray, sizes: np.ndarray, error: np.ndarray, kept: dict) -> tuple[dict, np.ndarray]:
        """Gradients of all weights but the embeddings, and of the inputs, for the error of each logit."""
        w, states, look = self.weights, kept["states"], kept["look"]
        g = {"out": error @ kept["pooled"], "bias": error.sum(keepdims=True)}
        d_pooled = error[:, None] * w["out"]
        d_look = np.einsum("nh,tnh->tn", d_pooled, states)
        d_look = look * (d_look - (look * d_look).sum(axis=0))
        g["look"] = np.einsum("tn,tnh->h", d_look, states)
        d_states = look[:, :, None] * d_pooled + d_look[:, :, None] * w["look"]
        d_inputs = np.zeros_like(inputs)
        for s, half in (("f", slice(None, HIDDEN)), ("b", slice(HIDDEN, None))):
            recur, d = w[f"h{s}"], np.zeros((len(places), HIDDEN), _FLOAT)
            d_recur, d_projected = np.zeros_like(recur), np.zeros((len(inputs), 3 * HIDDEN), _FLOAT)
            for t, state, z, r, new, back, inside in reversed(kept["steps"][s]):
                d = d + d_states[t, :, half]
                own = d if inside is None else np.where(inside, d, 0)
                d_new = own * (1 - z) * (1 - new * new)
                d_gates = np.concatenate([own * (state - new) * z * (1 - z), d_new * back * r * (1 - r), d_new], axis=1)
                d_back = np.concatenate([d_gates[:, : 2 * HIDDEN], d_new * r], axis=1)
                d_recur += state.T @ d_back
                np.add.at(d_projected, places[:, t], d_gates)
                passed = own * z + d_back @ recur.T
                d = passed if inside is None else np.where(inside, passed, d)
            g |= {f"h{s}": d_recur, f"x{s}": inputs.T @ d_projected, f"c{s}": d_projected.sum(axis=0)}
            d_inputs += d_projected @ w[f"x{s}"].T
        return g, d_inputs

    def fit(self, words: Words, labels: np.ndarray, passes: int, batch: int, rate: float, seed: int = 6) -> None:
        """Train on texts with labels 0 and 1 by Adam.

        In the first pass a window has the label of its text. Then a text of label 1 answers only for the window with
        its greatest logit, as most of such a text is ordinary; texts of label 0 answer for all windows.
        """
        draw = np.random.default_rng(seed)
        owner, first, sizes = windows(words.counts, STRIDE)
        places = _laid_out(words, first).astype(np.int32)
        target = labels[owner].astype(_FLOAT)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        step = 0
        for turn in range(passes):
            if turn:
                logit = self.score_windows(words, places, sizes)
                best = np.zeros(len(labels), dtype=np.int64)
                order = np.argsort(logit, kind="stable")
                best[owner[order]] = order
                positive = best[np.unique(owner[target == 1])]
                negative = np.flatnonzero(target == 0)
                # The most toxic looking windows of clean texts, and as many others.
                hard = negative[np.argsort(-logit[negative], kind="stable")[: len(positive) * 2]]
                other = draw.permutation(negative)[: len(positive) * 2]
                chosen = np.concatenate([positive, positive, hard, other])
            else:
                positive, negative = np.flatnonzero(target == 1), np.flatnonzero(target == 0)
                few = min(len(positive), len(negative), batch * 40)
                chosen = np.concatenate([draw.permutation(positive)[:few], draw.permutation(negative)[:few]])
            chosen = draw.permutation(chosen)
            for i in range(0, len(chosen), batch):
                step += 1
                self._step(words, places, sizes, target, chosen[i : i + batch], moments, step, rate)

    def _step(self, words, places, sizes, target, some, moments, step, rate) -> None:
        kinds, place = np.unique(places[some], return_inverse=True)
        lengths = np.diff(np.append(words.first_gram, len(words.grams)))[kinds]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(words.first_gram[kinds] - (ends - lengths), lengths)
        part = Words(place, words.bucket[kinds], words.grams[at], ends - lengths, words.counts)
        inputs, kept = self.embed(part), {}
        place = place.reshape(len(some), WINDOW)
        logit = self.logits(inputs, place, sizes[some], kept)
        error = ((sigmoid(logit) - target[some]) / len(some)).astype(_FLOAT)
        g, d_inputs = self.gradients(inputs, place, sizes[some], error, kept)
        g["word"], g["gram"] = np.zeros_like(self.weights["word"]), np.zeros_like(self.weights["gram"])
        np.add.at(g["word"], part.bucket, d_inputs)
        np.add.at(g["gram"], part.grams, np.repeat(d_inputs / lengths[:, None].astype(_FLOAT), lengths, axis=0))
        for k, v in self.weights.items():
            m, s = moments[k]
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] * g[k] - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)

    def score_windows(self, words: Words, places: np.ndarray, sizes: np.ndarray, batch: int = 4096, inputs: np.ndarray | None = None) -> np.ndarray:
        inputs = self.embed(words) if inputs is None else inputs
        out = np.empty(len(places), dtype=np.float64)
        full = np.flatnonzero(sizes == WINDOW)
        part = np.flatnonzero(sizes < WINDOW)
        for group in (full, part):
            for i in range(0, len(group), batch):
                some = group[i : i + batch]
                out[some] = self.logits(inputs, places[some], sizes[some])
        return out

    def score_every(self, inputs: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The logits of the windows from each of the words `kind` on that has a whole window after it."""
        w, size = self.weights, inputs.dtype
        power, unit = _power()
        # Every gate is 1 / (1 + exp(u)): u is the gate's argument negated, and twice the new state's, as tanh(x) = 1 - 2 / (1 + exp(2 x)).
        # So a state 1 - 2 h is kept as h, whose last row of ones adds what this leaves over.
        scale = np.repeat([-unit, -unit, 2 * unit], HIDDEN)
        recur, read = np.empty((2, HIDDEN + 1, 3 * HIDDEN + 2), size).transpose(0, 2, 1), []
        for s, (side, half) in enumerate((("f", slice(None, HIDDEN)), ("b", slice(HIDDEN, None)))):
            # What depends on the state: the three gates, then its parts of the attention and of the logit.
            part = np.concatenate([w[f"h{side}"].T * scale[:, None], w["look"][None, half], w["out"][None, half]])
            recur[s] = np.concatenate([-2 * part, part.sum(axis=1, keepdims=True)], axis=1)
            own = inputs @ (w[f"x{side}"] * scale).astype(size) + (w[f"c{side}"] * scale).astype(size)
            # the first step comes from 0 (h = 1/2), so it is that of the word
            with np.errstate(over="ignore"):
                new = 1 / (1 + power(own[:, 2 * HIDDEN :]))
                begun = new + (size.type(0.5) - new) / (1 + power(own[:, :HIDDEN]))
            read.append(np.concatenate([own, begun], axis=1))
        # beyond the numbers' range a power is infinite, which the gate that is both divided and a divisor must not be
        most = max((r[:, :HIDDEN].max(axis=0, initial=0) + np.abs(m[:HIDDEN]).sum(axis=1)).max() for r, m in zip(read, recur, strict=True))
        free = most < 80 * unit
        out = np.empty(len(kind) - WINDOW + 1, dtype=np.float64)
        n = min(BLOCK, len(out))
        # Both directions go together, side by side in each row: the second has its words, and so its windows, from the last to the first.
        given, held = np.empty((3 * HIDDEN, 2, n + WINDOW - 1), size), np.ones((HIDDEN + 1, 2, n), size)
        back, over, seen = np.empty((3 * HIDDEN + 2, 2, n), size), np.empty((HIDDEN, 2, n), size), np.empty((WINDOW, 2, 2, n), size)
        state, gates, new, ends = held[:HIDDEN], back[: 2 * HIDDEN], back[2 * HIDDEN : 3 * HIDDEN], back[3 * HIDDEN :]
        keep, reset = gates[:HIDDEN], gates[HIDDEN:]
        factor, product = held.transpose(1, 0, 2), back.transpose(1, 0, 2)
        steps = [(given[: 2 * HIDDEN, :, t : t + n], given[2 * HIDDEN :, :, t : t + n], seen[t - 1]) for t in range(1, WINDOW)]
        for i in range(0, len(out), n):
            i = min(i, len(out) - n)
            for s, some in enumerate((kind[i : i + n + WINDOW - 1], kind[i : i + n + WINDOW - 1][::-1])):
                words = read[s].take(some, axis=0).T
                given[:, s], state[:, s] = words[: 3 * HIDDEN], words[3 * HIDDEN :, :n]
            with np.errstate(over="ignore"):
                for of_gates, of_new, part in steps:
                    np.matmul(recur, factor, out=product)
                    part[:] = ends
                    np.add(gates, of_gates, out=gates)
                    power(gates, out=gates)
                    if not free:
                        np.minimum(keep, size.type(1e30), out=keep)
                    np.add(reset, 1, out=reset)
                    np.divide(new, reset, out=new)
                    np.add(new, of_new, out=new)
                    power(new, out=new)
                    np.add(new, 1, out=new)
                    # h / (1 + exp(u)) + new / (1 + exp(-u)) over one divisor
                    np.add(keep, 1, out=over)
                    np.divide(keep, new, out=keep)
                    np.add(state, keep, out=state)
                    np.divide(state, over, out=state)
            np.matmul(recur[:, 3 * HIDDEN :], factor, out=seen[-1].transpose(1, 0, 2))
            look, value = (seen[:, r, 0] + seen[::-1, r, 1, ::-1] for r in (0, 1))
            look -= look.max(axis=0)
            np.exp(look, out=look)
            out[i : i + n] = (look * value).sum(axis=0) / look.sum(axis=0)
        return out + w["bias"][0]

    def score_texts(self, words: Words) -> np.ndarray:
        """The greatest logit of all windows of each text; -inf without a word."""
        best, inputs = np.full(len(words.counts), -np.inf), self.embed(words)
        long = words.counts >= WINDOW
        if long.any():
            counts = words.counts[long]
            ends = np.cumsum(counts)
            logits = self.score_every(inputs, words.kind[np.repeat(long, words.counts)])
            # Windows that reach into the next text lie between the end of one text's and the start of the next one's.
            bounds = np.stack([ends - counts, ends - WINDOW + 1], axis=1).ravel()[:-1]
            best[long] = np.maximum.reduceat(logits, bounds)[::2]
        short = np.flatnonzero((words.counts > 0) & ~long)
        for i in range(0, len(short), BLOCK):
            some = short[i : i + BLOCK]
            first = np.cumsum(words.counts)[some] - words.counts[some]
            best[some] = self.score_windows(words, _laid_out(words, first), words.counts[some], inputs=inputs)
        return best
