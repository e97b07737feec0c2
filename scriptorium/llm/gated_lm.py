"""A gated recurrent language model over words, trained and applied by Spark tasks.

Outputs are factored: a class, then a word of the class. Frequent words have outputs of their own; every other word
belongs to a bucket by its ending, is drawn from the bucket by its count in the whole training text, and the
network predicts the bucket. Training reads every training text once, in rounds: each shard starts from the same weights,
trains on its share of the round's documents by truncated backpropagation, and the weights of all shards are averaged by their
tokens. Shards and their order come from hashes of the rows and their number from the tokens, so the model does not depend on how rows lie in files and
tasks. Training starts afresh every ``PIECE`` tokens; scoring carries the state of a document from window to window, so its likelihood is that of the whole text.
"""

from __future__ import annotations

import copy
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed

#: Stands for the end of a text; no word holds white space.
END = "\n"
#: Words with outputs of their own; words whose counts every task holds, and their longest length.
OUTPUTS, TABLE, LONGEST = 1500, 200_000, 64
#: Buckets of all other words: endings times kinds of punctuation after them.
ENDINGS, MARKS = 32, 4
BUCKETS = ENDINGS * MARKS
CLASSES, HIDDEN = 40, 32
#: Training: rounds, which share out all texts, texts side by side, steps of backpropagation, step size.
ROUNDS, LANES, STEPS, RATE = 8, 64, 16, 0.15
#: Training tokens per shard, and shards whose weights a task averages.
SHARD_TOKENS, AVERAGED = 4_000_000, 64
#: Training reads texts in pieces of so many tokens, each from a fresh state, so that no lane is much longer than others.
PIECE = 512
#: Sum of squared gradients before the first; it keeps the first steps of rarely used weights short.
FIRST_SQUARE = 0.01
#: Scoring: texts side by side, steps per window, and texts scored at once.
ABREAST, WINDOW, TEXTS = 384, 64, 2000
SEED = 5_077
#: Numbers per row of the exchange of weights.
BLOCK = 8192


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, as ``words_of`` gives them, and their number in each text. Null has none."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, places = parts.flatten(), pc.list_parent_indices(parts).to_numpy()
    real = pc.not_equal(pc.binary_length(words), 0)
    return words.filter(real), np.bincount(places[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def bucket_of(word: bytes) -> int:
    """By the last letter or digit of a word and what follows it."""
    body = word.rstrip(b".,;:!?")
    mark = 0 if len(body) == len(word) else 1 if word[-1:] == b"," else 2 if word[-1:] == b"." else 3
    last = body[-1] if body else 0
    if 97 <= last <= 122:
        place = last - 97
    else:
        place = 26 if 48 <= last <= 57 else 27 if last < 128 else 28 + last % 4
    return place * MARKS + mark


class Vocabulary:
    """What each task holds of the corpus: the most frequent words with counts, and the totals.

    ``words``: by falling count, the end first. ``totals``: of each bucket, the tokens and distinct words without an output.
    """

    def __init__(self, words: list[str], counts: np.ndarray, n: int, distinct: int, totals: np.ndarray):
        self.table = pa.array(words, pa.string())
        self.outputs = min(OUTPUTS, len(words))
        self.n, self.distinct, self.totals = n, distinct, totals
        buckets = np.array([bucket_of(w.encode()) for w in words])
        self.symbol = np.where(np.arange(len(words)) < self.outputs, np.arange(len(words)), self.outputs + buckets)
        # The last entry is for words that are not in the table.
        self.base = np.r_[np.log10((counts + 0.5) / base_total(n, distinct)), 0.0]
        self.rest = np.r_[np.where(np.arange(len(words)) < self.outputs, 0.0, np.log10((counts + 0.5) / rest_total(totals)[buckets])), 0.0]
        self.known = np.r_[counts > 0, False]
        mass = np.r_[counts[: self.outputs], totals[:, 0]] + 1.0
        # Words of equal share by the square root of their counts make a class, in order of their counts.
        order = np.argsort(-mass, kind="stable")
        share = np.cumsum(np.sqrt(mass[order])) / np.sqrt(mass).sum()
        number = np.minimum((share * CLASSES).astype(int), CLASSES - 1)
        number = np.cumsum(np.r_[0, (np.diff(number) > 0).astype(int)])
        self.class_of, self.within = np.empty(len(mass), int), np.empty(len(mass), int)
        self.members = [order[number == c] for c in range(number[-1] + 1)]
        for c, members in enumerate(self.members):
            self.class_of[members], self.within[members] = c, np.arange(len(members))
        self.mass = mass
        # The weights of a class's words lie side by side: a symbol's row among them, its class's first row and number of rows.
        self.order = np.concatenate(self.members)
        self.sizes = np.array([len(members) for members in self.members])
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.row_of = self.starts[self.class_of] + self.within

    def looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Places in the table (-1: not there) and symbols of words; which are not there, and those words."""
        places = pc.fill_null(pc.index_in(words, value_set=self.table), -1).to_numpy(zero_copy_only=False)
        missing = np.flatnonzero(places < 0)
        rare, symbols = words.take(pa.array(missing)), self.symbol[places]
        symbols[missing] = [self.outputs + bucket_of(w.encode()) for w in rare.to_pylist()]
        return places, symbols, missing, rare

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
        """Places and symbols of the words of one text and its end, and the words that are not in the table, with their numbers."""
        places, symbols, _, rare = self.looked_up(pa.array(words, pa.binary()).cast(pa.string()))
        return np.r_[places, 0], np.r_[symbols, self.symbol[0]], Counter(rare.to_pylist())

    def symbols_of(self, texts: pa.Array) -> list[np.ndarray]:
        """The symbols of each text and its end."""
        words, counts = words_in(texts)
        return with_ends(self.looked_up(words)[1], counts, self.symbol[0])

    def for_training(self) -> Vocabulary:
        """Without the words."""
        slim = copy.copy(self)
        slim.table = None
        return slim


def with_ends(values: np.ndarray, counts: np.ndarray, end) -> list[np.ndarray]:
    """The values text by text, each text with one more for its end."""
    cuts = np.cumsum(counts)
    return np.split(np.insert(values, cuts, end), (cuts + np.arange(1, len(counts) + 1))[:-1])


def base_total(n: int, distinct: int) -> float:
    return n + 0.5 * (distinct + 1)


def rest_total(totals: np.ndarray) -> np.ndarray:
    return totals[:, 0] + 0.5 * (totals[:, 1] + 1)


class Network:
    """Weights as views of one vector. Inputs of words go straight to the gates. Rows of ``ww`` and ``bw`` are in the order of the classes."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        n, h, c = len(vocabulary.mass), HIDDEN, len(vocabulary.members)
        # Biases are the last row or column of the weights that they belong to.
        self.shapes = {"e": (n + 1, 3 * h), "u": (h, 3 * h), "c": (h + 1, c), "w": (n, h + 1)}
        sizes = [int(np.prod(s)) for s in self.shapes.values()]
        self.flat = np.zeros(sum(sizes), "f4") if flat is None else flat
        for (name, shape), end in zip(self.shapes.items(), np.cumsum(sizes), strict=True):
            setattr(self, name, self.flat[end - int(np.prod(shape)) : end].reshape(shape))
        self.wc, self.bc, self.ww, self.bw = self.c[:h], self.c[h], self.w[:, :h], self.w[:, h]
        self.vocabulary = vocabulary
        if flat is None:
            random = np.random.default_rng(SEED)
            self.e[:] = random.normal(0, 0.3, self.e.shape)
            self.u[:] = random.normal(0, h**-0.5, self.u.shape)
            self.wc[:] = random.normal(0, 0.05, self.wc.shape)
            self.ww[:] = random.normal(0, 0.05, self.ww.shape)[vocabulary.order]
            # It starts as the distribution of single words.
            self.bw[:] = np.log(vocabulary.mass[vocabulary.order])
            for k, members in enumerate(vocabulary.members):
                self.bc[k] = np.log(vocabulary.mass[members].sum())

    def by_gate(self, weights: np.ndarray) -> np.ndarray:
        """``(..., 3, rows, HIDDEN)`` of ``(..., rows, 3 * HIDDEN)``: the parts for each gate, the first two with the other sign."""
        parts = np.ascontiguousarray(np.swapaxes(weights.reshape(*weights.shape[:-1], 3, HIDDEN), -2, -3))
        np.negative(parts[..., :2, :, :], out=parts[..., :2, :, :])
        return parts

    def turned(self) -> np.ndarray:
        """``u`` for ``advance``."""
        u = self.u.copy()
        np.negative(u[:, : 2 * HIDDEN], out=u[:, : 2 * HIDDEN])
        return u

    def advance(self, given: np.ndarray, u: np.ndarray, h: np.ndarray, own: np.ndarray, after: np.ndarray) -> None:
        """One step, in place: ``given`` (the inputs by gate) becomes both gates and the new part, ``own`` what the state gives them, ``after`` the next state.

        Where ``exp`` overflows the gate is 0, so callers ignore that.
        """
        np.matmul(h, u, out=own)
        parts, gates, new = np.swapaxes(own.reshape(-1, 3, HIDDEN), 0, 1), given[:2], given[2]
        gates += parts[:2]
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.multiply(gates[1], parts[2], out=after)
        new += after
        np.tanh(new, out=new)
        np.subtract(h, new, out=after)
        after *= gates[0]
        after += new

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        """The gates and the next state of each lane, from the symbol read and the state."""
        given, after = self.by_gate(self.e[x]), np.empty((len(x), HIDDEN), self.flat.dtype)
        own = np.empty((len(x), 3 * HIDDEN), self.flat.dtype)
        with np.errstate(over="ignore"):
            self.advance(given, self.turned(), h, own, after)
        return given[0], given[1], given[2], own[:, 2 * HIDDEN :], after

    def word_logits(self, h: np.ndarray, rows: np.ndarray, w: np.ndarray) -> tuple:
        """Logits of all words of the classes of ``rows`` (places in ``w``), one state after the other in one vector, states by class.

        Also: the states' order, the states in that order with a 1 for the bias, the places where a state's logits start, their numbers, and
        ``(class, first state, last, first logit, last)`` of each class that is there.
        """
        v = self.vocabulary
        order = np.argsort(rows.astype("u2" if len(v.order) < 65_536 else "i8"), kind="stable")
        rows = rows[order]
        cuts = np.searchsorted(rows, v.starts)
        states = np.ones((len(h), HIDDEN + 1), w.dtype)
        states[:, :HIDDEN] = h[order]
        counts = np.diff(cuts)
        many = np.repeat(v.sizes, counts)
        ends = np.r_[0, np.cumsum(counts * v.sizes)].tolist()
        logits = np.empty(ends[-1], h.dtype)
        there, cuts = np.flatnonzero(counts).tolist(), cuts.tolist()
        spans = [(c, cuts[c], cuts[c + 1], ends[c], ends[c + 1]) for c in there]
        firsts = v.starts.tolist()
        for c, a, b, i, j in spans:
            np.matmul(states[a:b], w[firsts[c] : firsts[c + 1]].T, out=logits[i:j].reshape(b - a, -1))
        starts = np.cumsum(many) - many
        return logits, order, states, starts, many, starts + rows - np.repeat(v.starts[:-1], counts), spans

    def log_probabilities(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the targets.

        Products are in doubles, here and in ``text_scores``: rounding in a product depends on the number of its rows, and scores should not depend on neighbours.
        """
        v, kind = self.vocabulary, h.dtype
        logits = np.matmul(h, self.wc.astype("f8")).astype(kind)
        logits += self.bc
        out = logits[np.arange(len(h)), v.class_of[target]]
        out -= np.log(np.exp(logits, out=logits).sum(axis=1))
        if len(h):
            logits, order, _, starts, _, goals, _ = self.word_logits(h, v.row_of[target], self.w.astype("f8"))
            words = logits[goals]
            words -= np.log(np.add.reduceat(np.exp(logits, out=logits), starts))
            out[order] += words
        return out

    def gradients(self, x: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, tuple]:
        """Of ``(steps, lanes)`` symbols read and to predict: gradients of the dense weights, the last state, and the gradients of inputs and words by row.

        ``fresh``: the lane starts a text at this step, so the state before is zero. ``rest`` of the dense gradients is one vector: all weights but the inputs'.
        """
        v, k, kind, (steps, lanes) = self.vocabulary, HIDDEN, self.flat.dtype, x.shape
        given, own = self.by_gate(self.e[x]), np.empty((steps, lanes, 3 * k), kind)
        before, states = np.empty((steps, lanes, k), kind), np.empty((steps, lanes, k), kind)
        u, some = self.turned(), fresh.any(axis=1).tolist()
        with np.errstate(over="ignore"):
            for t in range(steps):
                before[t] = h
                if some[t]:
                    before[t][fresh[t]] = 0
                self.advance(given[t], u, before[t], own[t], states[t])
                h = states[t]
        rest = np.zeros(len(self.flat) - self.e.size, kind)
        grads, at = {"rest": rest}, 0
        for name in ("u", "c", "w"):
            grads[name] = rest[at : at + getattr(self, name).size].reshape(self.shapes[name])
            at += grads[name].size
        grads["wc"], grads["bc"] = grads["c"][:k], grads["c"][k]
        flat, goal = states.reshape(-1, k), target.ravel()
        p = flat @ self.wc
        p += self.bc
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(goal)), v.class_of[goal]] -= 1
        np.matmul(flat.T, p, out=grads["wc"])
        p.sum(axis=0, out=grads["bc"])
        dh = p @ self.wc.T
        q, order, sorted_states, starts, many, goals, spans = self.word_logits(flat, v.row_of[goal], self.w)
        q -= np.repeat(np.maximum.reduceat(q, starts), many)
        np.exp(q, out=q)
        q /= np.repeat(np.add.reduceat(q, starts), many)
        q[goals] -= 1
        words, found, firsts = [], np.empty((len(flat), k + 1), kind), v.starts.tolist()
        for c, a, b, i, j in spans:
            members, one = slice(firsts[c], firsts[c + 1]), q[i:j].reshape(b - a, -1)
            np.matmul(one.T, sorted_states[a:b], out=grads["w"][members])
            np.matmul(one, self.w[members], out=found[a:b])
            words.append((members, grads["w"][members, :k], grads["w"][members, k]))
        dh[order] += found[:, :k]
        dh = dh.reshape(steps, lanes, k)
        z, r, new = given[:, 0], given[:, 1], given[:, 2]
        to_new = (1 - z) * (1 - new * new)
        to_z = (before - new) * z * (1 - z)
        to_r = own[:, :, 2 * k :] * r * (1 - r)
        d_own, d_new, back = np.empty((steps, lanes, 3 * k), kind), np.empty((steps, lanes, k), kind), np.ascontiguousarray(self.u.T)
        for t in reversed(range(steps)):
            d = dh[t]
            if t < steps - 1:
                d += d_after
            np.multiply(d, to_z[t], out=d_own[t, :, :k])
            np.multiply(d, to_new[t], out=d_new[t])
            np.multiply(d_new[t], to_r[t], out=d_own[t, :, k : 2 * k])
            np.multiply(d_new[t], r[t], out=d_own[t, :, 2 * k :])
            d_after = d_own[t] @ back
            d *= z[t]
            d_after += d
            if some[t]:
                d_after[fresh[t]] = 0
        np.matmul(before.reshape(-1, k).T, d_own.reshape(-1, 3 * k), out=grads["u"])
        d_own[:, :, 2 * k :] = d_new
        return grads, h, (_sums_by(x.ravel(), d_own.reshape(-1, 3 * k)), words)


def _sums_by(names: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names, and the sums of their rows. Names that come a few times are summed row by row, which is the faster way."""
    order = np.argsort(names.astype("u2") if names.max() < 65_536 else names, kind="stable")
    named = names[order]
    starts = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
    counts = np.diff(np.r_[starts, len(named)])
    sums = rows[order[starts]]
    for i in range(1, 4):
        more = np.flatnonzero((counts > i) & (counts < 5))
        sums[more] += rows[order[starts[more] + i]]
    often = counts > 4
    if often.any():
        many = counts[often]
        sums[often] = np.add.reduceat(rows[order[np.repeat(often, counts)]], np.cumsum(many) - many, axis=0)
    return named[starts], sums


class Trainer:
    """Adaptive steps from the sums of squared gradients."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate = network, rate
        self.squares = Network(network.vocabulary, np.full_like(network.flat, FIRST_SQUARE))

    def _move(self, gradient: np.ndarray, squares: np.ndarray, weights: np.ndarray) -> None:
        """All in place; a gradient of zero leaves its weight as it is."""
        gradient /= LANES
        np.clip(gradient, -5, 5, out=gradient)
        squares += gradient * gradient
        gradient *= self.rate
        gradient /= np.sqrt(squares)
        weights -= gradient

    def train(self, texts) -> int:
        """Trains on texts of symbols; lanes read them one after the other. The tokens read."""
        n = len(self.network.vocabulary.mass)  # the symbol read before the first word
        inputs = self.network.e.size

        def pieces():
            for symbols in texts:
                read = np.empty(len(symbols), "i4")
                read[:1], read[1:] = n, symbols[:-1]
                yield from ((read[i : i + PIECE], symbols[i : i + PIECE]) for i in range(0, len(symbols), PIECE))

        # Of each lane: symbols read, symbols to predict, and whether a piece starts there, from ``begin`` to ``end``.
        lanes = np.zeros((3, LANES, STEPS + PIECE), "i4")
        begin, end = np.zeros(LANES, int), np.zeros(LANES, int)
        h, total, coming, going = np.zeros((LANES, HIDDEN), "f4"), 0, pieces(), True
        while True:
            for i in np.flatnonzero(end - begin < STEPS).tolist() if going else ():
                size = int(end[i] - begin[i])
                lanes[:, i, :size] = lanes[:, i, begin[i] : end[i]].copy()
                while going and size < STEPS:
                    piece = next(coming, None)
                    going = piece is not None
                    if going:
                        to = size + len(piece[0])
                        lanes[0, i, size:to], lanes[1, i, size:to], lanes[2, i, size:to] = *piece, 0
                        lanes[2, i, size] = 1
                        size = to
                begin[i], end[i] = 0, size
            left = end - begin
            full = np.flatnonzero(left >= STEPS)
            if not len(full):
                full = np.flatnonzero(left)
                if not len(full):
                    return total
            steps = min(STEPS, int(left[full].min()))
            x, target, fresh = lanes[:, full, begin[full] + np.arange(steps)[:, None]]
            grads, h[full], (touched, _) = self.network.gradients(x, target, fresh > 0, h[full])
            rows, gradient = touched
            squares, weights = self.squares.e[rows], self.network.e[rows]
            self._move(gradient, squares, weights)
            self.squares.e[rows], self.network.e[rows] = squares, weights
            self._move(grads["rest"], self.squares.flat[inputs:], self.network.flat[inputs:])
            begin[full] += steps
            total += steps * len(full)


def text_scores(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Log10 probabilities of texts of symbols, each with its end."""
    out, start = np.zeros(len(texts)), len(network.vocabulary.mass)
    e, u, gates = network.by_gate(network.e).reshape(-1, HIDDEN), network.turned().astype("f8"), np.arange(3)[:, None] * len(network.e)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for a in range(0, len(order), ABREAST):
        part = order[a : a + ABREAST]  # longest first, so lanes end from the back
        sizes = np.array([len(texts[i]) for i in part])
        h, last, at = np.zeros((len(part), HIDDEN), network.flat.dtype), np.full(len(part), start), 0
        while at < sizes[0]:
            lanes = int((sizes > at).sum())
            steps = int(min(WINDOW, sizes[0] - at))
            goals = np.zeros((steps, lanes), int)
            for i in range(lanes):
                piece = texts[part[i]][at : at + steps]
                goals[: len(piece), i] = piece
            h, last = h[:lanes], last[:lanes]
            states, own = np.empty((steps, lanes, HIDDEN), network.flat.dtype), np.empty((lanes, 3 * HIDDEN), "f4")
            read = np.concatenate([last[None], goals[:-1]])[:, None] + gates
            with np.errstate(over="ignore"):
                for t in range(steps):
                    network.advance(e.take(read[t], axis=0), u, h, own, states[t])
                    h = states[t]
            last = goals[-1]
            real = np.arange(at, at + steps)[:, None] < sizes[:lanes]
            logs = np.zeros((steps, lanes))
            logs[real] = network.log_probabilities(states[real], goals[real])
            out[part[:lanes]] += logs.sum(axis=0)
            at += steps
    return out / np.log(10)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(token, c)``: the words and ends of all texts. Each task counts before rows are exchanged; its table is given out when it gets large."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                found = pc.value_counts(words_in(batch.column(0).slice(a, TEXTS))[0])
                counts.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
            counts[END] += batch.num_rows
            if len(counts) > 500_000:
                yield made(counts)
                counts = Counter()
        if counts:
            yield made(counts)

    def made(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "c"])

    return docs.select(docs[text].alias("text")).mapInArrow(run, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def _bucket_totals(counts: DataFrame, outputs: set[str]) -> np.ndarray:
    """Tokens and distinct words of each bucket, without the words that have an output."""

    def run(batches):
        total = np.zeros((BUCKETS, 2), "i8")
        for batch in batches:
            for token, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if token not in outputs:
                    total[bucket_of(token.encode())] += (c, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], ["b", "n", "v"])

    out = np.zeros((BUCKETS, 2), "i8")
    for b, n, v in counts.mapInArrow(run, "b int, n bigint, v bigint").groupBy("b").agg(F.sum("n"), F.sum("v")).collect():
        out[b] = n, v
    return out


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """From counted words. At most ``TABLE`` short words and ``BUCKETS`` totals reach the driver, and then every task."""
    n, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == END, F.col("c"))), F.lit(0))).first()
    top = counts.filter((F.octet_length("token") <= LONGEST) & (F.col("token") != END)).orderBy(F.desc("c"), "token").limit(TABLE).toArrow()
    words = [END, *top.column("token").to_pylist()]
    number = np.array([ends, *top.column("c").to_pylist()])
    return Vocabulary(words, number, n, distinct, _bucket_totals(counts, set(words[:OUTPUTS])))


@lru_cache(1)
def _network_of(handle) -> tuple[Vocabulary, Network]:
    vocabulary, flat = handle.value
    return vocabulary, Network(vocabulary, flat)


def shards_of(tokens: int) -> int:
    """Training shards by the tokens to learn from: how the rows lie in files or tasks plays no part."""
    return max(1, -(-tokens // SHARD_TOKENS))


def training_texts(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary, shards: int, rounds: int) -> DataFrame:
    """``(shard, round, name, symbols)``: every text once, as two bytes a token; one partition per shard, in an order of its own.

    A hash of key and text deals the rows. Rows that agree in both are alike, so their order does not matter.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def work(batches):
        vocabulary = sent.value
        for batch in batches:
            made = [symbols.astype("<u2").tobytes() for symbols in vocabulary.symbols_of(batch.column("text"))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("shard", "round", "name")], pa.array(made, pa.binary())], ["shard", "round", "name", "symbols"])

    name = F.xxhash64(key, text)
    slot = F.pmod(name, F.lit(shards * rounds))
    dealt = docs.select((slot % shards).cast("int").alias("shard"), F.floor(slot / shards).cast("int").alias("round"), F.xxhash64(name).alias("name"), F.col(text).alias("text"))
    rows = dealt.mapInArrow(work, "shard int, round int, name bigint, symbols binary")
    return checkpointed(rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("round", "name", "symbols"))


def _averaged(moves: DataFrame, shards: int) -> DataFrame:
    """``(i, row)``: the mean of the shards' moves by their tokens; some shards at a time, so that no task holds very many."""

    def mean(group: pa.Table) -> pa.Table:
        seen = np.array(group.column("seen").to_pylist(), "f8")
        rows = [np.frombuffer(row, "f4") for row in group.column("row").to_pylist()]
        total = sum(s * row for s, row in sorted(zip(seen, rows, strict=True), key=lambda x: (x[0], x[1].tobytes()))) / seen.sum()
        return pa.table({"i": group.column("i")[:1], "shard": group.column("shard")[:1], "seen": pa.array([int(seen.sum())], pa.int64()), "row": pa.array([total.astype("f4").tobytes()], pa.binary())})

    while True:
        shards = -(-shards // AVERAGED)
        grouped = moves.withColumn("shard", F.floor(F.col("shard") / AVERAGED).cast("int"))
        moves = grouped.groupBy("i", "shard").applyInArrow(mean, "i int, shard int, seen bigint, row binary")
        if shards == 1:
            return moves


def train(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary, rounds: int = ROUNDS, shards: int | None = None) -> np.ndarray:
    """The weights. Each round reads the texts of its own, and all rounds together read every text once.

    In a round every shard starts from the same weights and trains on its texts in their order. The result depends on the rows alone, not on the tasks
    that they lie in.
    """
    spark, network = docs.sparkSession, Network(vocabulary)
    shards = shards_of(vocabulary.n) if shards is None else shards
    blocks = -(-len(network.flat) // BLOCK)
    texts = training_texts(docs, key, text, vocabulary, shards, rounds)
    for number in range(rounds):
        sent = spark.sparkContext.broadcast((vocabulary.for_training(), network.flat))

        def run(batches, sent=sent, rate=RATE / (1 + 2 * number / rounds)):
            vocabulary, flat = sent.value
            mine, shard = Network(vocabulary, flat.copy()), []

            def read():
                for batch in batches:
                    shard[:] = batch.column("shard")[:1].to_pylist() or shard
                    for symbols in batch.column("symbols").to_pylist():
                        yield np.frombuffer(symbols, "<u2").astype(int)

            seen = Trainer(mine, rate).train(read())
            if seen:
                moved = (mine.flat - flat).astype("f4")
                rows = [moved[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(blocks)]
                columns = [pa.array(range(blocks), pa.int32()), pa.array(shard * blocks, pa.int32()), pa.array([seen] * blocks, pa.int64()), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["i", "shard", "seen", "row"])

        moves = texts.filter(F.col("round") == number).mapInArrow(run, "i int, shard int, seen bigint, row binary")
        found = _averaged(moves, shards).collect()
        if found:
            moved = np.concatenate([np.frombuffer(row["row"], "f4") for row in sorted(found, key=lambda r: r["i"])])
            network = Network(vocabulary, network.flat + moved)
    return network.flat


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: the checksum of its key."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 1


def score(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs``.

    Learns from the rows that are not held out; rows with a null key are learnt from too. Null texts are empty: they have the
    end alone. Repeated keys are told apart by a number of their own, so each row gives one row. With nothing to learn
    from, all counts are 0. Words outside the table of frequent words get their counts by a join with all words;
    only such words move, one row for each in a document.
    """
    spark = docs.sparkSession
    learnt = docs.filter(F.coalesce(~held_out(F.col(key)), F.lit(True)))
    counts = checkpointed(word_counts(learnt, text))
    vocabulary = vocabulary_of(counts)
    sent = spark.sparkContext.broadcast((vocabulary, train(learnt, key, text, vocabulary)))

    names = ["key", "row", "token", "n", "bucket", "n_tokens", "n_known", "base", "model"]

    def run(batches):
        vocabulary, network = _network_of(sent)
        for batch in batches:
            # A whole batch is scored at once: texts of like length go side by side.
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                words, counts = words_in(part.column("text"))
                places, symbols, missing, rare = vocabulary.looked_up(words)
                scores = text_scores(network, with_ends(symbols, counts, vocabulary.symbol[0]))
                starts, places = np.r_[0, np.cumsum(counts + 1)[:-1]], np.insert(places, np.cumsum(counts), 0)
                sums = [np.add.reduceat(x[places], starts) for x in (vocabulary.known.astype("i8"), vocabulary.base, vocabulary.rest)]
                nothing = np.zeros(part.num_rows, "i8")
                columns = [nothing, nothing.astype("i4"), counts + 1, sums[0], sums[1], scores + sums[2]]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("row"), pa.nulls(part.num_rows, pa.string()), *map(pa.array, columns)], names)
                if len(missing):
                    of = np.repeat(np.arange(part.num_rows), counts)[missing]
                    found = pa.table({"of": of, "token": rare, "bucket": symbols[missing] - vocabulary.outputs})
                    found = found.group_by(["of", "token", "bucket"], use_threads=False).aggregate([([], "count_all")]).combine_chunks().to_batches()[0]
                    nothing, of = np.zeros(found.num_rows, "i8"), found.column("of")
                    columns = [found.column("token"), found.column("count_all"), found.column("bucket").cast(pa.int32()), *map(pa.array, [nothing, nothing, nothing * 0.0, nothing * 0.0])]
                    yield pa.RecordBatch.from_arrays([part.column("key").take(of), part.column("row").take(of), *columns], names)

    kind = docs.schema[key].dataType.simpleString()
    numbered = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = f"key {kind}, row bigint, token string, n bigint, bucket int, n_tokens bigint, n_known bigint, base double, model double"
    rows = numbered.mapInArrow(run, schema)
    # The one row that each document has without a token meets nothing, wherever it goes: a name of its own keeps these rows apart.
    named = rows.withColumn("_token", F.coalesce("token", F.concat(F.lit(END), F.col("row"))))
    joined = named.join(counts.withColumnRenamed("token", "_token"), "_token", "left")
    c = F.coalesce("c", F.lit(0))
    rest = F.get(F.array(*[F.lit(float(x)) for x in rest_total(vocabulary.totals)]), F.col("bucket"))
    rare = lambda total: F.when(F.col("n") > 0, F.col("n") * F.log10((c + 0.5) / total)).otherwise(0.0)
    parts = joined.select(
        "key",
        "row",
        "n_tokens",
        (F.col("n_known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        (F.col("base") + rare(F.lit(base_total(vocabulary.n, vocabulary.distinct)))).alias("base"),
        (F.col("model") + rare(rest)).alias("model"),
    )
    return (
        parts.groupBy("row", "key")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("model").alias("score"))
        .select(
            F.col("key").alias(key), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), "n_tokens", "n_known",
            F.lit(vocabulary.n).cast("bigint").alias("train_tokens"), "base_score", "score",
        )
    )
