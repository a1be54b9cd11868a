"""Log-likelihoods of whole documents by a gated recurrent language model (GRU), and by counts of words.

Tokens are words, A to Z lower-cased, and one end for each text. Words of the training texts are all counted; the HEAD most
frequent ones and the end have output units of their own, in CLASSES classes of about equal mass (of roots of counts). All other
words, known or not, are in TAILS classes by their shape. The model gives log P(class | what came before) + log P(word | class,
what came before) for the head, by a softmax over the classes and one over the class's words; inside a tail class a word has
(c + 1) of all its class's counts, plus one for every known word and one for an unknown one. So it is a distribution over words.

Training is truncated backpropagation in numpy, over windows of STEPS tokens with the state carried from window to window, by
Adam, from biases that equal the counts. It takes every window of every training text, once. Texts are dealt to lanes of about
equal length and follow each other there, so windows are full. It runs in ROUNDS: each text is of one round by a hash, each task
trains on its texts of a round from the weights so far, and Spark averages the tasks' weights by their tokens. Only the averages
reach the driver.

Scoring takes whole texts: lanes of many texts walk side by side, window by window, with the state carried to the text's end.
Texts are read once, for training and scoring: their symbols are written to the shared folder, two bytes a token.
Tasks know the counts of the FREQUENT most frequent words; other words are sent, with the number of their text's row, to a join
with the counts of all words, and what they add is summed up by row.

Null and empty texts have the end alone; very long texts are walked by one lane, in memory (also all its words, while they are split); repeated
rows get the same scores; a null id counts as held out; without training texts all words are unknown and N is 0. An empty table
gives an empty table. Columns but the named are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bytes_of_batches, written

FOLDS, HELD_OUT = 7, 2
#: Words with output units of their own; a parameter of the model, the counts go to all.
HEAD, CLASSES = 1000, 32
#: Words whose counts every task holds, at most; counts of the others are joined.
FREQUENT = 100_000
#: Shapes of the words outside the head: by bytes, up to these or more, and by whether the last one is a letter.
LENGTHS = (4, 6, 8, 10, 13, 17, 25)
TAILS = 2 * (len(LENGTHS) + 1)
#: LANES at most; with few texts fewer, so that a pool of them makes UPDATES steps or more.
HIDDEN, STEPS, LANES, UPDATES = 24, 16, 256, 300
SCORE_STEPS, SCORE_LANES = 64, 512
#: Tokens whose outputs are worked out at once in scoring, so that they stay in the cache.
BLOCK = 8192
#: Weights that a step of training goes through at once, for the same reason.
ADAM = 1 << 14
ROUNDS, RATE, WARM, SEED = 3, 0.005, 8, 20240501
#: Words that a counting task holds, with their counts; tokens that a training or scoring task holds besides those of one text.
COUNTED, POOL = 400_000, 1_500_000
LOG10 = float(np.log(10))
_f = np.float32
_OF_LENGTH = [2 * sum(n > most for most in LENGTHS) for n in range(LENGTHS[-1] + 2)]
_OF_LAST = [int(i < 128 and not 0x61 <= i <= 0x7A) for i in range(256)]


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of texts, side by side, as places in the array of distinct ones (binary) that follows; and where each text's begin, and
    the last one's end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    encoded = lists.flatten().dictionary_encode()
    codes, distinct, begin = encoded.indices.to_numpy(), encoded.dictionary.cast(pa.binary()), lists.offsets.to_numpy()
    empty = pc.index(distinct, pa.scalar(b"", pa.binary())).as_py()
    if empty >= 0:  # what stands before the first space and after the last one
        keep = codes != empty
        begin = np.concatenate([[0], np.cumsum(keep)])[begin]
        codes = codes[keep]
        codes, distinct = codes - (codes > empty), pa.concat_arrays([distinct[:empty], distinct[empty + 1 :]])
    return codes, distinct, begin


def shape(word: bytes) -> int:
    """The tail class of a word, from 0."""
    return _OF_LENGTH[min(len(word), LENGTHS[-1] + 1)] + _OF_LAST[word[-1]]


def shapes(words: pa.Array) -> np.ndarray:
    """The same of all words."""
    bounds, raw = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1], words.buffers()[2]
    last = np.frombuffer(raw, np.uint8)[bounds[1:] - 1] if len(words) else np.zeros(0, np.uint8)
    return np.array(_OF_LENGTH)[np.minimum(np.diff(bounds), LENGTHS[-1] + 1)] + np.array(_OF_LAST)[last]


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def count_words(texts: DataFrame) -> DataFrame:
    """word (binary; empty for the end) and c, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def summed() -> list[pa.RecordBatch]:
            table = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
            return table.select(["word", "c_sum"]).rename_columns(["word", "c"]).combine_chunks().to_batches()

        for batch in batches:
            codes, distinct, _ = words(batch.column(0))
            held.append(pa.RecordBatch.from_pydict({"word": distinct, "c": pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())}))
            held.append(pa.RecordBatch.from_pydict({"word": pa.array([b""], pa.binary()), "c": pa.array([batch.num_rows], pa.int64())}))
            if sum(x.num_rows for x in held) >= COUNTED:
                held = summed()
                if sum(x.num_rows for x in held) >= COUNTED // 2:
                    yield from held
                    held = []
        if held:
            yield from summed()

    return texts.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Symbols: 0 the end, then the head's words, then the tail classes. index: the frequent words, by number from 1, the head's first."""

    index: pa.Array
    symbol_of: np.ndarray  # of each number, 0 (the end) included
    counts: np.ndarray  # likewise
    head: int  # symbols that are not tail classes
    class_of: np.ndarray  # of each symbol, in two bytes, which numpy sorts by digits
    begin: np.ndarray  # of each head class: its first symbol
    end: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.begin) + TAILS

    @staticmethod
    def of(frequent: list[tuple[bytes, int]], ends: int) -> Vocabulary:
        """frequent: words and counts, most frequent first."""
        some = frequent[:HEAD]
        mass = np.sqrt(np.array([max(1, ends)] + [c for _, c in some], float))
        share = (np.cumsum(mass) - mass / 2) / mass.sum()
        kind = np.unique(np.minimum((share * CLASSES).astype(int), CLASSES - 1), return_inverse=True)[1]
        n, head = int(kind[-1]) + 1, len(kind)
        begin = np.searchsorted(kind, np.arange(n))
        symbols = np.array([*range(head), *(head + shape(w) for w, _ in frequent[HEAD:])], np.int32)
        counts = np.array([ends] + [c for _, c in frequent], np.int64)
        return Vocabulary(pa.array([w for w, _ in frequent], pa.binary()), symbols, counts, head, np.concatenate([kind, n + np.arange(TAILS)]).astype(np.uint16), begin, np.append(begin[1:], head))

    def read(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words (-1 for those that aren't frequent) and their symbols."""
        numbers = pc.fill_null(pc.add(pc.index_in(words, self.index), 1), -1).to_numpy()
        symbols = self.symbol_of[numbers]
        at = np.flatnonzero(numbers < 0)
        symbols[at] = self.head + shapes(words.take(pa.array(at)))
        return numbers, symbols


PARTS = ("x", "u", "v", "wc", "bc", "wo", "bo")


class Model:
    """x: inputs of the gates by symbol; u, v: of update and reset, of the candidate, from the state; wc, bc: classes; wo, bo: head words.

    Inside, tokens stand side by side: arrays are (units, tokens), or (steps, units, lanes), so numpy's inner loops run over tokens and
    each step has its memory together."""

    def __init__(self, vocabulary: Vocabulary, weights: dict[str, np.ndarray]) -> None:
        self.vocabulary, self.w = vocabulary, weights

    @staticmethod
    def start(vocabulary: Vocabulary, mass: np.ndarray) -> Model:
        """mass: counts by symbol, which the biases express."""
        rng, h = np.random.default_rng(SEED), HIDDEN
        n, k = len(mass), vocabulary.classes
        by_class = np.bincount(vocabulary.class_of, mass + 0.1, minlength=k)
        draw = lambda *size: rng.normal(0, 0.1, size).astype(_f)
        w = {"x": np.ascontiguousarray(draw(n, 3 * h).T), "u": draw(h, 2 * h), "v": draw(h, h), "wc": draw(h, k) * _f(0.1), "bc": np.log(by_class / by_class.sum()).astype(_f)}
        head = vocabulary.head
        return Model(vocabulary, w | {"wo": draw(head, h) * _f(0.1), "bo": np.log((mass[:head] + 0.1) / by_class[vocabulary.class_of[:head]]).astype(_f)})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[p].ravel() for p in PARTS])

    def filled(self, flat: np.ndarray) -> Model:
        """The model with these weights; if they have the weights' type, it has views of them."""
        out, at = {}, 0
        for p in PARTS:
            size = self.w[p].size
            out[p] = flat[at : at + size].reshape(self.w[p].shape).astype(_f, copy=False)
            at += size
        return Model(self.vocabulary, out)

    def walk(self, xs: np.ndarray, h: np.ndarray, learn: bool = False, fresh: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """States after each step of (steps, lanes) symbols, and what backpropagation needs. fresh: where a text begins, by a state of 0."""
        n, w = HIDDEN, self.w
        steps, lanes = xs.shape
        states = np.empty((steps, n, lanes), _f)
        kept = tuple(np.empty((steps, k, lanes), _f) for k in ((2 * n, n) if learn else ()))
        anew, goes = _begins(xs, fresh)
        u, v, h = w["u"].T, w["v"].T, h.T
        with np.errstate(over="ignore"):  # the exponential of much is infinite, what is divided by it 0
            for t in range(steps):
                if anew[t]:
                    h = h * goes[t]
                inputs = np.take(w["x"], xs[t], axis=1, mode="clip")
                zr = u @ h
                zr += inputs[: 2 * n]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                c = v @ (zr[n:] * h)
                c += inputs[2 * n :]
                c *= -2  # the hyperbolic tangent by an exponential, which takes half the time
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                if learn:
                    kept[0][t], kept[1][t] = zr, c
                c -= h
                c *= zr[:n]
                h = np.add(h, c, out=states[t])
        return states.transpose(0, 2, 1), kept

    def output(self, s: np.ndarray, ys: np.ndarray, learn: bool = False) -> tuple[np.ndarray, dict, np.ndarray | None]:
        """Natural logarithms of the probabilities of symbols ys (a tail class's words are left to the counts) after states s."""
        n, v, w = HIDDEN, self.vocabulary, self.w
        kind = v.class_of[ys]
        order = np.argsort(kind, kind="stable")
        ys, kind, rows = ys[order], kind[order], np.arange(len(ys))  # tokens of a class stand side by side
        ones = np.ones((n + 1, len(ys)), _f)  # the states and 1, by which biases are columns like the others
        np.take(s.T, order, axis=1, out=ones[:n], mode="clip")
        kinds, heads = np.vstack([w["wc"], w["bc"]]), np.hstack([w["wo"], w["bo"][:, None]])
        # exponentials of less than this neither overflow nor vanish, and need no maximum taken off
        small = max(np.abs(kinds).sum(0).max(), np.abs(heads).sum(1).max()) * max(ones.max(), -ones.min()) < 80
        p = kinds.T @ ones
        if not small:
            p -= p.max(0)
        which = kind.astype(np.intp) * len(ys) + rows
        logs = p.ravel()[which].astype(np.float64)
        np.exp(p, out=p)
        total = p.sum(0)
        logs -= np.log(total)
        grads: dict = {}
        ds = None
        if learn:
            p /= total
            p.ravel()[which] -= 1
            of_kinds, of_heads = ones @ p.T, np.zeros_like(heads)
            grads = {"wc": of_kinds[:n], "bc": of_kinds[n], "wo": of_heads[:, :n], "bo": of_heads[:, n]}
            ds = w["wc"] @ p
        cuts = np.searchsorted(kind, np.arange(len(v.begin) + 1)).tolist()
        inside = ys[: cuts[-1]] - v.begin[kind[: cuts[-1]]]
        mine, total = np.zeros(len(ys), _f), np.ones(len(ys), _f)
        for k, (a, b) in enumerate(zip(v.begin.tolist(), v.end.tolist(), strict=True)):
            some = slice(cuts[k], cuts[k + 1])
            if b - a == 1 or some.start == some.stop:
                continue
            own, out_of = ones[:, some], heads[a:b]
            q = out_of @ own
            if not small:
                q -= q.max(0)
            flat, which = q.ravel(), inside[some] * own.shape[1] + rows[: own.shape[1]]
            mine[some] = flat[which]
            np.exp(q, out=q)
            np.add.reduce(q, axis=0, out=total[some])
            if learn:
                q /= total[some]
                flat[which] -= 1
                np.matmul(q, own.T, out=of_heads[a:b])
                ds[:, some] += out_of[:, :n].T @ q
        logs += mine - np.log(total)
        out = np.empty(len(ys))
        out[order] = logs
        if learn:
            back = np.empty_like(order)
            back[order] = rows
            ds = np.take(ds, back, axis=1, mode="clip").T
        return out, grads, ds

    def gradients(self, xs: np.ndarray, ys: np.ndarray, mask: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, size: int | None = None) -> tuple[dict, np.ndarray, float]:
        """Gradients of the loss over a window (by `size`, a full one's, so that a few texts left at last move little), the state after
        it, and the summed loss. Masked steps count in nothing."""
        n, w = HIDDEN, self.w
        walked, (zr, c) = self.walk(xs, h, True, fresh)
        states = walked.transpose(0, 2, 1)
        flat = _flat(states)
        if mask.all():
            logs, grads, back = self.output(flat.T, ys.ravel(), learn=True)
            ds = back.T
        else:
            some = np.flatnonzero(mask.ravel())
            logs, grads, back = self.output(np.take(flat, some, axis=1).T, ys.ravel()[some], learn=True)
            ds = np.zeros((n, xs.size), _f)
            ds[:, some] = back.T
        ds = ds.reshape(n, *xs.shape).transpose(1, 0, 2)
        gates = np.empty((len(xs), 3 * n, xs.shape[1]), _f)
        # what does not come from later steps, for all steps at once
        anew, goes = _begins(xs, fresh)
        before = np.concatenate([h.T[None], states[:-1]])
        if any(anew):
            before *= goes[:, None]
        z, r = zr[:, :n], zr[:, n:]
        rest = 1 - zr
        of_c, of_z, of_r = z * (1 - c * c), (c - before) * z * rest[:, :n], before * r * rest[:, n:]
        d = np.zeros((n, xs.shape[1]), _f)
        for t in range(len(xs) - 1, -1, -1):
            own = gates[t]
            d += ds[t]
            drh = w["v"] @ np.multiply(d, of_c[t], out=own[2 * n :])
            np.multiply(d, of_z[t], out=own[:n])
            np.multiply(drh, of_r[t], out=own[n : 2 * n])
            drh *= r[t]
            d *= rest[t, :n]
            d += drh
            d += w["u"] @ own[: 2 * n]
            if anew[t]:
                d *= goes[t]
        gates = _flat(gates)
        grads |= {"u": _flat(before) @ gates[: 2 * n].T, "v": _flat(r * before) @ gates[2 * n :].T}
        order = np.argsort(xs.ravel().astype(np.uint16), kind="stable")
        symbols = xs.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        grads["x"] = np.zeros_like(w["x"])
        grads["x"][:, symbols[first]] = np.add.reduceat(np.take(gates, order, axis=1, mode="clip"), first, axis=1)
        for g in grads.values():
            g /= size or xs.size
        return grads, walked[-1], -float(logs.sum())


def _flat(x: np.ndarray) -> np.ndarray:
    """(units, tokens) of (steps, units, lanes)."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


def _begins(xs: np.ndarray, fresh: np.ndarray | None) -> tuple[list[bool], np.ndarray | None]:
    """Of each step of xs, whether a text begins; and 0 where one does, else 1."""
    if fresh is None:
        return [False] * len(xs), None
    return fresh.any(1).tolist(), (~fresh).astype(_f)


def windows(texts: Iterator[np.ndarray], lanes: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """All texts, side by side: (symbols before, symbols, mask, where texts begin, size of the pool's full windows) of each window; a text
    begins with the end before it.

    Of about POOL tokens at a time, the longest texts are dealt first, each to the shortest lane; in a lane they stand as they came.
    Lanes come by length, and those that are over are left out. The first window of a pool begins texts in all its lanes.
    """
    while True:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= POOL:
                break
        if not held:
            return
        queue = [(0, i) for i in range(min(len(held), max(1, min(lanes, size // (steps * UPDATES)))))]
        dealt: list[list[int]] = [[] for _ in queue]
        for i in sorted(range(len(held)), key=lambda i: -len(held[i])):
            n, k = queue[0]
            dealt[k].append(i)
            heapq.heapreplace(queue, (n + len(held[i]), k))
        dealt = sorted((sorted(own) for own in dealt), key=lambda own: -sum(len(held[i]) for i in own))
        ends = np.array([sum(len(held[i]) for i in own) for own in dealt])
        start = np.cumsum(ends) - ends
        rows = np.concatenate([held[i] for own in dealt for i in own])
        first = np.zeros(len(rows), bool)
        first[np.cumsum([0] + [len(held[i]) for own in dealt for i in own][:-1])] = True
        del held
        for at in range(0, int(ends[0]), steps):
            n = int(np.searchsorted(-ends, -at, "left"))
            step = np.arange(at, at + steps)[:, None]
            mask = step < ends[:n]
            place = np.minimum(start[:n] + step, len(rows) - 1)
            ys = np.where(mask, rows[place], 0).astype(np.intp)
            xs = np.zeros_like(ys)
            xs[1:] = ys[:-1]
            if at:  # as every text ends with 0, the next one begins with it
                xs[0] = rows[place[0] - 1]
            yield xs, ys, mask, first[place] & mask, steps * len(ends)


def train(model: Model, texts: Iterator[np.ndarray]) -> tuple[Model, int, float]:
    """The model after these texts of symbols, how many symbols there were, and their summed loss before each step."""
    flat = model.flat()
    out = model.filled(flat)
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    blocks = [slice(at, at + ADAM) for at in range(0, len(flat), ADAM)]
    h, seen, loss, t = np.zeros((0, HIDDEN), _f), 0, 0.0, 0
    for xs, ys, mask, fresh, full in windows(texts, LANES, STEPS):
        lanes = xs.shape[1]
        h = h[:lanes] if lanes <= len(h) else np.zeros((lanes, HIDDEN), _f)
        grads, h, own = out.gradients(xs, ys, mask, h, fresh, full)
        seen, loss, t = seen + int(mask.sum()), loss + own, t + 1
        rate = RATE * min(1, t / WARM) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        every = np.concatenate([grads[p].ravel() for p in PARTS])
        for some in blocks:
            g, m, q = every[some], mean[some], square[some]
            m += (g - m) * _f(0.1)
            g *= g
            g -= q
            g *= _f(0.001)
            q += g
            np.sqrt(q, out=g)
            g += _f(1e-8)
            np.divide(m, g, out=g)
            g *= _f(rate)
            flat[some] -= g
    return out, seen, loss


def score(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of what the model gives each text's symbols. Long texts come first; a lane that is free takes the next one."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    ends = np.array([len(x) for x in texts])
    start, rows = np.cumsum(ends) - ends, np.concatenate(texts)
    queue = iter(np.argsort(-ends, kind="stable").tolist())
    owner = np.array([next(queue) for _ in range(min(SCORE_LANES, len(texts)))])
    place = np.zeros(len(owner), np.int64)
    h = np.zeros((len(owner), HIDDEN), _f)
    while len(owner):
        step = place + np.arange(SCORE_STEPS)[:, None]
        mask = step < ends[owner]
        at = np.minimum(start[owner] + step, len(rows) - 1)
        ys = np.where(mask, rows[at], 0).astype(np.intp)
        xs = np.zeros_like(ys)
        xs[1:] = ys[:-1]
        xs[0] = np.where(place > 0, rows[at[0] - 1], 0)
        states, _ = model.walk(xs, h)
        flat, ys = _flat(states.transpose(0, 2, 1)), ys.ravel()
        for some in np.array_split(np.flatnonzero(mask.ravel()), -(-mask.size // BLOCK)):
            logs, _, _ = model.output(np.take(flat, some, axis=1).T, ys[some])
            out += np.bincount(owner[some % len(owner)], logs, len(texts))
        h, place = states[-1].copy(), place + SCORE_STEPS
        over = np.flatnonzero(place >= ends[owner])
        for i in over:
            nxt = next(queue, None)
            owner[i], place[i], h[i] = (-1 if nxt is None else nxt), 0, 0
        if len(over) and (owner < 0).any():
            left = owner >= 0
            owner, place, h = owner[left], place[left], h[left]
    return out / LOG10


@dataclass
class Counted:
    """A corpus's counts, the vocabulary and the untrained model; tails: N and V of each tail class."""

    model: Model
    counts: DataFrame
    tokens: int
    distinct: int
    tails: list[tuple[int, int]]


def count(docs: DataFrame) -> Counted:
    """Counts over all of docs (text)."""
    bytes_of_batches(docs.sparkSession)
    counts = written(count_words(docs), "counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = next((r["c"] for r in counts.filter("word = X''").collect()), 0)
    # the least count that no more than FREQUENT words reach
    least = counts.filter("word <> X''").groupBy("c").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(Window.orderBy(F.desc("c")))).filter(F.col("n") <= FREQUENT).agg(F.min("c")).first()[0]
    frequent = [] if least is None else [(bytes(r["word"]), r["c"]) for r in counts.filter("word <> X''").filter(F.col("c") >= least).collect()]
    frequent.sort(key=lambda x: (-x[1], x[0]))
    vocabulary = Vocabulary.of(frequent, ends)
    known = {w for w, _ in frequent[:HEAD]}

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w and w not in known:
                    k = shape(w)
                    n[k] += c
                    v[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAILS), pa.int32()), pa.array(n), pa.array(v)], ["k", "n", "v"])

    sums = {r["k"]: (r["n"], r["v"]) for r in counts.mapInArrow(tails, "k int, n bigint, v bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    sizes = [sums.get(k, (0, 0)) for k in range(TAILS)]
    mass = np.array([ends] + [c for _, c in frequent[:HEAD]] + [n for n, _ in sizes], float)
    return Counted(Model.start(vocabulary, mass), counts, tokens, distinct, sizes)


def read(texts: DataFrame, counted: Counted) -> DataFrame:
    """Of texts (doc_id, text): doc_id, row (a number), round, symbols (two bytes each), n_tokens, and of all but the others: known, base (sum
    of log10(c + 1)), tail (what words add inside their tail classes); others: words and tfs. Written, as training and scoring read it."""
    vocabulary = counted.model.vocabulary
    counts, head = vocabulary.counts, vocabulary.head
    gain = np.log10(counts + 1.0)
    shares = -np.array([0.0] * head + [np.log10(n + v + 1) for n, v in counted.tails])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = batch.num_rows
            codes, distinct, begin = words(batch.column(2))
            number, symbol = vocabulary.read(distinct)
            frequent = number >= 0
            gains = np.where(frequent, gain[number], 0)
            row = np.repeat(np.arange(rows), np.diff(begin))
            known, base, tail = (np.bincount(row, x[codes], rows).astype(float) for x in (frequent & (counts[number] > 0), gains, shares[symbol] + np.where(number >= head, gains, 0)))
            symbols = np.zeros(len(codes) + rows, "<u2")  # each text's last one stays 0, the end
            symbols[np.arange(len(codes)) + row] = symbol[codes]
            bounds = begin + np.arange(rows + 1)
            some = np.flatnonzero(~frequent[codes])
            pairs, tfs = np.unique(row[some] * len(distinct) + codes[some], return_counts=True)
            cuts = pa.array(np.searchsorted(pairs, np.arange(rows + 1) * len(distinct)), pa.int32())
            others = [pa.ListArray.from_arrays(cuts, x) for x in (distinct.take(pa.array(pairs % max(1, len(distinct)))), pa.array(tfs, pa.int64()))]
            written_out = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(symbols)])
            columns = (np.diff(bounds).astype(np.int64), known.astype(np.int64) + int(counts[0] > 0), base + gain[0], tail)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(at, at + rows)), batch.column(1), written_out, *map(pa.array, columns), *others], names)
            at += batch.num_rows

    of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).cast("int").alias("round")
    names = ["doc_id", "row", "round", "symbols", "n_tokens", "known", "base", "tail", "others", "tfs"]
    kind = texts.schema["doc_id"].dataType.simpleString()
    made = texts.select("doc_id", of, "text").mapInArrow(run, f"doc_id {kind}, row bigint, round int, symbols binary, n_tokens bigint, known bigint, base double, tail double, others array<binary>, tfs array<bigint>")
    return written(made, "read")


def _symbols(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column(column):
            yield np.frombuffer(x.as_buffer(), "<u2")


def _averaged(texts: DataFrame, model: Model) -> Model:
    """The model after one round over texts (symbols): tasks train by themselves, their weights are averaged by tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, _ = train(model, _symbols(batches, 0))
        if seen:
            flat = own.flat()
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], ["seen", "weights"])

    trained = written(texts.mapInArrow(run, "seen bigint, weights array<float>"), "weights")
    each = trained.select("seen", F.posexplode("weights").alias("at", "w")).groupBy("at").agg((F.sum(F.col("w").cast("double") * F.col("seen")) / F.sum("seen")).alias("w"))
    rows = each.orderBy("at").toArrow()
    return model.filled(rows.column("w").to_numpy()) if rows.num_rows else model


def fit(texts: DataFrame, model: Model) -> Model:
    """The model trained on all windows of all texts, as they were read (see `read`)."""
    for i in range(ROUNDS):
        model = _averaged(texts.filter(F.col("round") == i).select("symbols"), model)
    return model


def _walked(texts: DataFrame, model: Model) -> DataFrame:
    """texts, as they were read, without symbols, others and tail, but with part: what the model and the tails give."""
    names = ["doc_id", "row", "n_tokens", "known", "base", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], [], 0

        def made() -> pa.RecordBatch:
            part = score(model, held) + np.concatenate([x.column(5).to_numpy() for x in rows])
            return pa.RecordBatch.from_arrays([*[pa.concat_arrays([x.column(j) for x in rows]) for j in range(5)], pa.array(part)], names)

        for batch in batches:
            held.extend(_symbols([batch], 6))
            rows.append(batch.select(range(6)))
            size += sum(len(x) for x in held[-batch.num_rows :]) if batch.num_rows else 0
            if size >= POOL:
                yield made()
                held, rows, size = [], [], 0
        if held:
            yield made()

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select(*names[:5], "tail", "symbols").mapInArrow(run, f"doc_id {kind}, row bigint, n_tokens bigint, known bigint, base double, part double")


def likelihood(texts: DataFrame, counted: Counted, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text, as they were read, whole."""
    rare = texts.select("row", F.explode(F.arrays_zip("others", "tfs")).alias("x")).select("row", F.col("x.others").alias("word"), F.col("x.tfs").alias("tf"))
    met = rare.join(counted.counts.filter("word <> X''"), "word")  # unknown words add nothing
    sums = met.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("rare"), F.sum("tf").alias("rare_known"))
    joined = written(_walked(texts, model), "walked").join(sums, "row", "left")
    rare_sum = F.coalesce("rare", F.lit(0.0))
    base = F.col("base") + rare_sum - F.col("n_tokens") * F.log10(F.lit(float(counted.tokens + counted.distinct + 1)))
    return joined.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(counted.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("part") + rare_sum).alias("score")
    )


def scores(docs: DataFrame) -> DataFrame:
    """likelihood of every document by a model of those that are not held out, and held_out."""
    own = docs.select("doc_id", "text")
    counted = count(own.filter(~held_out(F.col("doc_id"))))
    texts = read(own, counted)
    model = fit(texts.filter(~held_out(F.col("doc_id"))), counted.model)
    out = likelihood(texts, counted, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
