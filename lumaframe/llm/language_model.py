"""Document log-likelihood under a gated recurrent language model.

Tokens are words, lower-cased, with one end token for each document. All training tokens are
counted. The most frequent words make the vocabulary of a recurrent network with an update gate
(h = z h + (1 - z) tanh(...)). The output softmax is factored in classes: first the class, then
the word in its class. Classes of frequent words have a softmax of their own. All other words fall
into classes by their letters and count, in which a word has its share of the class's counts, with
half a count added for each word and for words never met, as in the base model. So the model spreads
its probability over the same words as the base model does, and learns when to expect which class.

The head of the counts, of bounded size, is sent to every task. The shares of words outside it do
not depend on the network's state, so they are found by joining their occurrences with the counts.
Texts are turned into model numbers once, two bytes a token, and written to the shared folder;
training and scoring read these.

Training is truncated backpropagation through windows, in numpy. The training documents are dealt by
a hash of their doc_id and text to shards of about SHARD_TOKENS tokens, whatever the cluster's
partitions. A shard's documents stand end to end in BATCH streams of one length, which are worked on
side by side, window by window: every token of every training document is learned from once, none
twice. The shards' parameters are averaged in a tree of Spark aggregations, and the average starts
the next round; the rounds deal the documents out among them. Scoring carries the state of a
document from window to window to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumaframe.llm.common import cut, top_rows, written
from lumaframe.llm.words import numbered

FOLDS, HELD_OUT = 5, 1
#: Words with a softmax of their own (the end token among them), in classes of CLASS_WORDS.
FREQUENT, CLASS_WORDS = 1024, 32
#: Other words' classes: by their letters (KINDS) and count (LEVELS); words outside the head have a class for each kind.
KINDS, LEVELS = 8, 4
RARE = KINDS * (LEVELS + 1)
STATE = 16
#: The rounds deal the training documents out among them: each is trained on once.
ROUNDS = 2
WINDOW, BATCH = 24, 256
RATE = 0.02
#: Tokens of a shard, about; each shard is trained on by one task.
SHARD_TOKENS = 3_000_000
#: Words whose counts are sent to every task.
HEAD = 120_000
#: Distinct words that a task counts before it sends them on.
FLUSH = 300_000
END = "\n"
#: Texts are worked on in groups of about so many bytes; so many documents are scored side by side.
GROUP_BYTES, SIDE = 12_000_000, 4096
#: Rows of class scores that are worked on together: they stay in a processor's cache.
STEP = 1 << 12
#: Partial averages that reach the driver in a round.
SHARDS = 8


def kind_of(word: str) -> int:
    """0 for words of ASCII characters only, else 1 to KINDS - 1 by the greatest character."""
    return 0 if word.isascii() else 1 + ord(max(word)) % (KINDS - 1)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all (text) rows; the end token is the word "\\\\n"."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(map(kind_of, held)), pa.int32()), pa.array(list(held.values()), pa.int64())], ["word", "kind", "n"])
            held.clear()
            return out

        for b in batches:
            for _, texts in groups(b.column(0)):
                words, number, _ = numbered(texts, plain=False)
                often = np.bincount(number, minlength=len(words))
                for w, n in zip(words.to_pylist(), often.tolist(), strict=True):
                    if n:
                        held[w] = held.get(w, 0) + n
                held[END] = held.get(END, 0) + len(texts)
                if len(held) > FLUSH:
                    yield flush()
        yield flush()

    return texts.mapInArrow(count, "word string, kind int, n bigint").groupBy("word", "kind").agg(F.sum("n").alias("n"))


def groups(column: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of rows with about ``size`` bytes."""
    sizes = np.array(pc.fill_null(pc.binary_length(column), 0), np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size)))
        yield first, column.slice(first, last - first)
        first = last


class Vocabulary:
    """The head of the counts, and which class and place each word has in the model.

    ``head``: the most frequent words with their counts; ``beyond``: by kind, the words and tokens
    outside it.
    """

    def __init__(self, head: list[tuple[str, int]], beyond: dict[int, tuple[int, int]]) -> None:
        self.counts = dict(head)
        self._head: tuple | None = None
        own = [w for w, _ in head if w != END][: FREQUENT - 1] + [END]
        self.own_classes = FREQUENT // CLASS_WORDS
        self.classes = self.own_classes + RARE
        self.number = {w: i for i, w in enumerate(own)}
        self.beyond = beyond
        mass = np.zeros(self.classes)
        for kind in range(KINDS):
            words, tokens = beyond.get(kind, (0, 0))
            mass[self.own_classes + kind] = tokens + 0.5 * (words + 1)
        for w, n in head:
            if w not in self.number:
                self.number[w] = (self.own_classes + KINDS * (1 + min(LEVELS - 1, int(np.log2(n)) // 4)) + kind_of(w)) * CLASS_WORDS
                mass[self.number[w] // CLASS_WORDS] += n + 0.5
        self.mass = np.maximum(mass, 0.5)

    def of(self, word: str) -> int:
        """class * CLASS_WORDS + place; words of the other classes stand at place 0."""
        found = self.number.get(word)
        return (self.own_classes + kind_of(word)) * CLASS_WORDS if found is None else found

    def biases(self) -> tuple[np.ndarray, np.ndarray]:
        """Logs of the classes' tokens, and of the frequent words' counts in their classes: where training starts."""
        total = np.concatenate([np.full(self.own_classes, 0.5), self.mass[self.own_classes :]])
        word = np.full((self.classes, CLASS_WORDS), -6.0)
        for w, i in self.number.items():
            if i < FREQUENT:
                n = self.counts.get(w, 0)
                total[i // CLASS_WORDS] += n
                word[i // CLASS_WORDS, i % CLASS_WORDS] = np.log(n + 0.5)
        return np.log(total), word

    def shares(self, number: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of a head word's share of its class; 0 for words with a softmax of their own and for words outside the head."""
        kind = number // CLASS_WORDS
        rare = (kind >= self.own_classes) & (count > 0)
        return np.where(rare, np.log10((count + 0.5) / self.mass[kind]), 0.0)

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(model number, count in the head) of distinct words."""
        if self._head is None:
            names = list(self.counts)
            self._head = pa.array(names, pa.large_string()), np.fromiter(map(self.of, names), np.int32, len(names)), np.fromiter(self.counts.values(), np.int64, len(names))
        names, number, count = self._head
        at = pc.index_in(words, names)
        outside = np.asarray(at.is_null())
        at = np.asarray(at.fill_null(0))
        ids, often = (number[at], count[at]) if len(number) else (np.zeros(len(at), np.int32), np.zeros(len(at), np.int64))
        away = np.flatnonzero(outside)
        ids[away] = [self.of(w) for w in words.take(pa.array(away)).to_pylist()]
        often[away] = 0
        return ids, often

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(model number, count in the head, first token by text) of all tokens, each text with its end token; and the
        words outside the head as (words, text, word's number) of each occurrence."""
        words, number, starts = numbered(texts, plain=False)
        ids, count = self.numbers(words)
        ends = starts[1:] + np.arange(len(texts))
        inside = np.ones(len(number) + len(texts), bool)
        inside[ends] = False
        out_ids, out_count = np.empty(len(inside), np.uint16), np.empty(len(inside), np.int64)
        out_ids[inside], out_count[inside] = ids[number], count[number]
        out_ids[ends], out_count[ends] = self.of(END), self.counts.get(END, 0)
        away = np.flatnonzero((count == 0)[number])
        return out_ids, out_count, np.concatenate([[0], ends + 1]), (words, np.searchsorted(starts, away, side="right") - 1, number[away])


def softmax(H: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Probabilities from states and a constant one (rows of ``H``).

    States lie between -1 and 1, so the weights bound the scores, and one shift for all rows keeps
    the exponentials in range; only with very large weights is each row shifted by its own maximum.
    """
    s = H @ C
    reach = np.abs(C[:-1]).sum(0)
    if 2 * reach.max(initial=0) < 60:
        s -= (C[-1] + reach).max()
    else:
        s -= s.max(1, keepdims=True)
    np.exp(s, out=s)
    s *= (1 / (s @ np.ones(C.shape[1], s.dtype)))[:, None]
    return s


class Model:
    """Parameters and passes of the network: one array of 32-bit floats, and views of its parts."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        classes, self.own = vocabulary.classes, vocabulary.own_classes
        self.start = vocabulary.of(END)
        c, v = vocabulary.biases()
        parts = {
            "E": rng.normal(0, 0.1, (classes * CLASS_WORDS, 2 * STATE)),  # what an input word adds to gate and candidate
            "U": rng.normal(0, 0.2, (STATE, 2 * STATE)),
            "b": np.concatenate([np.full(STATE, 0.5), np.zeros(STATE)]),
            "C": np.concatenate([np.zeros((STATE, classes)), c[None]]),  # the last row meets a state of one
            "V": np.concatenate([np.zeros((self.own, STATE, CLASS_WORDS)), v[: self.own, None]], 1),
        }
        self.shapes = {k: x.shape for k, x in parts.items()}
        self.flat = np.concatenate([x.ravel() for x in parts.values()]).astype(np.float32)

    @property
    def flat(self) -> np.ndarray:
        return self._flat

    @flat.setter
    def flat(self, flat: np.ndarray) -> None:
        self._flat = flat
        self.p = self.views(flat)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[k] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def load(self, flat: np.ndarray) -> Model:
        self.flat = flat.astype(np.float32)
        return self

    def run(self, words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(states before each word, gates, candidates, last states) for (window, batch) inputs from the states ``h``.

        The end token as an input begins a document: the state before it is zero. The gate's logistic
        curve is a hyperbolic tangent too, so both are found together.
        """
        steps, n = words.shape
        x = self.p["E"][words]
        x += self.p["b"]
        before, gates = np.empty((steps, n, STATE), x.dtype), np.empty((steps, n, STATE), x.dtype)
        keep = (words != self.start).astype(x.dtype)[:, :, None]
        U = self.p["U"]
        for t in range(steps):
            hb = np.multiply(h, keep[t], out=before[t])
            a = x[t]
            a += hb @ U
            np.tanh(a, out=a)
            z, g = gates[t], a[:, STATE:]
            np.multiply(a[:, :STATE], 0.5, out=z)
            z += 0.5
            h = hb - g
            h *= z
            h += g
        return before, gates, x[:, :, STATE:], h

    def loss_and_gradient(self, words: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Backpropagation through one (batch, window): ``targets`` follow the states reached after ``words``."""
        loss, flat, last = self.gradient(words.T, targets.T, mask.T, h)
        return loss, self.views(flat), last

    def gradient(self, words: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The same for (window, batch), as one flat array."""
        p, (steps, n) = self.p, words.shape
        before, gates, cands, last = self.run(words, h)
        after = np.ones((steps, n, STATE + 1), before.dtype)
        inner = after[:, :, :STATE]
        np.subtract(before, cands, out=inner)
        np.multiply(inner, gates, out=inner)
        np.add(inner, cands, out=inner)
        y, m = targets.ravel(), mask.ravel()
        total = max(1, int(m.sum()))
        kind = np.where(m, y // CLASS_WORDS, -1).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(-1, self.own + 1))
        live = order[cuts[1] :]
        flat = np.zeros_like(self.flat)
        grad = self.views(flat)
        Hl, kl, pl = after.reshape(-1, STATE + 1)[live], kind[live], (y % CLASS_WORDS)[live]
        at = np.arange(len(live))
        s, loss = softmax(Hl, p["C"]), 0.0
        loss -= np.log(s[at, kl] + 1e-9).sum()
        s[at, kl] -= 1
        grad["C"][...] = Hl.T @ s
        dHl = s @ p["C"].T
        for k in range(self.own):
            a, b = cuts[k + 1] - cuts[1], cuts[k + 2] - cuts[1]
            if a == b:
                continue
            own, place = Hl[a:b], pl[a:b]
            w = softmax(own, p["V"][k])
            loss -= np.log(w[at[: b - a], place] + 1e-9).sum()
            w[at[: b - a], place] -= 1
            grad["V"][k] = own.T @ w
            dHl[a:b] += w @ p["V"][k].T
        flat /= total
        dHl /= total
        dH = np.zeros((steps * n, STATE), before.dtype)
        dH[live] = dHl[:, :STATE]
        dH = dH.reshape(steps, n, STATE)
        keep = (words != self.start).astype(before.dtype)[:, :, None]
        to_gate = 2 * (before - cands) * gates * (1 - gates)
        to_cand = (1 - gates) * (1 - cands * cands)
        back = np.zeros((n, STATE), dH.dtype)
        dx = np.empty((steps, n, 2 * STATE), dH.dtype)
        Ut = np.ascontiguousarray(p["U"].T)
        for t in range(steps - 1, -1, -1):
            d = dH[t]
            d += back
            da = dx[t]
            np.multiply(d, to_gate[t], out=da[:, :STATE])
            np.multiply(d, to_cand[t], out=da[:, STATE:])
            d *= gates[t]
            d += da @ Ut
            back = d * keep[t]
        dx = dx.reshape(-1, 2 * STATE)
        grad["U"][...] = before.reshape(-1, STATE).T @ dx
        grad["b"][...] = dx.sum(0)
        place = words.reshape(-1, 1).astype(np.int64) * (2 * STATE) + np.arange(2 * STATE)
        grad["E"][...] = np.bincount(place.ravel(), weights=dx.ravel(), minlength=p["E"].size).reshape(p["E"].shape)
        return float(loss), flat, last

    def log10(self, H: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 probabilities of target words (of words in the other classes: of their class) after the states ``H``."""
        kind = (target // CLASS_WORDS).astype(np.int16)
        place = target % CLASS_WORDS
        out = np.empty(len(kind), np.float64)
        H = np.concatenate([H, np.ones((len(H), 1), H.dtype)], 1)
        for a in range(0, len(H), STEP):
            s = softmax(H[a : a + STEP], self.p["C"])
            out[a : a + STEP] = s[np.arange(len(s)), kind[a : a + STEP]]
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(self.own + 1))
        for k in range(self.own):
            for a in range(cuts[k], cuts[k + 1], STEP):
                own = order[a : min(a + STEP, cuts[k + 1])]
                w = softmax(H[own], self.p["V"][k])
                out[own] *= w[np.arange(len(own)), place[own]]
        return np.log10(np.maximum(out, 1e-300))

    def documents(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each document: all side by side, window by window, the state carried to each one's end."""
        lengths = np.diff(starts)
        order = np.argsort(-lengths, kind="stable")
        total = np.zeros(len(lengths))
        h = np.zeros((len(lengths), STATE), np.float32)
        last = np.full(len(lengths), self.start, ids.dtype)
        at = 0
        while len(order) and at < lengths[order[0]]:
            live = order[: int(np.searchsorted(-lengths[order], -at))]
            span = np.arange(at, min(at + 2 * WINDOW, int(lengths[order[0]])))[:, None]
            real = span < lengths[live]
            targets = ids[np.where(real, starts[live] + span, 0)]
            inputs = np.concatenate([last[live][None], targets[:-1]])
            before, gates, cands, end = self.run(inputs, h[: len(live)])
            h[: len(live)] = end
            last[live] = targets[-1]
            after = np.concatenate([before[1:], end[None]])[real]
            found = self.log10(after, targets[real])
            total += np.bincount(np.broadcast_to(live, real.shape)[real], weights=found, minlength=len(total))
            at += len(span)
        return total

    def train(self, ids: np.ndarray, adam: Adam) -> int:
        """One pass over documents that stand end to end, each with its end token, in BATCH streams side by side; the tokens learned from."""
        n = min(BATCH, len(ids))
        steps = -(-len(ids) // max(1, n))
        stream = np.full(n * steps, self.start, ids.dtype)
        stream[: len(ids)] = ids
        real = np.arange(n * steps) < len(ids)
        stream, real = stream.reshape(n, steps).T, real.reshape(n, steps).T
        before = np.concatenate([[self.start], stream[-1, :-1]]) if n else np.zeros(0, ids.dtype)
        inputs = np.concatenate([before[None].astype(ids.dtype), stream[:-1]])
        h = np.zeros((n, STATE), np.float32)
        for at in range(0, steps, WINDOW):
            part = slice(at, min(at + WINDOW, steps))
            _, grad, h = self.gradient(inputs[part], stream[part].astype(np.int64), real[part], h)
            adam.step(self.flat, grad)
        return int(real.sum())


class Adam:
    def __init__(self, flat: np.ndarray) -> None:
        self.m, self.v, self.t, self.room = np.zeros_like(flat), np.zeros_like(flat), 0, np.empty_like(flat)

    def step(self, flat: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        norm = float(np.sqrt(np.dot(grad, grad)))
        grad *= min(1.0, 1.0 / (norm + 1e-9))
        self.m *= 0.9
        self.m += np.multiply(grad, 0.1, out=self.room)
        self.v *= 0.99
        grad *= grad
        self.v += np.multiply(grad, 0.01, out=self.room)
        np.sqrt(self.v, out=self.room)
        self.room *= float(1 / np.sqrt(1 - 0.99**self.t))
        self.room += 1e-6
        np.divide(self.m, self.room, out=self.room)
        self.room *= RATE / (1 - 0.9**self.t)
        flat -= self.room


def average(rows: DataFrame) -> tuple[np.ndarray | None, int]:
    """The mean of all tasks' parameters by tokens, summed in SHARDS partial sums; only those reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for b in batches:
            for n, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64) * n
                total, tokens = part if total is None else total + part, tokens + n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], ["tokens", "flat"])

    parts = rows.repartition(SHARDS, "task").select("tokens", "flat").mapInArrow(add, "tokens bigint, flat binary").collect()
    tokens = sum(r.tokens for r in parts)
    return (sum(np.frombuffer(r.flat, np.float32).astype(np.float64) * (r.tokens / tokens) for r in parts) if tokens else None), tokens


CODED = "doc_id bigint, held_out boolean, key bigint, n_tokens bigint, n_head bigint, base double, share double, ids binary, tail array<struct<word:string,times:int>>"


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, first number by row with the total at the end) of a binary column of 16-bit numbers."""
    ids = [np.frombuffer(x.as_buffer(), "<u2") for x in column]
    return np.concatenate([np.zeros(0, "<u2"), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])


def coded(slim: DataFrame, shared, whole: float) -> DataFrame:
    """(doc_id, text, held_out, key) as CODED: each whole text in model numbers, and the words outside the head that it has.

    ``base`` and ``share`` sum the base model's and the classes' shares over the words of the head.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, kind = shared.value, pa.struct([("word", pa.string()), ("times", pa.int32())])
        for b in batches:
            for first, texts in groups(b.column(1)):
                ids, count, starts, (words, text, number) = vocabulary.encode(texts)
                add = lambda x, at=starts: np.add.reduceat(x, at[:-1])
                known = count > 0
                base = np.zeros(len(count))
                base[known] = np.log10((count[known] + 0.5) / whole)
                pair, times = np.unique(text * np.int64(len(words) + 1) + number, return_counts=True)
                cut = np.searchsorted(pair // (len(words) + 1), np.arange(len(texts) + 1))
                tail = pa.StructArray.from_arrays([words.take(pa.array(pair % (len(words) + 1))).cast(pa.string()), pa.array(times.astype(np.int32))], fields=list(kind))
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((2 * starts).astype(np.int64)), pa.py_buffer(ids.astype("<u2").tobytes())])
                own = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), own.column(3), pa.array(np.diff(starts)), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(vocabulary.shares(ids.astype(np.int64), count))), raw.cast(pa.binary()), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), tail)],
                    ["doc_id", "held_out", "key", "n_tokens", "n_head", "base", "share", "ids", "tail"],
                )

    return slim.select("doc_id", "text", "held_out", "key").mapInArrow(code, CODED)


def train(coded_texts: DataFrame, shared, vocabulary: Vocabulary, tokens: int) -> Model:
    """Train on CODED rows: in each round, every shard on its own documents of this round, from the last round's mean; no document is left out."""
    model, shards = Model(vocabulary), max(1, -(-tokens // SHARD_TOKENS))
    dealt = coded_texts.select("ids", "key", F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)).cast("int").alias("task"), F.pmod(F.xxhash64("key", F.lit("round")), F.lit(ROUNDS)).alias("round"))
    for k in range(ROUNDS):
        flat = model.flat

        def learn(batches: Iterator[pa.RecordBatch], flat: np.ndarray = flat) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            now = None

            def close() -> pa.RecordBatch:
                own = Model(shared.value).load(flat)
                seen = own.train(np.concatenate(held), Adam(own.flat))
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([seen], pa.int64()), pa.array([own.flat.tobytes()], pa.binary())], ["task", "tokens", "flat"])

            for b in batches:  # shard after shard
                for ids, task in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    if held and task != now:
                        yield close()
                    now = task
                    held.append(np.frombuffer(ids.as_buffer(), "<u2"))
            if held:
                yield close()

        own = dealt.where(F.col("round") == k).select("ids", "task", "key")
        share = own.repartitionById(shards, "task").sortWithinPartitions("task", "key").select("ids", "task")
        mean, _ = average(share.mapInArrow(learn, "task int, tokens bigint, flat binary"))
        if mean is not None:
            model.load(mean)
    return model


def fit(training: DataFrame, vocabulary: Vocabulary) -> Model:
    """Code and train on (doc_id, text)."""
    shared = training.sparkSession.sparkContext.broadcast(vocabulary)
    slim = training.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(False).alias("held_out"), F.xxhash64("doc_id", "text").alias("key"))
    texts = written(coded(slim, shared, 1.0))
    return train(texts, shared, vocabulary, texts.agg(F.sum("n_tokens")).first()[0] or 0)


def score_documents(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score, both log10 probabilities of the whole text.

    A null or empty text is its end token alone. A null doc_id is never held out. Rows that share a
    doc_id are scored one by one. With no training text, every token is one never met.
    """
    key = F.xxhash64(F.col(doc_id), F.col(text))
    held_out = F.coalesce(fold(F.col(doc_id)) == HELD_OUT, F.lit(False))
    slim = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"), key.alias("key"))
    training = slim.where("NOT held_out")
    counts = cut(word_counts(training.select("text")).where("n > 0"))
    sums = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    tokens, distinct = sums.tokens or 0, sums.words or 0
    top, least = top_rows(counts, "n", HEAD)
    head = sorted(((r.word, r.n) for r in top.select("word", "n").collect()), key=lambda r: (-r[1], r[0]))
    outside = counts.where(F.col("n") < least)
    beyond = {r.kind: (r.words, r.tokens) for r in outside.groupBy("kind").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect()}
    vocabulary = Vocabulary(head, beyond)
    whole = float(tokens + 0.5 * (distinct + 1))
    context = documents.sparkSession.sparkContext
    texts = written(coded(slim, context.broadcast(vocabulary), whole))
    model = train(texts.where("NOT held_out"), context.broadcast(vocabulary), vocabulary, tokens)
    sent = context.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, SIDE):
                own = b.slice(first, SIDE)
                ids, starts = packed(own.column(6))
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(6)), pa.array(sent.value.documents(ids, starts) + own.column(7).to_numpy())], ["doc_id", "held_out", "key", "n_tokens", "n_head", "base_head", "score_head"])

    scored = texts.select("doc_id", "held_out", "key", "n_tokens", "n_head", "base", "ids", "share").mapInArrow(score, "doc_id bigint, held_out boolean, key bigint, n_tokens bigint, n_head bigint, base_head double, score_head double")
    tail = texts.select("key", F.explode("tail").alias("t")).select("key", "t.word", "t.times")
    found = tail.join(outside.select(F.col("word").alias("_word"), "n"), tail["word"] == F.col("_word"), "left")
    n = F.coalesce("n", F.lit(0))
    mass = F.create_map(*[F.lit(x) for k in range(KINDS) for x in (k, float(vocabulary.mass[vocabulary.own_classes + k]))])
    greatest = F.array_max(F.transform(F.split("word", ""), lambda c: F.when(c != "", F.ascii(c)).otherwise(0)))
    kind = F.when(greatest < 128, 0).otherwise(1 + greatest % (KINDS - 1))
    sums = found.groupBy("key").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((n + 0.5) / F.lit(whole))).alias("base"),
        F.sum(F.col("times") * F.log10((n + 0.5) / mass[kind])).alias("share"),
    ).withColumnRenamed("key", "_key")
    rows = F.count(F.lit(1)).over(W.partitionBy("key"))
    out = scored.withColumn("_rows", rows).join(sums, F.col("key") == F.col("_key"), "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("_rows")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + part("known").cast("long")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_head") + part("base")).alias("base_score"),
        (F.col("score_head") + part("share")).alias("score"),
    )
