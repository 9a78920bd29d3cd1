"""Log probabilities of texts under a small causal self-attention model, and under smoothed word counts.

The attention model reads subword ids of a public vocabulary (of each lower-cased word in turn, then an end).  One layer of
masked self-attention over a window predicts the class of the next piece: frequent pieces are classes of their own,
the others share classes in which a piece has its smoothed frequency.  Pieces are counted over all learning documents,
and the model is trained by numpy on all of them: the documents are cut into rounds; in a round every task trains on its
own documents from the round's common parameters, and the tasks' changes are averaged in a tree of arrays of bounded
size, embeddings by how often a task met the piece.  Few documents are read several times over.

To score a text, windows overlap by half: the first one scores all its pieces, each later one those
of its second half, so every piece is scored once and with at least half a window before it.  Windows of many texts are
scored together.  The score of a text is this model's log probability; the smoothed word counts give the base score only.

Texts are cut into words and pieces once, for counting, training and scoring alike.  The counts of words cover all
learning documents.  Tasks number the words of a block of documents and give texts as word numbers; the blocks' words,
far fewer than the texts', are summed in one shuffle and return to their block.

A null or empty text is its end alone.  Rows may repeat; a null id is neither held out nor learnt from.  An empty table
gives no rows.  Without learning documents the model is uniform over classes.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwarden.llm.common import Generations, batch, forget, group_starts, kept, merged
from postwarden.session import materialise

WINDOW, WIDTH, HEADS_OF_THEIR_OWN, SHARED = 32, 24, 224, 32
BEGIN, END = 1, 2
#: Words in each of the two generations whose pieces a worker remembers.
REMEMBER = 250_000
BLOCK_TOKENS = 3_000_000
#: Windows in an Adam step, and pieces that a task trains on.
STEP_ROWS, TASK_PIECES = 64, 4_000_000
#: Sixteenths of the documents, by their number in a task, after which the tasks' parameters are averaged.
ROUNDS = ((0, 1), (1, 4), (4, 16))
NEGATIVE = np.float32(-1e9)
#: Places whose class weights are in use at once, which is what a core's cache holds, and those of one matrix product.
CLASS_ROWS, PRODUCT_ROWS = 512, 128
LOG2E = np.float32(np.log2(np.e))


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.vocab_size()
        self.memory = Generations(2 * REMEMBER)

    def learn(self, wanted) -> None:
        new = self.memory.missing(wanted)
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            made = self.library.encode([w.decode() for w in some], num_threads=1)
            flat = np.array([i for ids in made for i in ids], np.int32).tobytes()
            end = 0
            for word, ids in zip(some, made):
                start, end = end, end + 4 * len(ids)
                self.memory.young[word] = flat[start:end]

    def of(self, words: list[bytes]) -> list[bytes]:
        return list(map(self.memory.young.__getitem__, words))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(self.of(words)), np.int32)


def pieces(path: str) -> Pieces:
    return kept(Pieces, path)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def cut(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of texts as ``words_of`` gives them: how many each text has, the different ones, and which of them each is."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.cast(pa.string()).fill_null("")))
    size, words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
    if empty.any():
        size -= np.bincount(np.repeat(np.arange(len(size)), size)[empty], minlength=len(size))
        words = words.filter(pa.array(~empty))
    coded = words.dictionary_encode()
    return size, coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()


def spread(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The parts of ``flat``, which are so long, in the order of ``index``."""
    length = size[index]
    shift = (np.cumsum(size) - size)[index] - (np.cumsum(length) - length)
    return flat[np.repeat(shift, length) + np.arange(int(length.sum()))]


def binaries(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """Consecutive parts of ``flat`` as one value each."""
    ends = np.append(0, np.cumsum(size)) * flat.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]
    ).cast(pa.binary())


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then the next ones and so on: the zeros among the high ones take no room in a file."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def weights(logits, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Powers of 2 of the ``logits()`` of places ``seen``, and their sums by row.

    Powers are taken as they are, which is the fast way for a model's usual sizes; should one
    overflow or a sum vanish, the largest is subtracted first.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        z = logits()
        np.exp2(z, out=z)
        if seen is not None:
            z *= seen
        total = z @ np.ones((z.shape[-1], 1), z.dtype)
        if not (np.isfinite(total).all() and (total > 0).all()):
            z = logits()
            if seen is not None:
                z = np.where(seen > 0, z, z.dtype.type(-np.inf))
            z -= z.max(axis=-1, keepdims=True)
            np.exp2(z, out=z)
            total = z.sum(axis=-1, keepdims=True)
    return z, total


def stacked(rows: np.ndarray) -> np.ndarray:
    """Rows as a stack of small matrices, whose products are faster than those of a long one."""
    return rows.reshape(-1, len(rows) if len(rows) % PRODUCT_ROWS else PRODUCT_ROWS, rows.shape[-1])


def turned(x: np.ndarray) -> np.ndarray:
    """Each matrix of a stack transposed in memory."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def adam(value, first, second, of, grad: np.ndarray, step: int, speed: float) -> None:
    """A step of the rows ``of`` a parameter."""
    one, two = first[of] * 0.9, second[of] * 0.99
    one += 0.1 * grad
    grad = grad * grad
    grad *= 0.01
    two += grad
    first[of], second[of] = one, two
    two = two / (1 - 0.99**step)
    np.sqrt(two, out=two)
    two += 1e-6
    one = one * (speed / (1 - 0.9**step))
    one /= two
    value[of] -= one


class AttentionLm:
    """Parameters, training and scoring."""

    def __init__(self, size: int, counts: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        order = np.argsort(-counts, kind="stable")
        own = min(HEADS_OF_THEIR_OWN, size)
        self.group = np.zeros(size, np.int32)
        self.group[order[:own]] = np.arange(own)
        # The others share classes of about equal mass, so that a class holds pieces of like frequency.
        mass = np.cumsum(counts[order[own:]] + 0.1)
        self.group[order[own:]] = own + np.minimum(SHARED - 1, (mass / max(mass[-1:].sum(), 1e-9) * SHARED).astype(np.int32))
        smooth = counts + 0.1
        self.inside = np.log(smooth / np.bincount(self.group, smooth)[self.group]).astype(np.float32)
        classes = int(self.group.max()) + 1

        def random(*shape):
            return (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)

        self.p = {
            "E": (rng.standard_normal((size, WIDTH)) * 0.1).astype(np.float32), "P": random(WINDOW, WIDTH) * 0.1,
            "Q": random(WIDTH, WIDTH), "K": random(WIDTH, WIDTH), "V": random(WIDTH, WIDTH), "O": random(WIDTH, WIDTH),
            "U": random(WIDTH, classes) * 0.1, "b": np.log(np.bincount(self.group, smooth) / smooth.sum()).astype(np.float32),
        }

    def train(self, streams, planned: float, done: float = 0.0, upto: float = 1.0, rate: float = 0.01, seed: int = 2) -> np.ndarray:
        """Adam steps on every piece of the streams of ids, about ``planned`` pieces; how often each piece was read.

        The rate falls with the share of the whole training, here from ``done`` to ``upto``.
        """
        rng = np.random.default_rng(seed)
        # All parameters but the embeddings lie in one array, so that a step is a few operations.
        names = [k for k in self.p if k != "E"]
        dense, table = np.concatenate([self.p[k].ravel() for k in names]), self.p["E"]
        ends = np.cumsum([self.p[k].size for k in names])
        self.p |= {k: part.reshape(self.p[k].shape) for k, part in zip(names, np.split(dense, ends))}
        first, second = ([np.zeros_like(v) for v in (dense, table)] for _ in range(2))
        mask = np.triu(np.full((WINDOW, WINDOW), NEGATIVE), 1)
        met, read, step = np.zeros(len(table), np.int64), 0, 0
        for windows in training_windows(streams, rng):
            for at in range(0, len(windows), STEP_ROWS):
                some = windows[at : at + STEP_ROWS]
                ids = some[:, :-1]
                step, read = step + 1, read + ids.size
                order = np.argsort(ids, axis=None, kind="stable")
                sorted_ids = ids.ravel()[order]
                starts = group_starts(sorted_ids)
                rows, often = sorted_ids[starts[:-1]], np.diff(starts)
                own = np.empty(ids.size, np.uint16 if ids.size <= 1 << 16 else np.int64)
                own[order] = np.repeat(np.arange(len(rows)), often)
                met[rows] += often
                g = self._gradients(own.reshape(ids.shape), self.group[some[:, 1:]], mask, table[rows])
                part = done + (upto - done) * min(1.0, read / max(planned, 1))
                speed = rate * min(1.0, step / 50) * (1 - 0.9 * part)
                adam(dense, first[0], second[0], slice(None), np.concatenate([g[k].ravel() for k in names]), step, speed)
                # Of the embeddings only the rows of the step's pieces change.
                adam(table, first[1], second[1], rows, g["E"], step, speed)
        return met

    def change(self, start: dict[str, np.ndarray], met: np.ndarray) -> np.ndarray:
        """The change since ``start`` times its weight, and the weights, as one array of fixed size."""
        weight = np.float32(met.sum())
        dense = [((self.p[k] - start[k]) * weight).ravel() for k in start if k != "E"]
        table = (self.p["E"] - start["E"]) * met[:, None].astype(np.float32)
        return np.concatenate([[weight], *dense, met, table.ravel()]).astype(np.float32)

    def move(self, total: np.ndarray) -> None:
        """Applies the sum of tasks' changes as their weighted mean."""
        at = 1
        for k, v in self.p.items():
            if k != "E":
                v += total[at : at + v.size].reshape(v.shape) / max(total[0], 1)
                at += v.size
        size = len(self.p["E"])
        met, table = total[at : at + size], total[at + size :].reshape(size, -1)
        self.p["E"] += table / np.maximum(met, 1)[:, None]

    def _gradients(self, ids: np.ndarray, target: np.ndarray, mask: np.ndarray, table=None) -> dict[str, np.ndarray]:
        """``ids`` number the rows of ``table``, which stands for all embeddings or for those in use."""
        p, root = self.p, np.float32(1 / np.sqrt(WIDTH))
        table = p["E"] if table is None else table
        flat = lambda t: t.reshape(-1, t.shape[-1])
        sums = lambda a, b: (stacked(flat(a)).transpose(0, 2, 1) @ stacked(flat(b))).sum(axis=0)
        x = table.take(ids, axis=0) + p["P"]
        project = np.concatenate([p["Q"] * (root * LOG2E), p["K"], p["V"]], axis=1)
        q, k, v = np.split((flat(x) @ project).reshape(*ids.shape, -1), 3, axis=-1)
        turned_k = turned(k)
        a, total = weights(lambda: q @ turned_k, (mask == 0).astype(x.dtype))
        share = 1 / total
        o = (a @ v) * share
        h = flat(x + o @ p["O"])
        dh, to_classes = self._class_gradients(h, target.ravel())
        dh = dh.reshape(x.shape)
        do = (flat(dh) @ p["O"].T).reshape(x.shape)
        # The rows of a are not divided by their sums; what they are multiplied with is.
        ds = do @ turned(v)
        ds -= (do * o) @ np.ones((WIDTH, 1), x.dtype)
        ds *= a
        dy = np.concatenate([
            (ds @ k) * (share * root), ds.transpose(0, 2, 1) @ (q * (share / LOG2E)), a.transpose(0, 2, 1) @ (do * share)
        ], axis=-1)
        dx = dh + (flat(dy) @ np.concatenate([p["Q"], p["K"], p["V"]], axis=1).T).reshape(x.shape)
        de = np.zeros_like(table)
        order = np.argsort(ids, axis=None, kind="stable")
        sorted_ids = ids.ravel()[order]
        starts = group_starts(sorted_ids)[:-1]
        de[sorted_ids[starts]] = np.add.reduceat(flat(dx).take(order, axis=0), starts)
        to_q, to_k, to_v = np.split(sums(x, dy), 3, axis=1)
        return {
            "E": de, "P": dx.sum(axis=0), "Q": to_q, "K": to_k, "V": to_v, "O": sums(o, dh),
            "U": to_classes[:-1], "b": to_classes[-1],
        }

    def _class_gradients(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the mean loss by ``h``, and by the class weights with their constants below."""
        h1 = np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)
        u1 = np.concatenate([self.p["U"], self.p["b"][None]])
        logits, back = u1 * LOG2E, np.ascontiguousarray(self.p["U"].T)
        dh, du = np.empty_like(h), np.zeros_like(u1)
        for at in range(0, len(h), CLASS_ROWS):
            some, t = stacked(h1[at : at + CLASS_ROWS]), target[at : at + CLASS_ROWS]
            z, total = weights(lambda some=some: some @ logits)
            z.reshape(-1, z.shape[-1])[np.arange(len(t)), t] -= total.ravel()
            share = 1 / (total * len(h))
            dh[at : at + len(t)] = ((z @ back) * share).reshape(len(t), -1)
            du += ((some * share).transpose(0, 2, 1) @ z).sum(axis=0)
        return dh, du

    def ready(self) -> AttentionLm:
        """Projects every piece and place once, so that scoring only looks them up."""
        p, root = self.p, np.float32(1 / np.sqrt(WIDTH))
        asks = np.concatenate([p["Q"] * (root * LOG2E), np.eye(WIDTH, dtype=np.float32)], axis=1)
        holds = np.concatenate([p["K"], p["V"] @ p["O"]], axis=1)
        self.asks, self.asks_place = p["E"] @ asks, p["P"] @ asks
        self.holds, self.holds_place = p["E"] @ holds, p["P"] @ holds
        self.logits, self.constants = p["U"] * LOG2E, p["b"] * LOG2E
        self.factors = np.exp(p["b"])
        return self

    def _log_probabilities(self, ids: np.ndarray, target: np.ndarray, start: int) -> np.ndarray:
        """Natural logs for the places from ``start`` on of each window."""
        x = self.asks.take(ids[:, start:], axis=0)
        x += self.asks_place[start:]
        y = self.holds.take(ids, axis=0)
        y += self.holds_place
        q, own, k, v = x[..., :WIDTH], x[..., WIDTH:], turned(y[..., :WIDTH]), y[..., WIDTH:]
        a, total = weights(lambda: q @ k, np.tri(WINDOW, dtype=np.float32)[start:])
        h = ((a @ v) / total + own).reshape(-1, WIDTH)
        t = target.ravel()
        logs = np.empty(len(t), np.float32)
        for at in range(0, len(h), CLASS_ROWS):
            some, classes = stacked(h[at : at + CLASS_ROWS]), self.group[t[at : at + CLASS_ROWS]]
            logs[at : at + len(classes)] = self._class_logs(some, classes)
        return logs / LOG2E + self.inside[t]

    def _class_logs(self, h: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Logs to base 2 of each place's class."""
        z = h @ self.logits
        rows = z.reshape(-1, z.shape[-1])
        chosen = rows[np.arange(len(rows)), classes] + self.constants[classes]
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp2(z, out=z)
            total = rows @ self.factors
        if not (np.isfinite(total).all() and (total > 0).all()):
            z = (h @ self.logits + self.constants).reshape(rows.shape)
            most = z.max(axis=1)
            return chosen - most - np.log2(np.exp2(z - most[:, None]).sum(axis=1))
        return chosen - np.log2(total)

    def score(self, many: list[np.ndarray], rows: int = 96) -> np.ndarray:
        """Log probability of each sequence of ids and its end."""
        half = WINDOW // 2
        size = np.array([len(x) + 1 for x in many], np.int64)
        begin = np.append(0, np.cumsum(size))
        targets = np.full(begin[-1] + WINDOW, END, np.int32)
        inputs = np.full(begin[-1] + WINDOW, BEGIN, np.int32)
        for x, b in zip(many, begin):
            targets[b : b + len(x)] = x
            inputs[b + 1 : b + 1 + len(x)] = x
        total = np.zeros(len(many))
        later = np.maximum(0, -(-(size - WINDOW) // half))
        owner = np.repeat(np.arange(len(many)), later)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(later) - later, later)
        jobs = ((np.arange(len(many)), begin[:-1], 0), (owner, begin[owner] + (turn + 1) * half, half))
        for who, start, skip in jobs:
            for at in range(0, len(who), rows):
                w, s = who[at : at + rows], start[at : at + rows]
                place = s[:, None] + np.arange(WINDOW)
                own = place[:, skip:]
                logs = self._log_probabilities(inputs[place], targets[own], skip)
                logs = np.where(own < begin[w + 1][:, None], logs.reshape(own.shape), 0)
                total += np.bincount(w, logs.sum(axis=1, dtype=np.float64), len(many))
        return total

    def text_scores(self, words: list[list[bytes]], own: Pieces) -> np.ndarray:
        """log10 probability of each text: the pieces of its words and its end."""
        sequences = []
        for some in words:
            parts = []
            for at in range(0, len(some), REMEMBER // 2):
                few = some[at : at + REMEMBER // 2]
                own.learn(set(few))
                parts.append(own(few))
            sequences.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        return self.score(sequences) / np.log(10)


def training_windows(streams, rng, chunk: int = 2048):
    """Windows and the piece after each, in which every piece but the first of all is the next one once; shuffled in chunks."""
    held, size, any_yet = [], 0, False

    def cut(flat: np.ndarray, n: int) -> np.ndarray:
        at = np.arange(n)[:, None] * WINDOW + np.arange(WINDOW + 1)
        return flat[at][rng.permutation(n)]

    for x in streams:
        held.append(x)
        size += len(x)
        if size > chunk * WINDOW:
            flat = np.concatenate(held)
            n = (len(flat) - 1) // WINDOW
            yield cut(flat, n)
            # The last window stays, so that the end of all can be filled with what came before.
            keep, any_yet = flat[(n - 1) * WINDOW :], True
            held, size = [keep[WINDOW:]], len(keep) - WINDOW
            before = keep[:WINDOW]
    flat = np.concatenate(held) if held else np.zeros(0, np.int32)
    n, left = (len(flat) - 1) // WINDOW, (len(flat) - 1) % WINDOW
    if len(flat) > 1:
        if n:
            yield cut(flat, n)
        if left:
            joined = np.concatenate([before, flat]) if any_yet else flat
            # Less than a window in all is read round and round.
            yield (joined[-WINDOW - 1 :] if len(joined) > WINDOW else np.resize(joined, WINDOW + 1))[None]


NUMBERED = pa.schema([
    ("block", pa.int64()), ("id", pa.int64()), ("held", pa.bool_()), ("train", pa.bool_()), ("slice", pa.int32()),
    ("pieces", pa.binary()), ("words", pa.binary()), ("k", pa.int32()), ("key", pa.binary()), ("n", pa.int64()),
    ("part", pa.int64()), ("data", pa.binary()),
])


def rows_of(**columns) -> pa.RecordBatch:
    """Rows of ``NUMBERED``; the other columns are null."""
    size = len(next(iter(columns.values())))
    return batch(NUMBERED, *[columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in NUMBERED])


def numbered(docs: DataFrame, path: str, size: int) -> DataFrame:
    """The texts of ``docs`` (id, text, train, held) as numbers, in rows of three kinds.

    Rows without key and part are texts: their pieces between ``BEGIN`` and ``END``, the numbers of their words in their
    block, and which sixteenth of its task's learning documents one is.  Rows with a key are the words of a block and how
    often its learning documents have each; rows with a part are a task's counts of pieces.
    """
    narrow = np.uint16 if size <= 1 << 16 else np.int32

    def run(batches):
        own, task = pieces(path), TaskContext.get().partitionId()
        turn, tokens, learnt, counts = 0, 0, 0, np.zeros(size, np.int64)

        def fresh():
            """A block's words by their numbers, how often learning documents have each, and their pieces and how many each has."""
            return {}, np.zeros(0, np.int64), np.zeros(0, narrow), np.zeros(0, np.int64)

        number, seen, flat, sizes = fresh()

        def close():
            nonlocal counts
            counts += np.bincount(flat, np.repeat(seen, sizes), minlength=size).astype(np.int64)
            keys = list(map(word_key, number))
            for at in range(0, len(keys), 50_000):
                some = keys[at : at + 50_000]
                yield rows_of(
                    block=[(task << 24) + turn] * len(some), k=np.arange(at, at + len(some), dtype=np.int32), key=some,
                    n=seen[at : at + len(some)],
                )

        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                text, train = some.column(1), np.array(some.column(2).to_pylist(), bool)
                lengths, words, index = cut(text)
                new = [w for w in words if w not in number]
                own.learn(new)
                parts = own.of(new)
                number.update(zip(new, range(len(number), len(number) + len(new))))
                flat = np.concatenate([flat, np.frombuffer(b"".join(parts), np.int32).astype(narrow)])
                sizes = np.concatenate([sizes, np.fromiter(map(len, parts), np.int64, len(parts)) // 4])
                numbers = np.fromiter(map(number.__getitem__, words), np.int32, len(words))[index]
                often = np.bincount(numbers[np.repeat(train, lengths)], minlength=len(number))
                often[: len(seen)] += seen
                seen = often
                # Each text's pieces, with a place before and one behind.
                ends = np.append(0, np.cumsum(lengths))
                many = np.diff(np.append(0, np.cumsum(sizes[numbers]))[ends])
                last = np.cumsum(many + 2) - 1
                inner = np.ones(int((many + 2).sum()), bool)
                inner[last], inner[last - many - 1] = False, False
                ids = np.empty(len(inner), narrow)
                ids[inner], ids[last], ids[last - many - 1] = spread(flat, sizes, numbers), END, BEGIN
                # A learning document without a text counts among the ends of words only.
                learns = train & np.array(text.is_valid())
                counts[END] += learns.sum()
                turns = learnt + np.cumsum(learns) - 1
                learnt += int(learns.sum())
                yield rows_of(
                    block=[(task << 24) + turn] * some.num_rows, id=some.column(0), held=some.column(3), train=some.column(2),
                    slice=pa.array((turns % 16).astype(np.int32), mask=~learns), pieces=binaries(ids, many + 2),
                    words=[planes(numbers[x:y]) for x, y in zip(ends[:-1], ends[1:])],
                )
                tokens += len(index)
                if tokens >= BLOCK_TOKENS:
                    yield from close()
                    turn, tokens = turn + 1, 0
                    number, seen, flat, sizes = fresh()
        yield from close()
        if learnt:
            yield rows_of(part=[task], data=[counts.tobytes()])

    kind = (
        "block bigint, id bigint, held boolean, train boolean, slice int, pieces binary, words binary, k int, key binary, "
        "n bigint, part bigint, data binary"
    )
    return materialise(docs.select("id", "text", "train", "held").mapInArrow(run, kind), "numbered")


def fitted(train: DataFrame, path: str, text_col: str, steps: int, made: DataFrame | None = None) -> AttentionLm:
    """A model of all documents, with so many readings of them that ``steps`` steps are made at least.

    ``made`` are the documents as ``numbered`` gives them, perhaps among others that aren't learnt from.
    """
    size = pieces(path).size
    if made is None:
        made = numbered(train.select(
            F.lit(None).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.lit(True).alias("train"), F.lit(False).alias("held")
        ), path, size)
    counts = merged(made.filter("part is not null").select("part", "data"), "sum", "int64")
    narrow = np.uint16 if size <= 1 << 16 else np.int32
    if counts is None:
        return AttentionLm(size, np.zeros(size))
    model, total = AttentionLm(size, counts.astype(float)), int(counts.sum())
    tasks = -(-total // TASK_PIECES)
    passes = max(1, -(-steps * STEP_ROWS * WINDOW // total))
    for low, high in ROUNDS:
        shared = train.sparkSession.sparkContext.broadcast(model)
        planned = total / tasks * passes * (high - low) / 16

        def learn(batches, low=low, high=high, shared=shared, planned=planned):
            forget()
            held = [x for b in batches for x in b.column(0).to_pylist()]
            if held:
                start = {k: v.copy() for k, v in shared.value.p.items()}
                lm = pickle.loads(pickle.dumps(shared.value))
                part = TaskContext.get().partitionId()
                streams = (np.frombuffer(x, narrow) for _ in range(passes) for x in held)
                met = lm.train(streams, planned, low / 16, high / 16, seed=part + 2)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "data": [lm.change(start, met).tobytes()]})

        rows = made.filter(f"slice >= {low} and slice < {high}").select("pieces").coalesce(tasks)
        changes = materialise(rows.mapInArrow(learn, "part bigint, data binary"), "changes")
        change = merged(changes, "sum", "float32", 4)
        if change is not None:
            model.move(change)
    return model


def word_key(word: bytes) -> bytes:
    return word if len(word) <= 16 else b"\xff" + hashlib.blake2b(word, digest_size=16).digest()


def scored(
    df: DataFrame, held: Column, vocabulary: str, id_col: str = "doc_id",
    text_col: str = "text", steps: int = 2000,
) -> DataFrame:
    """Token counts and both scores of every row; rows where ``held`` isn't false aren't learnt from."""
    spark = df.sparkSession
    docs = df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(~held, F.lit(False)).alias("train"), F.coalesce(held, F.lit(False)).alias("held"),
    )
    size = pieces(vocabulary).size
    made = numbered(docs, vocabulary, size)
    model = spark.sparkContext.broadcast(fitted(docs, vocabulary, "text", steps, made))
    narrow = np.uint16 if size <= 1 << 16 else np.int32
    schema = pa.schema([
        ("block", pa.int64()), ("id", pa.int64()), ("held", pa.bool_()), ("score", pa.float64()), ("words", pa.binary()),
    ])

    def run(batches):
        forget()
        lm = model.value.ready()
        for b in batches:
            for at in range(0, b.num_rows, 128):
                some = b.slice(at, 128)
                many = [np.frombuffer(x, narrow)[1:-1] for x in some.column(3).to_pylist()]
                yield batch(schema, *some.columns[:3], lm.score(many) / np.log(10), some.column(4))

    same = Window.partitionBy("key")
    counted = materialise(made.filter("key is not null").select(
        "block", "k", F.sum("n").over(same).alias("c"), (F.min("block").over(same) == F.col("block")).alias("lead")
    ), "counts")
    totals = counted.filter("lead").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    rows = made.filter("key is null and part is null")
    ends = rows.agg(F.count_if("train")).first()[0]
    all_tokens, kinds = (totals["n"] or 0) + ends, totals["v"] + bool(ends)
    below = all_tokens + 0.5 * (kinds + 1)
    out = pa.schema([
        (id_col, pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def base(left: pa.Table, right: pa.Table) -> pa.Table:
        k, c = right.column("k").to_numpy(), right.column("c").to_numpy()
        count = np.zeros(int(k.max()) + 1 if len(k) else 0, np.int64)
        count[k] = c
        logs, known = np.log10((count + 0.5) / below), count > 0
        tokens, met, score = [], [], []
        for x in left.column("words"):
            n = from_planes(x.as_py())
            tokens.append(len(n) + 1)
            met.append(int(known[n].sum()) + bool(ends))
            score.append(float(logs[n].sum() + np.log10((ends + 0.5) / below)))
        return pa.Table.from_arrays([
            left.column("id"), left.column("held"), pa.array(tokens, pa.int64()), pa.array(met, pa.int64()),
            pa.array([all_tokens] * len(tokens), pa.int64()), pa.array(score, pa.float64()), left.column("score"),
        ], schema=out)

    scores = rows.select("block", "id", "held", "pieces", "words").mapInArrow(
        run, "block bigint, id bigint, held boolean, score double, words binary"
    )
    return scores.groupBy("block").cogroup(
        counted.select("block", "k", "c").groupBy("block")
    ).applyInArrow(
        base, f"{id_col} bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double",
    )
