"""Language identification by unigrams over pieces, summed over all segmentations.

The pieces are the tokens of a public byte-level vocabulary (every byte is one, so every text can be cut).  Each
language has a probability per piece, learnt by expectation-maximisation from the words of a bounded sample of
its documents.  A word's probability in a language is the sum over all ways to cut it, by a forward pass over the
bytes; a text's is the product over its words.  The prediction is the language with the largest product, and
the score its share of the sum over languages.

Texts are lower-cased; ASCII digits, punctuation and control characters only separate words.  Words are cut at
``MAX_WORD`` bytes.  A null text, or one without a letter, is ``und`` with score 0, and so is every text if
nothing could be learnt.  Ties go to the first language by name.  Null languages teach nothing.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwarden.llm.common import carried, forget, kept, place_of, result_type, take_sample, text_of, texts

UNKNOWN = "und"
MAX_PIECE, MAX_WORD = 10, 32
#: Words whose scores a worker remembers; the memory is emptied when full.
REMEMBER = 300_000
_APART = str.maketrans({i: " " for i in [*range(65), *range(91, 97), *range(123, 128)]})
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def words_of(text: str) -> list[bytes]:
    """Words with the space before them, as the vocabulary has them."""
    out = []
    for w in text.lower().translate(_APART).encode("utf-8", "replace").split():
        w = b" " + w
        if len(w) <= MAX_WORD:
            out.append(w)
        else:
            out += [w[i : i + MAX_WORD] for i in range(0, len(w), MAX_WORD)]
    return out


def letters():
    import regex

    return regex.compile(r"\p{L}").search


class Pieces:
    """The vocabulary's short pieces, and where they occur in words."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            tokens = [base64.b64decode(line.split()[0]) for line in f]
        self.tokens = sorted({t for t in tokens if len(t) <= MAX_PIECE} | {bytes([b]) for b in range(256)})
        power = np.ones(MAX_WORD + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, len(power)):
                power[i] = power[i - 1] * _BASE
        self.power = power
        hashes = np.zeros(len(self.tokens), np.uint64)
        for n in range(1, MAX_PIECE + 1):
            at = [i for i, t in enumerate(self.tokens) if len(t) == n]
            if at:
                rows = np.frombuffer(b"".join(self.tokens[i] for i in at), np.uint8).reshape(-1, n)
                hashes[at] = self._prefix(rows)[:, n]
        # Open addressing with room to spare: a piece lies within a few slots of its hash.
        self.slots = np.full((1 << 21) + 8, -1, np.int32)
        self.hashes = hashes
        self.reach = 1
        for i, s in enumerate(self._slot(hashes).tolist()):
            k = 0
            while self.slots[s + k] >= 0:
                k += 1
            self.slots[s + k] = i
            self.reach = max(self.reach, k + 1)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * _MULTIPLIER) >> np.uint64(43)).astype(np.int64)

    @staticmethod
    def _prefix(rows: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the first 0, 1, ... bytes of each row."""
        out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(rows.shape[1]):
                out[:, i + 1] = out[:, i] * _BASE + rows[:, i] + np.uint64(1)
        return out

    def edges(self, rows: np.ndarray):
        """For words of one length: (begin, end, piece per word or -1) for all spans that some word has as a piece."""
        length, prefix = rows.shape[1], self._prefix(rows)
        for end in range(1, length + 1):
            for begin in range(max(0, end - MAX_PIECE), end):
                with np.errstate(over="ignore"):
                    h = prefix[:, end] - prefix[:, begin] * self.power[end - begin]
                slot, piece = self._slot(h), np.full(len(h), -1, np.int64)
                for k in range(self.reach):
                    found = self.slots[slot + k]
                    hit = (found >= 0) & (self.hashes[found] == h)
                    piece[hit] = found[hit]
                if (piece >= 0).any():
                    yield begin, end, piece

    def forward(self, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Probability of each word (of one length) in each language.  table: piece by language, zeros in the last row."""
        alpha = np.zeros((rows.shape[1] + 1, len(rows), table.shape[1]))
        alpha[0] = 1
        for begin, end, piece in self.edges(rows):
            alpha[end] += alpha[begin] * table[piece]
        return alpha[-1]

    def expected(self, rows: np.ndarray, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in one language, summed over all ways to cut the weighted words."""
        p, edges = table[:, 0], list(self.edges(rows))
        n, length = rows.shape
        alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
        alpha[0] = beta[length] = 1
        for begin, end, piece in edges:
            alpha[end] += alpha[begin] * p[piece]
        for begin, end, piece in sorted(edges, key=lambda e: -e[0]):
            beta[begin] += beta[end] * p[piece]
        share = weight / np.maximum(alpha[length], 1e-300)
        total = np.zeros(len(p))
        for begin, end, piece in edges:
            total += np.bincount(piece, alpha[begin] * p[piece] * beta[end] * share, len(p)) if piece.min() >= 0 else \
                np.bincount(piece[piece >= 0], (alpha[begin] * p[piece] * beta[end] * share)[piece >= 0], len(p))
        return total


def by_length(words: list[bytes]):
    """Places and byte rows of the words of each length."""
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, n)


def learn(pieces: Pieces, counts: dict[bytes, float], rounds: int, floor: float) -> np.ndarray:
    """Piece probabilities of one language from its words' counts."""
    words = list(counts)
    weight = np.array([counts[w] for w in words], float)
    groups = list(by_length(words))
    p = np.append(np.full(len(pieces.tokens), 1 / len(pieces.tokens)), 0.0)
    for _ in range(rounds):
        total = sum(pieces.expected(rows, p[:, None], weight[at]) for at, rows in groups)
        total = total[:-1] + floor
        p = np.append(total / total.sum(), 0.0)
    return p


class Scorer:
    """Log probabilities of texts in each language, with a memory of words."""

    def __init__(self, pieces: Pieces, table: np.ndarray):
        self.pieces, self.table = pieces, table
        self.place: dict[bytes, int] = {}
        self.rows = np.zeros((REMEMBER, table.shape[1]))

    def texts(self, many: list[list[bytes]]) -> np.ndarray:
        out = np.zeros((len(many), self.table.shape[1]))
        for k, words in enumerate(many):
            for at in range(0, len(words), REMEMBER // 2):
                out[k] += self._part(words[at : at + REMEMBER // 2])
        return out

    def learn_words(self, wanted: set[bytes]) -> None:
        new = [w for w in wanted if w not in self.place]
        if len(self.place) + len(new) > REMEMBER:
            self.place.clear()
            new = list(wanted)
        start = len(self.place)
        for at, rows in by_length(new):
            for k in range(0, len(at), 20_000):
                p = self.pieces.forward(rows[k : k + 20_000], self.table)
                self.rows[start + at[k : k + 20_000]] = np.log(np.maximum(p, 1e-300))
        self.place.update(zip(new, range(start, start + len(new))))

    def _part(self, words: list[bytes]) -> np.ndarray:
        try:
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn_words(set(words))
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.rows[at].sum(axis=0)


def identified(
    df: DataFrame, train: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", rows_per_language: int = 400, rounds: int = 4, floor: float = 0.02,
    carry: bool = False,
) -> DataFrame:
    """Predicted language and score of every row of ``df``.

    ``train`` (id, text, language) is the learning material; about ``rows_per_language`` of its documents per
    language, chosen by a hash of the id, are used.  Their words are counted in Spark.  With ``carry``, each row is
handed on whole, as the column ``row``.
    """
    spark = df.sparkSession
    known = train.select(id_col, text_col, lang_col).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = take_sample(known, id_col, [lang_col], rows_per_language)

    def count(batches):
        forget()
        for b in batches:
            pairs = [(lang, w) for lang, t in zip(b.column(1).to_pylist(), texts(b.column(0))) for w in words_of(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.binary())],
                names=["lang", "word"],
            )

    counted = sample.select(text_col, F.col(lang_col).cast("string").alias(lang_col)).mapInArrow(
        count, "lang string, word binary"
    ).groupBy("lang", "word").count().toArrow()
    by_lang: dict[str, dict[bytes, float]] = {}
    for lang, word, n in zip(*(c.to_pylist() for c in counted.columns)):
        by_lang.setdefault(lang, {})[word] = n
    names = sorted(by_lang)
    pieces = Pieces(vocabulary)
    table = np.stack([learn(pieces, by_lang[x], rounds, floor) for x in names], axis=1) if names else None
    shared, place = spark.sparkContext.broadcast((names, table)), place_of(df, text_col)

    def run(batches):
        langs, own = shared.value
        scorer, letter = langs and Scorer(kept(Pieces, vocabulary), own), letters()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                many = texts(text_of(part, place))
                fit = [bool(langs) and letter(t) is not None for t in many]
                lang, score = [UNKNOWN] * len(many), np.zeros(len(many))
                if any(fit):
                    cut = [words_of(t) if f else [] for t, f in zip(many, fit)]
                    wanted = set().union(*cut)
                    if len(wanted) <= REMEMBER // 2:
                        scorer.learn_words(wanted)
                    total = scorer.texts(cut)
                    share = np.exp(total - total.max(axis=1, keepdims=True))
                    share /= share.sum(axis=1, keepdims=True)
                    best = share.argmax(axis=1)
                    for i in np.flatnonzero(fit):
                        lang[i], score[i] = langs[best[i]], share[i, best[i]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[part.schema.names[0], "lang_pred", "score"],
                )

    narrow = carried(df, id_col, text_col, carry)
    return narrow.mapInArrow(run, result_type(narrow, lang_pred="string", score="double"))
