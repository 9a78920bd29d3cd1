"""Packing documents into sequences of a fixed capacity by minimum bin slack.

Only documents longer than a sequence are cut, into whole sequences and a rest.  How pieces combine depends on
their lengths alone, so the histogram of lengths (at most ``capacity`` numbers, whatever the corpus holds) is
packed: each sequence takes the largest piece left, and a subset-sum over the lengths still available, kept as
bits of one integer, finds the fullest combination that fits beside it.  A combination is removed as often as
the counts allow, so the work is bounded by the number of lengths.

The combinations are then dealt to the pieces.  A piece's place among those of its length is its place within
the task that encoded it plus the count of that length in earlier tasks: one narrow table, no task holds all
pieces of a length.

A null text is empty: its only id is the end.  Repeated rows are packed each.  An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postwarden.llm.bytebpe import byte_characters
from postwarden.llm.common import Generations, batch, kept, texts
from postwarden.session import materialise

#: Words whose ids a worker remembers.
REMEMBER = 400_000
MARKS = [".", ",", "!", "?", ";", ":", "!!", ".!!", ",!!"]
#: Letters whose lower case and normal form don't depend on what stands beside them, and closing marks.
_LETTERS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,!?;:]*)").fullmatch


class WordIds:
    """Ids of texts by a tokenizer that drops white space, word by word.

    Such a tokenizer never joins what white space parts, so the ids of a text are those of its words in turn.
    """

    def __init__(self, path: str):
        # A task has one core; threads of the library's own would each hold memory besides.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.known = Generations(REMEMBER)  # ids of words
        self.letters = Generations(REMEMBER)  # ids of their letters in lower case
        self.marks: dict[str, bytes] = {}
        self.shown = byte_characters()
        # The bytes of each id; words of one piece share them.
        self.of = [i.to_bytes(4, "little") for i in range(max(self.library.get_vocab().values(), default=-1) + 1)]

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words.

        Most are Latin letters with or without closing marks.  The tokenizer parts the letters from the marks, so
        the letters' ids come from its model directly and are shared by all words that differ in marks or case.
        """
        if not self.marks:
            for mark, e in zip(MARKS, self.library.encode_batch_fast(MARKS, add_special_tokens=False)):
                self.marks[mark] = np.array(e.ids, "<u4").tobytes()
        others, spelt, model, shown, of = [], [], self.library.model, self.shown, self.of
        for word in words:
            text = word.decode()
            found = _LETTERS(text)
            if not found or (found[2] and found[2] not in self.marks):
                others.append(text)
            else:
                spelt.append((word, found[1].lower(), found[2]))
        for low in self.letters.missing({low for _, low, _ in spelt}):
            name = low if low.isascii() else "".join([shown[b] for b in low.encode()])
            self.letters.young[low] = b"".join([of[t.id] for t in model.tokenize(name)])
        known, letters, marks = self.known.young, self.letters.young, self.marks
        for word, low, mark in spelt:
            known[word] = letters[low] + marks[mark] if mark else letters[low]
        for word, e in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False)):
            known[word.encode()] = b"".join([of[i] for i in e.ids])

    def __call__(self, many: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [t.encode("utf-8", "replace").lower().split() for t in many]
        out = []
        for at in range(0, len(cut), 256):
            part = cut[at : at + 256]
            missing = self.known.missing(set().union(*part))
            if missing:
                self._learn(missing)
            out += [b"".join(map(self.known.young.__getitem__, words)) for words in part]
        return out


def loaded(path: str) -> WordIds:
    return kept(WordIds, path)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The combination of available lengths, each at most its count, with the largest sum up to ``room``.

    ``lengths`` is in descending order.  Bit s of an integer says whether the sum s can be reached; a length's
    count is taken in portions of 1, 2, 4, ... pieces.
    """
    mask, reached, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room or reached >> room & 1:
            continue
        left, portion = min(counts[length], room // length), 1
        while left > 0:
            take = min(portion, left)
            more = (reached | reached << (take * length)) & mask
            if more != reached:
                steps.append((length, take, reached))
                reached = more
            left, portion = left - take, portion * 2
    total, chosen = reached.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Combinations of lengths and how many sequences use each."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    made = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        chosen = [first, *fullest([x for x in lengths if counts[x]], counts, capacity - first)]
        counts[first] += 1
        uses = {x: chosen.count(x) for x in set(chosen)}
        times = min(counts[x] // n for x, n in uses.items())
        for x, n in uses.items():
            counts[x] -= n * times
        made.append((sorted(chosen, reverse=True), times))
        lengths = [x for x in lengths if counts[x]]
    return made


class Deal:
    """Which sequence and offset the r-th piece of a length gets."""

    SHIFT = 48

    def __init__(self, combinations: list[tuple[list[int], int]]):
        key, first, uses, start = [], [], [], []
        dealt: dict[int, int] = {}
        sequence = 0
        for chosen, times in combinations:
            offset = 0
            for length in dict.fromkeys(chosen):
                n = chosen.count(length)
                rank = dealt.get(length, 0)
                key.append((length << self.SHIFT) + rank)
                first.append(sequence)
                uses.append(n)
                start.append(offset)
                dealt[length] = rank + n * times
                offset += n * length
            sequence += times
        order = np.argsort(np.array(key, np.int64))
        self.key, self.first, self.uses, self.start = (
            np.array(x, np.int64)[order] for x in (key, first, uses, start)
        )

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = (length << self.SHIFT) + rank
        at = np.searchsorted(self.key, want, side="right") - 1
        j = want - self.key[at]
        return self.first[at] + j // self.uses[at], self.start[at] + j % self.uses[at] * length


def pieces(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row per piece: its place in the document, crc32 of its ids, and its place within this task."""
    schema = pa.schema([
        (id_col, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("task", pa.int64()), ("place", pa.int64()),
    ])
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches):
        encode, task = loaded(path), TaskContext.get().partitionId()
        met = [0] * (capacity + 1)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                for key, ids in zip(part.column(0).to_pylist(), encode(texts(part.column(1)))):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), width)):
                        own = ids[start : start + width]
                        n = len(own) // 4
                        rows.append((key, k, start // 4, n, zlib.crc32(own), task, met[n]))
                        met[n] += 1
                if rows:
                    yield batch(schema, *map(list, zip(*rows)))

    return df.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInArrow(
        run, f"{id_col} bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, place bigint"
    )


def packed(
    df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The sequence and offset of every piece of every document."""
    spark = df.sparkSession
    made = materialise(pieces(df, path, capacity, end_id, id_col, text_col), "pieces")
    by_task = materialise(made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    deal = spark.sparkContext.broadcast(Deal(minimum_bin_slack(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = made.join(before, ["task", "length"]).select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank")
    )
    schema = pa.schema([
        (id_col, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ])

    def run(batches):
        give = deal.value
        for b in batches:
            sequence, offset = give(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield batch(schema, *b.columns[:5], sequence, offset)

    return ranked.mapInArrow(
        run, f"{id_col} bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
