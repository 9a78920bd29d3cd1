"""Byte-level BPE: encoding, byte and character offsets, decoding.

A rank file (base64 bytes and rank per line) becomes a model of the tokenizers
library: every byte maps to a printable character, and every way to build a
ranked token from two ranked tokens becomes a merge, in rank order.  Texts
arrive in Arrow batches.  A text is cut where a match of the pattern surely
ends (before a single space or around a single line feed between non-space
characters); pieces repeat, so each worker keeps a bounded memory of the ids of
pieces it has met and asks the library for new ones only.

Null texts encode like empty ones: no ids.  Texts of any length work; a text is
never cut to a prefix.  Repeated rows give repeated results.  Only the named
columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postwarden.llm.common import Generations, batch, kept, texts

#: Pieces a worker remembers.
REMEMBER = 500_000

_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LINE = re.compile(r"(?<=\S)\n(?=\S)")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in shown:
            shown[b] = chr(spare)
            spare += 1
    return [shown[b] for b in range(256)]


class ByteBpe:
    """Encoder and decoder of one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        shown = byte_characters()

        def name(token: bytes) -> str:
            return "".join([shown[b] for b in token])

        merges = []
        for token, rank in ranks.items():
            ways = [
                (rank, ranks[token[:i]], ranks[token[i:]], token[:i], token[i:])
                for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
            ]
            merges += ways
        merges.sort(key=lambda m: m[:3])
        self.library = Tokenizer(models.BPE(
            {name(t): r for t, r in ranks.items()}, [(name(m[3]), name(m[4])) for m in merges]
        ))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.length = np.array([len(t) for t in self.table], np.int64)
        self.flat = np.frombuffer(b"".join(self.table), np.uint8)
        self.start = np.cumsum(self.length) - self.length
        self.known = Generations(REMEMBER)

    def _learn(self, pieces: Iterable[str]) -> None:
        new, known = list(pieces), self.known.young
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for piece, found in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                known[piece] = np.array(found.ids, "<u4").tobytes()

    def encode_bytes(self, many: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = []
        for text in many:
            pieces: list[str] = []
            for k, line in enumerate(_LINE.split(text)):
                if k:
                    pieces.append("\n")
                first, *rest = _SPACE.split(line)
                pieces.append(first)
                pieces += map(" ".__add__, rest)
            cut.append(pieces)
        out = []
        for at in range(0, len(cut), 256):
            part = cut[at : at + 256]
            missing = self.known.missing(set().union(*part))
            if missing:
                self._learn(missing)
            out += [b"".join(map(self.known.young.__getitem__, pieces)) for pieces in part]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes([text or ""])[0], "<u4")

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last character of each token.

        A token that begins or ends inside a character covers the whole of it.
        """
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.length[ids])
        starts = ends - self.length[ids]
        return char_of_byte[starts], char_of_byte[ends - 1] + 1

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64)
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.start[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ids) else 0)
        return self.flat[places].tobytes()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text each id completes: a character split over ids comes with the last of them."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.table[i])
        if rest := decoder.decode(b"", True):
            yield rest

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder per worker process."""
    return kept(ByteBpe, path, pattern)


def encoded(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids, character spans and decoded text per row, in Arrow batches."""
    kind = {f.name: f.dataType for f in df.schema}[id_col].simpleString()

    def run(batches):
        bpe = loaded(path, pattern)
        for b in batches:
            many = texts(b.column(1))
            ids = [np.frombuffer(x, "<u4") for x in bpe.encode_bytes(many)]
            spans = [bpe.offsets(t, i) if len(i) else (i, i) for t, i in zip(many, ids)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([i.astype("i4") for i in ids], pa.list_(pa.int32())),
                pa.array([s.astype("i4") for s, _ in spans], pa.list_(pa.int32())),
                pa.array([e.astype("i4") for _, e in spans], pa.list_(pa.int32())),
                pa.array([bpe.decode(i.tolist()) for i in ids], pa.string()),
            ], names=["id", "ids", "starts", "ends", "decoded"])

    out = df.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string"
    )
    return out.withColumnRenamed("id", id_col)


def round_trips(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of the ids and of the bytes they decode to, per row."""
    schema = pa.schema([
        (id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
    ])

    def run(batches):
        bpe = loaded(path, pattern)
        for b in batches:
            keys = b.column(0)
            for at in range(0, b.num_rows, 512):
                encoded = bpe.encode_bytes(texts(b.column(1).slice(at, 512)))
                back = [bpe.decode_bytes(np.frombuffer(x, "<u4")) for x in encoded]
                yield batch(
                    schema, keys.slice(at, 512).cast(pa.int64()), [len(x) // 4 for x in encoded],
                    [hashlib.sha256(x).hexdigest() for x in encoded],
                    [hashlib.sha256(x).hexdigest() for x in back],
                )

    return df.select(id_col, text_col).mapInArrow(
        run, f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
