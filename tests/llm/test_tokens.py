"""Byte-level BPE and packing against the libraries and by exact round trips."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postwarden.llm import bytebpe, packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sab.,1é\u0301\u00a0")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoding_equals_the_library_of_the_ranks(text):
    import tiktoken

    if not hasattr(test_encoding_equals_the_library_of_the_ranks, "own"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        test_encoding_equals_the_library_of_the_ranks.own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = test_encoding_equals_the_library_of_the_ranks.own.encode_ordinary(text)
    bpe = bytebpe.loaded(RANKS, P.PATTERN)
    ids = bpe.encode(text)
    assert ids.tolist() == want
    assert bpe.decode_bytes(ids.tolist()) == text.encode()
    assert "".join(bpe.decode_stream(ids.tolist())) == text


def test_runs_of_one_letter(reference):
    bpe, rng = bytebpe.loaded(RANKS, P.PATTERN), random.Random(1)
    for n in range(1, 60):
        for text in ("a" * n, "ab" * n, "".join(rng.choices("aab", k=n)), "é" * n):
            assert bpe.encode(text).tolist() == reference.encode_ordinary(text)


def test_offsets_cover_the_text():
    bpe, text = bytebpe.loaded(RANKS, P.PATTERN), "Grüße 😀😀 日本語"
    starts, ends = bpe.offsets(text, ids := bpe.encode(text))
    assert starts[0] == 0 and ends[-1] == len(text) and (ends[:-1] >= starts[1:]).all()
    for s, e, i in zip(starts, ends, ids):
        assert bpe.table[i] in text[s:e].encode()


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBER", 8)
    bpe = bytebpe.ByteBpe(RANKS, P.PATTERN)
    text = " ".join(f"w{i}" for i in range(50))
    assert bpe.decode_bytes(bpe.encode(text).tolist()) == text.encode()


def test_round_trips(apply, rows, reference):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in apply("op2_byte_bpe"))
    want = Counter()
    for key, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        want[key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want


def test_encoded_operator(crowded, none):
    out = bytebpe.encoded(crowded, RANKS, P.PATTERN).filter("doc_id = 206").first()
    assert out.decoded == "ka lo mi" and out.starts[0] == 0 and out.ends[-1] == 8
    assert bytebpe.encoded(none, RANKS, P.PATTERN).count() == 0
    assert bytebpe.round_trips(none, RANKS, P.PATTERN).count() == 0


def words_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def check_packing(out, rows, capacity):
    t = words_encoder()
    ids_of = defaultdict(list)
    for key, text, *_ in rows:
        ids_of[key].append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    pieces = Counter()
    for key, many in ids_of.items():
        for ids in many:
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                pieces[key, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in out)


def test_packing_query(apply, rows):
    bins, total = check_packing(apply("op6_best_fit_packing"), rows, 4096)
    assert bins <= -(-total // 4096) + 1


def test_packing_in_small_bins(crowded, rows, none):
    bins, total = check_packing(packing.packed(crowded, P.path("word_bpe_49k.json"), 64).collect(), rows, 64)
    assert bins <= 1.1 * total / 64 + 1
    assert packing.packed(none, P.path("word_bpe_49k.json")).count() == 0


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=8), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_fullest_against_all_sums(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    chosen = packing.fullest(sorted(counts, reverse=True), counts, room)
    assert sum(chosen) == max(s for s in sums if s <= room)
    assert all(n <= counts[x] for x, n in Counter(chosen).items())


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_every_piece_is_packed_once(histogram):
    made = packing.minimum_bin_slack(histogram, 50)
    used = Counter()
    for chosen, times in made:
        assert sum(chosen) <= 50
        for x in chosen:
            used[x] += times
    assert used == Counter(histogram)


def test_word_ids_equal_the_library():
    own, t = packing.WordIds(P.path("word_bpe_49k.json")), words_encoder()
    many = ["Été À l'heure, ÜBER!! naïve.", "it's <|endoftext|> 12a3 e\u0301 \u2003x\x1cy", "ΣΑΣ İ ﬁ ½ ²", "", "a.b,c!? ...", "ÿ ß ÷ ×"]
    for text in many:
        assert np.frombuffer(own([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
