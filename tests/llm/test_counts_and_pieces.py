"""Token counts at prefixes, SentencePiece: against the libraries themselves."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm.common import kept
from ledgerlens.llm.sentencepiece_codec import AT_ONCE, Codec, decode_documents, encode_documents
from ledgerlens.llm.token_counts import PrefixCounter, counts_at, longest_within, token_prefixes

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.lists(st.sampled_from([*"ab1!' \n\té漢", "ll", "re", "  ", " ", "<|endoftext|>", "<|", "the", "\x1c", "　", "tion", "\U0001f600", "▁", "<s>", "\x00"]), max_size=14).map("".join)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(BPE)


@pytest.fixture(scope="module")
def codec():
    return Codec(PIECES)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXT)
def test_every_prefix(counter, library, text):
    want = [len(library.encode(text[: k + 1], add_special_tokens=False).ids) for k in range(len(text))]
    assert list(counts_at(counter.deltas(text))) == want
    assert counter.stores([text]) == [counter.deltas(text)]


def test_budgets(counter, library):
    text = "It's a test of budgets, isn't it?  Yes.\n" * 3
    store = counter.deltas(text)
    for budget in (0, 1, 5, 17, 1000):
        fits = [k for k in range(len(text) + 1) if len(library.encode(text[:k], add_special_tokens=False).ids) <= budget]
        assert longest_within(store, budget) == max(fits)


def test_forgetting_changes_nothing(odd_rows):
    small, large = PrefixCounter(BPE, remembered=10), PrefixCounter(BPE)
    for r in odd_rows:
        assert small.deltas(r[1] or "") == large.deltas(r[1] or "")


def test_counts_of_odd_rows(spark, odd, odd_rows, none, library):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, len(r.prefix_deltas)) for r in token_prefixes(odd, BPE).collect())
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids), len(r[1] or "")) for r in odd_rows)
    assert got == want
    assert token_prefixes(none, BPE).count() == 0


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXT)
def test_pieces_are_the_library_s(codec, text):
    (ids,), (same,), (parity,) = codec.encode([text])
    want = codec.library.encode(text)
    assert ids.tolist() == want and parity and same
    assert codec.decode(ids.tolist()) == codec.library.decode(want)


def test_pieces_of_odd_rows(odd, odd_rows, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = encode_documents(odd, PIECES).collect()
    assert all(r.parity and r.round_trip for r in got)
    assert sorted((r.doc_id or -1, r.ids) for r in got) == sorted((r[0] or -1, library.encode(r[1] or "")) for r in odd_rows)
    assert encode_documents(none, PIECES).count() == 0


def test_decoding_gives_texts_back(odd, odd_rows):
    got = decode_documents(encode_documents(odd, PIECES), PIECES).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((r[0] or -1, r[1] or "") for r in odd_rows)


def test_encodings_in_memory_are_bounded():
    codec, sizes = Codec(PIECES), []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, parts, **more):
            sizes.append(len(parts))
            return self.inner.encode_batch_fast(parts, **more)

    codec.tokenizer = Counting(codec.tokenizer)
    text = " ".join(f"w{k}" for k in range(2 * AT_ONCE + 5))
    (ids,), (same,), (parity,) = codec.encode([text])
    assert ids.tolist() == codec.library.encode(text) and same and parity
    assert sum(sizes) > 2 * AT_ONCE and max(sizes) <= AT_ONCE


def test_a_worker_keeps_one_operator_s_things():
    first = kept("test a", lambda: ["a"])
    assert kept("test a", list) is first
    kept("test b", list)
    assert kept("test a", list) is not first


def test_the_model_keeps_no_second_cache(monkeypatch):
    from ledgerlens.llm import sentencepiece_codec as module

    asked, bpe = [], module.models.BPE
    monkeypatch.setattr(module.models, "BPE", lambda **given: asked.append(given.get("cache_capacity")) or bpe(**given))
    codec = Codec(PIECES)
    (ids,), (same,), (parity,) = codec.encode(["abc abc  abd"])
    assert asked == [0] and ids.tolist() == codec.library.encode("abc abc  abd") and same and parity
