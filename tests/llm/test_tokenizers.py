"""Token counts and sentence pieces equal their libraries'; decoding gives the text back."""

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanloom.llm import sentence_pieces, token_counts

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
counter, library = token_counts.loaded(WORDS), Tokenizer.from_file(WORDS)
pieces, model = sentence_pieces.loaded(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
bits = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "▁", "日本", "🙂", "é", "é", "İ", "Σ", "ing", "'s", "<|endoftext|>", "<s>", "<0x0A>", "\x00", "1", "=====", "tion"]), max_size=14).map("".join)
#: Characters that every Unicode table at hand knows: the regex library's is newer than the tokenizer library's.
known = st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(bits | known)
def test_counts_equal_the_library(text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(bits | st.text(max_size=40))
def test_ids_and_decoding_equal_the_library(text):
    ids = model.encode(text, add_bos=True, add_eos=True)
    mine = pieces.encode([text])
    assert np.frombuffer(mine[0], "<u4").tolist() == ids
    assert pieces.decode(mine) == [model.decode(ids)] == [text.replace("▁", " ")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=12))
def test_any_ids_decode(ids):
    assert len(pieces.decode([np.array(ids, "<u4").tobytes()])) == 1


def test_small_word_table(monkeypatch):
    monkeypatch.setattr(token_counts, "WORDS_KEPT", 2)
    assert token_counts.WordCounter(WORDS).count("one two three four one") == len(library.encode("one two three four one", add_special_tokens=False).ids)


def test_frames(spark, docs, texts, awkward, nothing):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, WORDS, limit=20).collect()}
    for i, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 20)
    coded = {r.doc_id: r for r in sentence_pieces.encode_and_decode(docs, PIECES).collect()}
    for i, t in texts:
        assert np.frombuffer(coded[i].ids, "<u4").tolist() == model.encode(t or "", add_bos=True, add_eos=True)
        assert coded[i].n_tokens == len(coded[i].ids) // 4
    assert token_counts.count_tokens(awkward, WORDS).count() == sentence_pieces.encode_and_decode(awkward, PIECES).count() == 8
    assert token_counts.count_tokens(nothing, WORDS).count() == sentence_pieces.encode_and_decode(nothing, PIECES).count() == 0
    assert sentence_pieces.with_pieces(docs, PIECES).columns == [*docs.columns, "ids", "n_tokens"]
