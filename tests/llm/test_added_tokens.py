"""Texts that hold special tokens' strings, against the library as it comes."""

import random

import numpy as np
import pytest

from marlstone.llm import encode, token_files

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "a<|EndOfText|>b", "<|startoftext|> x <|endoftext|>", "x <| y", "plain words", "<|endoftext|><|endoftext|>  a\n\n"]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_special_strings_are_their_tokens(name, spaced):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path(name)
    own, whole = encode.encoder(path, spaced), Tokenizer.from_file(path)
    for t in TEXTS * 2:
        assert own.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids, t
    end = whole.token_to_id("<|endoftext|>")
    assert end in own.encode(TEXTS[0]).tolist() and len(own.encode(TEXTS[1])) == 1


def many_texts():
    rng = random.Random(3)
    pieces = ["don't", "'s", "'tis", "x's", "''ll", "it'S", "12", "3a4", "a1", ",", "...", "Zoë", "ÀÉ", "naïve,", "l'eau", "日本", "ſ", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\x1f", "\x00", "\x7f", "#&", "<|endoftext|>", "_", "-", "the", "Word"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(14))) for _ in range(3000)]
    return ["", " ", "\n", "'", "a ", " a", "\na", "a\n", "a\n\nb", *texts, " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(4000))]


@pytest.mark.parametrize("hashes", ["own", "equal"])
def test_texts_together_have_the_librarys_ids(monkeypatch, hashes):
    """Cut, hashed and looked up by numpy, in blocks and with tables of any size; also where all hashes are equal."""
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path("byte_bpe_50k.json")
    texts, library = many_texts(), Tokenizer.from_file(path)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    if hashes == "equal":
        monkeypatch.setattr(encode.tokens, "span_hashes", lambda data, starts, ends, values: np.ones(len(starts), np.uint64))
    for most, together in ((1_000_000, 500_000), (50, 200)):
        own = encode.SpacedEncoder(path, most, together, special=True)
        assert [x.tolist() for x in own.encode_all(texts)] == want
        assert [x.tolist() for x in own.encode_all(texts[::-1])] == want[::-1]


def test_new_splits_share_a_call_of_the_library():
    own = encode.SpacedEncoder(token_files.tokenizer_path("byte_bpe_50k.json"), special=True)
    calls, model, tokenizer = [], own.model, own.tokenizer

    class Counted:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.of, name)

    own.model, own.tokenizer = Counted(model), Counted(tokenizer)
    out = list(own.encode_all([f"word{chr(97 + i % 26)}{chr(97 + i // 26)} again" for i in range(200)] * 2))
    assert len(out) == 400 and calls == ["encode_batch_fast"]


@pytest.mark.parametrize("hashes", ["own", "equal"])
def test_words_together_have_the_librarys_ids(monkeypatch, hashes):
    """As above, for lower-cased words without white space."""
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path("word_bpe_49k.json")
    odd = ["\t", "a\tb\r\nc\x0b\x0cd", "IT'S ,'s ''s 1's '1 ' s", "</w> a</w>b", "99 1234,5", "\x1c", "a\x1fb", "ſt ŉ İ ı ẞ", "e\u0301 é", "x" * 300]
    texts, library = [*odd, *many_texts()], Tokenizer.from_file(path)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    if hashes == "equal":
        monkeypatch.setattr(encode.tokens, "span_hashes", lambda data, starts, ends, values: np.ones(len(starts), np.uint64))
    for most, together in ((1_000_000, 500_000), (50, 200)):
        own = encode.BatchEncoder(path, False, most, together, special=True)
        assert [x.tolist() for x in own.encode_all(texts)] == want
        assert [x.tolist() for x in own.encode_all(texts[::-1])] == want[::-1]


def test_new_words_share_a_call_of_the_library():
    own, calls = encode.encoder(token_files.tokenizer_path("word_bpe_49k.json"), False), []

    class Counted:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.of, name)

    own.model, own.tokenizer = Counted(own.model), Counted(own.tokenizer)
    assert len(list(own.encode_all([f"wordy{chr(97 + i % 26)}{chr(97 + i // 26)} Again" for i in range(200)] * 2))) == 400
    assert calls == ["encode_batch_fast"]
    encode._encoders.clear()
