"""The case of letters in packing's word tokenizer."""
import numpy as np
import tokenizers
from public_tokenizers import path

from repselect.llm import pack

WORDS = path("word_bpe_49k.json")


def test_special_tokens_are_told_by_their_case():
    own, whole = pack.WordTokenizer(WORDS), tokenizers.Tokenizer.from_file(WORDS)
    for text in ("<|ENDOFTEXT|>", "A <|EndOfText|> B", "<|endoftext|>É <|ENDOFTEXT|>", "x<|STARTOFTEXT|>Ω", "Y<|startoftext|>Z"):
        for _ in range(2):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_small_letters_without_the_library_s_normalizer():
    own, whole = pack.WordTokenizer(WORDS), tokenizers.Tokenizer.from_file(WORDS)
    assert own.plain.normalizer is None
    letters = [chr(k) for k in range(1, 0x300)]
    for text in (" ".join(letters), " ".join(f"a{x}B{x}" for x in letters), "".join(x for x in letters if not x.isspace()), "İİI ÀÉÎ'S STRAẞE"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_signs_behind_a_word_are_not_encoded_with_it(monkeypatch):
    own, whole, sent = pack.WordTokenizer(WORDS), tokenizers.Tokenizer.from_file(WORDS), []
    encode_new = getattr(own, "encode_new", own.learn)
    monkeypatch.setattr(own, "encode_new" if hasattr(own, "encode_new") else "learn", lambda words: (sent.extend(words), encode_new(words)))
    texts = [
        "word, word. word%%% word;' word's, it's. 'S' don't! 12, 1²? x¼) é, éé&& é, ª! a_b_ _a_ __ \x01, a\x01, a­. …, a…, Ω. Ωa, a̸= ≠",
        "<|endoftext|> <|endoftext|>. a<|endoftext|>, <|ENDOFTEXT|>, " + "w" * 70 + ", " + "w" * 70 + "., word, word"]
    for text in texts * 2:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert sent.count(b"word") == 1 and not {b"word,", b"word.", b"word%%%"} & set(sent)
