"""Words are tokenised once, whatever stands around them and whatever their case, and texts keep their ids."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lumenkg.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_word_is_tokenised_once(monkeypatch):
    found: list[list[int]] = []
    plain = packing._bytes
    monkeypatch.setattr(packing, "_bytes", lambda ids: (found.append(list(ids)), plain(ids))[1])
    text = 'wordlings Wordlings, (wordlings) "WORDLINGS." wordlings; *wordlings*\nwordlings!?'
    whole = Tokenizer.from_file(PATH)
    assert packing.Tokens(PATH)(text) == plain(whole.encode(text, add_special_tokens=False).ids)
    assert found.count(whole.encode("wordlings", add_special_tokens=False).ids) == 1


def test_ids_of_texts_of_odd_signs(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)  # words are forgotten again and again
    some = random.Random(3)
    signs = [*"aAbZ éÉßſİıŉÿŸ'\"([{$_-.,!?\n\t\r\x0b\x85 ²½1µªº", "<|endoftext|>", "́", "K", "中", "'s", "'ll", "ﬁ"]
    texts = ["".join(some.choices(signs, k=some.randint(0, 30))) for _ in range(3000)] + [f"{c}Ab, x{c}y" for c in map(chr, range(1, 0x180))] + [None, ""]
    own, whole = packing.Tokens(PATH), Tokenizer.from_file(PATH)
    assert list(own.of(pa.array(texts))) == [packing._bytes(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]
