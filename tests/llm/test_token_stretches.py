"""Texts cut at blanks and behind words: ids equal the library's, and what recurs is neither cut nor looked up again."""

from __future__ import annotations

import random
import re

import numpy as np

from fraygraph.llm import token_output, tokens

PARTS = ["a", "b", "don't", "'s", "'", "''t", "\n", "\n\n", "\t", "\r", "\x0b", "\x0c", " ", "  ", " \n", "\n ", "1", "23", "!", "--", "é", "Ü", "@x.com", "word", "中", "\x00", "\x1c", "<|endoftext|>"]


def expected(encoder: tokens.TokenIds, texts: list[str]) -> list[bytes]:
    return [np.asarray(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_odd_texts_equal_the_library():
    draw = random.Random(5)
    texts = ["".join(draw.choice(PARTS[: draw.choice((24, 28))]) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "  ", "\n", " a", "a ", "a\n", "a\n\nb", "x\n\ny\nz", "it's,'tis 're", "1\na\nb"]
    for most in (50, 400_000):  # small enough to turn the caches over, and large
        encoder = tokens.TokenIds(token_output.tokenizer_file(), most=most)
        found = [ids for i in range(0, len(texts), 100) for ids in encoder.encode(texts[i : i + 100])]
        assert found == expected(encoder, texts)


def test_recurring_words_are_not_cut_again(monkeypatch):
    cut = []

    class Counted:
        def findall(self, text):
            found = re.findall(pattern, text)
            cut.extend(found)
            return found

    pattern = tokens.PIECES
    monkeypatch.setattr(tokens, "PIECES", Counted())
    encoder = tokens.TokenIds(token_output.tokenizer_file())
    texts = ["The same few words, again.\nAnd " * 500 + "end"] * 3
    assert encoder.encode(texts) == expected(encoder, texts)
    assert len(cut) < 100  # all 12,000 pieces were cut out and looked up one by one before
    assert len(encoder.met) < 20
