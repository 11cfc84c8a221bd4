"""Small document tables with the odd cases every operator must stand, and plain readings of the word rules."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, label string"
BLANK_WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    syllables = "the of an ti on re ed ing ha ou er st nd ea ly és au".split()
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(words))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(9999)}" if r.random() < share else w for w in text.split(" "))


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, near copies; columns that clash with results."""
    base, shared = prose(1, 180), prose(2, 70)
    texts = [base, base, base.upper(), None, "", " \n\t ", "one", "two words", "One", *[edited(base, s, 0.01) for s in range(6)]]
    texts += [prose(10 + s, 90) + "\n" + shared + "\n" + prose(40 + s, 60) for s in range(5)]
    texts += [prose(99, 12_000), "***$$$ %%% " * 30, "A line.\nA line.\n\nA line.\n  \n", "日本語 テキスト　です é́"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "c"][i % 4], len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[3], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
