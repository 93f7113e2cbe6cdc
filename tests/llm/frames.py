"""Rows that hold every odd case."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp string, `row` int, bucket int, h string, at int, words string, kept boolean, mark string"
EXTRA = ("x", "y", 1, 2, "z", 3, "w", True, "m")


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


ODD = [
    row(0, ""),
    row(1, None),
    row(2, "a b", source=None),
    row(3, words(20_000, 3)),
    row(4, words(80, 4)),
    row(5, words(80, 4), lang=None),
    row(5, words(80, 4), lang=None),
    row(6, "Ünï▁code É \x1c [INST] a@b.co " + words(60, 6), source="s1"),
    row(None, words(70, 7), None, None),
    row(None, None, None, None),
    row(9, " \n\t "),
    row(10, words(79, 4) + " changed", source="é"),
]
