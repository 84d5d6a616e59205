"""Inputs that the tests of this folder share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, n long, bands string"


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(3000)) for _ in range(n)]


def odd_documents():
    """Nulls in any column, empty and long texts, repeated rows, and extra columns whose names operators use themselves."""
    rng = random.Random(5)
    long_text = " ".join(words(rng, 30_000))
    plain = " ".join(words(rng, 120))
    rows = [
        (1, plain, "en", "a"),
        (2, plain, "en", "b"),
        (2, plain, "en", "b"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \t\n", "en", None),
        (6, long_text, "en", "b"),
        (None, " ".join(words(rng, 80)), "de", "a"),
        (None, plain + " x y", None, ""),
        (7, "two words", "en", "c"),
        (8, "Two  words", "en", "c"),
        (9, "é ü 漢字 \U0001f600 \\ </s> [INST]", "fr", "d"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), "clash", 7, None, "x") for r in rows]


def near_copies(rng, n_groups=6, size=4, length=60):
    """Texts, some of them edited copies of each other."""
    out = []
    for _ in range(n_groups):
        base = words(rng, length)
        for _ in range(size):
            edited = list(base)
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(length)] = "edit" + str(rng.randrange(1000))
            out.append(" ".join(edited))
    return out
