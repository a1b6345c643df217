"""Texts and columns for the tests of this folder."""

import random

SHAPE = "doc_id long, text string, lang string, source string, n_chars int"
#: Extra columns whose names the operators use inside.
CLASHING = {"key": "cast(1 as int)", "gone": "'x'", "count": "cast(2 as long)", "n": "cast(3 as long)", "epochs": "0.5D", "copy": "cast(4 as int)", "content": "cast(5 as long)", "toxic": "true", "score": "0.25D", "node": "cast(6 as long)", "repeated": "cast(7 as long)", "own_source": "'y'"}
WORDS = [a + b + c for a in ("ba", "ko", "li", "mu", "ne") for b in ("ra", "se", "ti", "vo") for c in ("n", "s", "lor", "mek", "da")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, edits: int) -> str:
    rng, found = random.Random(seed), text.split()
    for _ in range(edits):
        found[rng.randrange(len(found))] = "edited" + str(rng.randrange(10**6))
    return " ".join(found)
