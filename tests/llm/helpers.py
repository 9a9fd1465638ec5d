"""Small tables for the tests of the llm subpackage."""

from __future__ import annotations

import random
import re
from collections import Counter

WORDS = re.compile(r"[^\W_]+")


def vocabulary(n: int = 400, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n)]


def text(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def edited(rng: random.Random, words: list[str], t: str, share: float) -> str:
    out = [rng.choice(words) if rng.random() < share else w for w in t.split()]
    if rng.random() < 0.3:
        k = len(out) // 2
        out = out[k:] + out[:k]
    return " ".join(out)


def dice(a: str, b: str) -> float:
    x, y = (Counter(WORDS.findall((t or "").lower())) for t in (a, b))
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if n else 0.0


def n_words(t: str | None) -> int:
    return len(WORDS.findall((t or "").lower()))


def conversation_rows(n: int = 120, seed: int = 3) -> list[tuple]:
    """(src, id, split, source, text) with groups of near and exact copies, repeats, nulls, blanks, short texts."""
    rng, words = random.Random(seed), vocabulary()
    rows: list[tuple] = []
    for i in range(n):
        src, split = rng.choice(["a", "b"]), rng.choice(["train", "train", "valid", "test", None])
        kind = rng.random()
        if rows and kind < 0.35:
            t = edited(rng, words, rng.choice(rows)[4] or "", rng.choice([0.03, 0.1, 0.25]))
        elif rows and kind < 0.45:
            t = rng.choice(rows)[4]
        else:
            t = rng.choice([None, "", "  \n", "Kurz_und gut"]) if kind > 0.95 else text(rng, words, rng.randint(15, 120))
        rows.append((src, i, split, f"s{i % 3}", t))
    return rows + rows[:5]
