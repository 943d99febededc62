"""Small documents that hold what the operators look for."""

import random

WORDS = [a + b + c for a in ("ba", "ko", "ti", "ru", "ven", "sal") for b in ("lo", "mi", "ter", "an", "is") for c in ("", "n", "r", "st")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def lines(seed, n):
    return "\n".join(prose(seed * 1000 + i, 7) for i in range(n))


def corpus():
    """(doc_id, text) with exact and near copies, shared passages and lines, short, long and odd texts."""
    passage, block = prose(1, 70), lines(2, 4)
    near = prose(3, 120).split()
    rows = [(i, prose(100 + i, 20 + 9 * i)) for i in range(12)]
    rows += [(20 + i, prose(200 + i, 30) + " " + passage + " " + prose(300 + i, 25)) for i in range(6)]
    rows += [(30 + i, lines(400 + i, 3) + "\n" + block + "\n" + lines(500 + i, 3)) for i in range(5)]
    for i in range(8):
        words = list(near)
        words[5 + 11 * i % 100] = "changed"
        rows.append((40 + i, " ".join(words)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, ""), (53, " \n\t "), (54, "one"), (55, "ONE"), (56, None), (57, "a\na\na\na\na"), (58, "é日本\U0001f600 x"), (59, prose(9, 5000))]
    return rows
