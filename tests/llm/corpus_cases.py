"""Rows that operators must handle."""

import random

WORDS = "the of and to in is that river stone garden window letter bread winter harbour mountain paper candle silver orchard meadow lantern copper village thunder".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


#: Nulls in every column, empty, tiny and very long texts, repeated rows, and columns whose names operators use themselves.
ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, __lost string, bucket int, rank long"


def odd_rows():
    long_text = " ".join(prose(k, 40) for k in range(500))
    texts = [(1, prose(1, 60)), (2, None), (3, ""), (4, "x"), (5, long_text), (6, prose(6, 30)), (6, prose(6, 30)), (7, prose(1, 60)), (None, prose(8, 25)), (None, None), (9, " \t\n\r "), (10, "a\n\nb\n"), (11, "Ünïcode ﬁ 日本 \U0001f600 " + prose(11, 20)), (12, "\u0085  x")]
    return [(i, t, None if (i or 0) % 2 else "en", None if (i or 0) % 3 == 0 else "s", None if i == 4 else len(t or ""), "k", 1, "l", 2, 3) for i, t in texts]
