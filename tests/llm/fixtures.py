"""Small documents with the odd cases, and brute-force versions."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, ids string, toxic string, mix_key string, host string, component string"


def docs(spark, rows):
    """(doc_id, text, source) rows with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "r", "s", "i", "t", "m", "h", "c") for i, t, s in rows], SCHEMA)


def vocabulary(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def odd_rows():
    rng, words = random.Random(5), vocabulary()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, long_ = text(120), text(60), text(9_000)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "a"), (2, base, "a"), (3, " ".join(near), None), (4, None, "a"), (5, "", "b"), (6, " \t\n\x0b\f\r ", "b"), (7, "one", None), (None, base, "b"), (None, None, None),
        (8, text(30) + " " + passage + " " + text(30), "c"), (9, passage + " " + text(5), "c"), (10, text(5) + "\n" + passage, "a"), (11, long_, "a"), (12, long_ + " tail", "a"),
        (13, text(49), "a"), (14, passage, "d"), (14, passage, "d"), (14, text(70), "d"), (15, base.upper(), "a"), (16, "x " * 200, "e"), (17, "\x00 ▁ 漢字 😀 é́ ", "e"), (18, "a b c", "e"),
        (19, "line\nline\nline\nother line here", "e"), (20, "#*$%&|<> " * 30, "f"),
    ]
    return rows + [(100 + k, text(40 + k), "a") for k in range(30)]
