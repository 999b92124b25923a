"""Small documents with the awkward cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, size string"


def awkward(seed=0, n=60):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(seed)
    words = ["the", "The", "of", "naïve", "x.", "日本語", "<|endoftext|>", "<|startoftext|>", "9,5", "it's", "😀"] + [f"w{i}" for i in range(60)]
    gaps = [" ", "  ", "\n", "\t", " \n", "\x1c", "\xa0"]
    rows = []
    for i in range(n):
        text = "".join(w + rng.choice(gaps[:1] * 20 + gaps) for w in rng.choices(words, k=rng.randint(0, 80)))
        rows.append((i * 3, text, "en", f"s{i % 4}", len(text), "clash", "clash"))
    rows += [
        (1000, None, None, None, None, None, None),
        (1001, "", "en", "s0", 0, "", ""),
        (1002, " \n\t ", "en", None, 4, "", ""),
        (1003, rows[5][1], "en", "s1", 1, "", ""),
        (1004, "w1 " * 30_000, "en", "s2", 90_000, "", ""),
        (1005, "y" * 50_000, "en", "s2", 50_000, "", ""),
        (1006, "one", None, "s3", 3, "", ""),
        rows[7],
        rows[7],
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
