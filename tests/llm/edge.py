"""Rows that every operator must take: nulls, empty and very long texts, ties,
repeats, characters beyond the BMP, and columns with the operators' own names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, id string, label int, target string, key binary, component long, copies array<int>, kind string, _text string"


def words(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows():
    long = " ".join(words(60_000, 1))
    common = " ".join(words(120, 2))
    texts = [
        (None, "an id is missing here, token = abcdef123456"), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, long), (6, common), (6, common),
        (7, common), (8, common + " and a little more"), (9, "😀 émoji 😀 a@b.co 😀"), (10, "!!! 12345 ..."), (11, "x" * 100_000), (12, None),
    ]
    out = []
    for i, (doc, text) in enumerate(texts):
        source = None if i % 4 == 0 else f"s{i % 3}"
        out.append((doc, text, None if i % 3 == 0 else "en", source, None if i % 2 else len(text or ""), None, i, "x", 1, "t", bytearray(b"k"), 5, [1], None, "other"))
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
