"""The smallest given tables, and rows with nulls, empty and very long texts, ties and repeats."""

import random

SF = "/root/testdata/sf0.001"


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(random.Random(1).choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=20_000))
    return [
        (1, "One two three four five six seven eight nine ten eleven twelve", "en", "a"),
        (2, "One two three four five six seven eight nine ten eleven twelve", "en", "b"),
        (2, "One two three four five six seven eight nine ten eleven twelve", "en", "b"),
        (3, None, None, None),
        (4, "", "en", None),
        (5, " \t\n ", "fr", "b"),
        (6, "one", None, "a"),
        (7, "one  ", "en", "a"),
        (8, long, "en", "c"),
        (9, long + " end", "en", "c"),
        (10, "x" * 50_000, "de", "c"),
        (11, "é😀 'll it's naïve　x  12٣ !!'s", "fr", "é"),
        (None, "no id at all here my friend", "en", "a"),
        (None, None, None, None),
    ]
