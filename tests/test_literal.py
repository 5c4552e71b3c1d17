"""The search of batches for many literal phrases against counting each one in each text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pagesieve.functions import literal


@pytest.mark.parametrize("seed", range(12))
def test_phrases_are_counted_as_one_by_one(monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(literal, "CHARACTERS", r.choice([1, 50, 1 << 20]))
    letters = r.choice(["ab", "abcé😀 ", "abcdefghijklmnop "])
    phrases = ["".join(r.choices(letters, k=r.randrange(14))) for _ in range(60)] + [None]
    phrases += ["".join(r.choices(letters, k=30))[-20:] for _ in range(5)]
    texts = ["".join(r.choices(letters, k=r.randrange(80))) for _ in range(50)] + [None, "", "".join(phrases[-5:])]
    listed = literal.Phrases(np.arange(len(phrases)) * 7, pa.array(phrases, pa.string()))
    got = [x for part in listed.found(pa.array(texts, pa.string()).slice(3)) for x in zip(*(p.tolist() for p in part))]
    want = [(i, 7 * j, t.count(p)) for i, t in enumerate(texts[3:]) if t for j, p in enumerate(phrases) if p and p in t]
    assert sorted(got) == want


def test_no_phrases_and_no_texts():
    none = literal.Phrases(np.zeros(0, np.int64), pa.array([], pa.string()))
    assert list(none.found(pa.array(["some"]))) == []
    assert list(literal.Phrases(np.arange(1), pa.array(["some"])).found(pa.array([], pa.string()))) == []
