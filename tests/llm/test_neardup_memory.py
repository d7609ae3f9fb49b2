"""Common bags of words, dealt into lots, equal a plain count."""
import collections

import numpy as np

from tierwise.llm import neardup


def test_common_words_in_lots(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, n).astype(np.uint32) for n in (0, 1, 7, 30, 200, 200, 900)]
    texts.append(texts[4].copy())
    bags = [collections.Counter(t.tolist()) for t in texts]
    want = [[sum((a & b).values()) for b in bags] for a in bags]
    for words in (50, 333, 10**6):
        monkeypatch.setattr(neardup, "WORDS", words)
        got = neardup.common_words(texts)
        assert all(got[i][j] == want[i][j] for i in range(len(texts)) for j in range(len(texts)) if i != j)
