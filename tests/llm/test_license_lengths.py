import random

import numpy as np
import pytest

from faunaflux.llm import bytescan as bs
from faunaflux.llm import licenses


@pytest.mark.parametrize("length", [3, 4004, 4005, 6000, 20000])
def test_every_length_is_searched(length):
    rng = random.Random(length)
    words = [f"w{rng.randrange(10**6)}" for _ in range(length + 4)]
    index = licenses.Index({"long": " ".join(words)})
    data = np.frombuffer(" ".join(["before"] * 50 + words + ["after"] * 50).encode(), np.uint8)
    _, h, at = bs.tokens(data, np.array([0, len(data)]), licenses._LETTER)
    sh, _ = bs.shingles(h, at, licenses.WORDS)
    assert any(set(index.sets[t]) <= set(sh[s:e]) for t, s, e in index.scan(sh))
