import random

import pytest


@pytest.fixture(scope="session")
def awkward():
    """Texts with every awkward trait: null, empty, blank, very long, repeated, odd white space, other scripts."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "Delta", "été", "漢字", "x1", "--", "é", "don't"]
    long_ = " ".join(rng.choice(words) for _ in range(20_000))
    return [None, "", "   \n\t", "one", "a  b\n\nc d", long_, long_, "same text here", "same text here", "x" * 5000, "'ll 're 12 %%%\n"]
