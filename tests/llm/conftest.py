import random

import pytest

WORDS = [a + b for a in ("ra", "lo", "mi", "tu", "ke", "so", "pa", "ne", "vi", "du") for b in ("na", "ber", "tos", "lin", "gar", "mel", "run", "dex", "pol", "sha")]


@pytest.fixture
def prose():
    """Seeded texts of invented words."""

    def make(n, seed, words=WORDS):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return make
