import random

import pytest

@pytest.fixture(scope="session")
def mixed():
    """Texts with copies, shared passages, runs, white space of all kinds, empties."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(80)] + ["é", "ñandú", "漢字"]
    paras = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 150))) for _ in range(20)]

    def text():
        x = []
        for _ in range(rng.randint(0, 6)):
            r = rng.random()
            x.append(rng.choice(paras) if r < 0.6 else "ab" * rng.randint(50, 300) if r < 0.7 else "é " * rng.randint(1, 200) if r < 0.8 else " ".join(rng.choice(words) for _ in range(40)))
        s = rng.choice([" ", "\n", "\t "]).join(x)
        if s and rng.random() < 0.4:
            i = rng.randrange(len(s))
            s = s[:i] + rng.choice("xyz \n") + s[i + 1 :]
        return s

    rows = [(i, text()) for i in range(160)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, rows[3][1]), (204, rows[3][1]), (205, "w1 " * 30000)]
    return rows
