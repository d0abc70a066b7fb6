import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[2])]

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, label int, chunk string, key string"


@pytest.fixture
def documents(spark):
    """(doc_id, text) pairs as a table with further columns whose names clash with derived ones."""

    def make(rows):
        full = [(i, t, "en", f"s{k % 3}" if k % 7 else None, None if t is None else len(t), "x", None, k, "c", None) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts of a small vocabulary with copies, near copies, shared passages and odd cases."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = text(60)
    rows = []
    for i in range(60):
        own = text(rnd.choice([3, 30, 80, 150]))
        if i % 5 == 0:
            own += "\n" + passage + " " + text(10)
        rows.append((i, own))
    for i in range(60, 90):  # copies, case changes, small edits
        base = rows[rnd.randrange(30)][1]
        words = base.split(" ")
        if i % 3 == 0:
            words[rnd.randrange(len(words))] = f"new{i}"
        elif i % 3 == 1:
            base = base.upper() if base.isascii() else base
            words = base.split(" ")
        rows.append((i, " ".join(words)))
    rows += [(90, None), (91, ""), (92, " \t\n\x0b"), (93, "one"), (94, "one"), (95, "ONE"), (96, " ".join(["same"] * 50)), (97, text(20_000)), (98, "a b c d  e")]
    rnd.shuffle(rows)
    return rows
