import random

import pytest

WORDS = ("the of and to a in is that it was for on are as with his they at be this from have or by one had not but "
         "what all were when we there can an your which their said if do will each about how up out them then she "
         "many some so these would other into has more her two like him see time could no make than first been its "
         "straße été año über cœur naïve").split()


def prose(rng, n):
    out, line = [], []
    for _ in range(n):
        word = rng.choice(WORDS) + rng.choice(["", "", "ing", "ed", "s", str(rng.randint(0, 99))])
        line.append(word)
        if rng.random() < 0.1:
            out.append(" ".join(line).capitalize() + ".")
            line = []
    return " ".join([*out, " ".join(line)]).strip()


def altered(rng, text, share):
    w = text.split(" ")
    for k in range(len(w)):
        if rng.random() < share:
            w[k] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): prose, exact and near copies, shared passages, nulls, empty, symbols, a very long text."""
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randint(1, 160))) for i in range(60)]
    out += [(100 + i, out[i % 4][1]) for i in range(12)]
    out += [(200 + i, altered(rng, out[10 + i % 3][1] if len(out[10 + i % 3][1]) > 300 else out[20][1], 0.01))
            for i in range(12)]
    passage = prose(rng, 70)
    out += [(300 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 30)) for i in range(8)]
    out += [(400, None), (401, ""), (402, "!!! ***"), (403, None), (404, "one two"), (405, "One, two!"),
            (406, prose(rng, 9000)), (407, "ab " * 900), (408, "x" * 5000), (409, "日本語のテキスト。" * 80)]
    return out


SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names the operators use inside."""
    wide = [(i, t, None if i % 7 == 0 else f"src{i % 3}", i, "k", [i], None) for i, t in rows]
    return spark.createDataFrame(
        wide, SCHEMA + ", source string, place long, key string, spans array<long>, _id string").repartition(3)
