import random

import pyarrow as pa

from faunaflux.llm import language_id

LETTERS = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]


def prose(letters, n, rng):
    return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))


def test_six_languages(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(prose(x, 300, rng), f"l{i}") for i, x in enumerate(LETTERS) for _ in range(3)], "text string, lang string")
    model = language_id.learn(docs)
    mixed = " ".join(prose(x, 200, rng) for x in LETTERS)
    five = " ".join(prose(x, 200, rng) for x in LETTERS[:5])
    found = language_id.infer(model, pa.array([mixed, prose("abcd", 100, rng), five]))
    sets = [{x.split(":")[0]: float(x.split(":")[1]) for x in row[2].split(",")} for row in found]
    assert set(sets[0]) == {f"l{i}" for i in range(6)} and all(abs(v - 1 / 6) < 0.03 for v in sets[0].values())
    assert set(sets[1]) == {"l0"} and set(sets[2]) == {f"l{i}" for i in range(5)}
