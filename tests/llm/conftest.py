from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ["h", "band", "start", "sha", "w1", "n", "m", "root", "id", "rep", "_words", "_row", "_findings", "rank", "shard", "slot", "kept", "stratum", "refers_to", "_x", "x", "count"]


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, junk, nulls, empty, short and long texts."""
    rng = random.Random(9)
    syllables = "an be ci do eth fro gan hu is jo ka lem no or pa qui re st tu ve".split()
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    passage, texts = prose(60), []
    for i in range(150):
        words = prose(rng.randint(12, 160))
        if i % 9 == 0:
            words = f"{words}\n{passage}\n{prose(20)}"
        texts.append(words)
    base = texts[3] + " " + prose(90)
    texts += [base, base, base, base.replace(" ", "\n"), base.upper()]
    for k in range(12):
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [None, "", "   \n\t", "one", "four words in all", "four words in all", "five words are in here", "a " * 5000, prose(20_000), "éß \U0001f600 " * 30, "x" * 70_000, passage, passage + " " + passage]
    texts += ["### $$$ %%% " * 20 + prose(20), "| a | b |\n" * 40 + prose(12), "same line of words here\n" * 30]
    return [(i, t, ("en", "de", None, "xx-long")[i % 4], "src0" if i % 3 else "src1", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, clashing columns."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long, "en", "s", 1), (None, None, None, None, None), (1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, long + " end", "en", "s", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in CLASHES})
