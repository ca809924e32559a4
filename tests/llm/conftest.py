from __future__ import annotations

import random

import pytest

VOCABULARY_FOLDER = "/opt/tokenizers"

#: Columns that operators make for themselves; a table may have them too.
CLASHING = ["node", "part", "key", "hash", "shard", "slot", "size", "h", "d", "bucket", "score", "kept", "n", "item", "words", "hits"]


def prose(rng: random.Random, words: int) -> str:
    parts = ["the", "of", "and", "ther", "ing", "sta", "ble", "ou", "ne", "lor", "mi", "que", "é", "ü"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def vocabulary():
    return lambda name: f"{VOCABULARY_FOLDER}/{name}"


@pytest.fixture(scope="session")
def awkward_rows():
    """Rows with nulls, empty and blank texts, one long text, repeated rows, equal texts, and near copies."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(25, 120)) for _ in range(40)]
    rows = [(i, text) for i, text in enumerate(texts)]
    rows += [(100 + i, texts[0]) for i in range(30)]
    for i in range(30):
        words = texts[1].split()
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((200 + i, " ".join(words)))
    passage = prose(rng, 60)
    rows += [(300 + i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "!!! ???"), (404, "one two"), (405, "one two"), (406, "")]
    rows += [(407, prose(rng, 30_000)), (408, "a b c\x1cd  e"), (None, "a text without an id, " + texts[2]), (None, None)]
    rows += [rows[3], rows[3]]
    rows += [(409, "\n".join(["same line here"] * 12 + [""] * 3)), (410, "x " * 200)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(awkward_rows, "doc_id long, text string").repartition(3)
    return docs.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit(i) for i, c in enumerate(CLASHING)})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
