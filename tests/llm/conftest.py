import random

import pytest

SYLLABLES = {"en": "the and of ing er tion st nd re th", "de": "der und ein sch keit ung ver ß ü ä", "es": "que ción ar los ía ñ mente do es ll"}


def prose(rng, n, lang="en"):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Clean texts, exact and near copies, a shared passage, null and empty texts, null and repeated ids, repeated
    rows, one very long text, and columns whose names operators use themselves."""
    rng = random.Random(7)
    rows = []
    for k in range(90):
        lang = ("en", "de", "es")[k % 3]
        rows.append((k, prose(rng, rng.randint(1, 160), lang), lang))
    passage = prose(rng, 70)
    for k in range(90, 96):
        rows.append((k, f"{prose(rng, 30)} {passage} {prose(rng, 20)}", "en"))
    base = prose(rng, 300)
    for k in range(96, 102):
        rows.append((k, base if k < 99 else base + " tail" + str(k), "en"))
    rows += [(102, "", "en"), (103, None, "en"), (104, "?! ... --", None), (105, "Ab", "en"), (105, "Ab", "en"), (105, "other text", "de"),
             (None, "no id here at all", "en"), (None, None, None), (106, prose(rng, 40_000), "en"), (107, "word " * 400, None)]
    rows.append((108, 'Password = "abcdefghijkl123" and AKIA' + "A" * 16 + " then " + "0f" * 10 + " token: api_key: 'abcdefghijklmnop'", "en"))
    out = [(i, t, g, None if t is None else len(t), "x", 1, 2.0) for i, t, g in rows]
    fields = "doc_id long, text string, lang string, n_chars long, fingerprint string, component_id int, score double"
    return spark.createDataFrame(out, fields).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark, documents):
    return spark.createDataFrame([], documents.schema)
