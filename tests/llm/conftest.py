import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, id int, gone string, _llm_key int"


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, junk, nulls, empty and long texts, repeated rows."""
    rng = random.Random(3)
    rows = []
    passage = prose(rng, 40)
    for i in range(60):
        en = i % 2 == 0
        body = "\n".join(prose(rng, rng.randint(8, 30), "abcdefgh" if en else "mnopqrst") for _ in range(rng.randint(2, 5)))
        if i % 10 == 3:
            body += "\n" + passage
        rows.append((i, body, "xx" if en else "yy", f"s{i % 3 if i % 5 else 0}"))
    base = rows[0][1].split(" ")
    for j in range(60, 68):  # near copies of the first
        near = list(base)
        near[j - 50] = f"edit{j}"
        rows.append((j, " ".join(near), "xx", "s0"))
    rows.append((70, rows[1][1], "yy", "s1"))  # exact copy
    rows.append(rows[2])  # repeated row
    rows += [(71, None, "xx", "s1"), (72, "", "xx", None), (73, " \t\n ", None, "s2"), (None, rows[3][1], None, None), (None, None, None, None)]
    rows.append((74, "# ! 1 2 3\n### %%", "xx", "s2"))
    rows.append((75, prose(rng, 6000), "xx", "s2"))
    rows.append((76, "same " * 400, "xx", "s2"))
    rows.append((77, "four words of text", "xx", "s2"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With columns whose names clash with those used inside."""
    rows = [(i, t, lang, s, None if t is None else len(t), "k", 1, "gone", 7) for i, t, lang, s in corpus]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(i, 0 if i % 4 == 0 else 1, 0) for i, *_ in corpus if i is not None and i < 60]
    return spark.createDataFrame([*rows, (None, 1, 0), (1, None, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
