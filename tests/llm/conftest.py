from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASHING = ("score", "lang_pred", "size", "shard", "slot", "k1", "k2", "k", "hub", "member", "class_id", "places", "copies", "rate", "group_key", "spans", "kept", "bucket", "line", "component_id", "rule", "verdict", "host", "template")


def words(rng: random.Random, n: int, pool: int = 400, stem: str = "w") -> list[str]:
    return [f"{stem}{rng.randrange(pool)}" for _ in range(n)]


def prose(rng: random.Random, n: int, stem: str = "w", line: int = 12) -> str:
    out = words(rng, n, stem=stem)
    return "\n".join(" ".join(out[i : i + line]) for i in range(0, n, line))


@pytest.fixture(scope="session")
def rows():
    """Texts of many kinds: copies, near copies, shared passages, nulls, empties, a very long one."""
    rng = random.Random(7)
    texts: list[str | None] = [None, "", " ", "\n\n", "one", "One", "two words", "a b c", "a b c", "A  B\tC", "é ü ß", "***", "x" * 400, "x" * 400, "ab " * 300]
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(25)]
    texts += base + base[:6] + [base[0]] * 4
    for text in base[:14]:
        for edits in (1, 2, 4, 9):
            own = text.split(" ")
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    passage = prose(rng, 60, "p")
    texts += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40) for _ in range(8)]
    texts.append(prose(rng, 20_000, "long"))
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s10", None]), len(t) if t and i % 3 else None))
    out += [out[20], out[20], (None, base[1], None, None, None), (None, None, None, None, None)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def wide(docs):
    """The same rows with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
