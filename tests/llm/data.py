"""Small tables with what large ones hold: nulls, empty and long texts, copies, repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    marks = ["", "", "", ".", ",", " ", "\n", "\t"]
    return " ".join(f"w{rng.randrange(vocabulary):x}é"[: rng.randrange(2, 6)] + rng.choice(marks) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    passage = words(rng, 70)
    texts: list[str | None] = [None, "", " \t\n", "one", "two words", words(rng, 3000, 5000), "ab" * 400]
    for i in range(n):
        text = words(rng, rng.randrange(5, 160))
        if i % 5 == 0:
            text = f"{text} {passage} {words(rng, 8)}"
        if i % 7 == 0 and texts[-1]:
            text = texts[-1]
        if i % 6 == 0 and texts[-1]:
            parts = texts[-1].split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        texts.append(text)
    texts += [texts[12]] * 5 + [passage + " " + passage]
    sources = ["a", "b", None, "a", "a", "ü"]
    rows = [(i * 3, t, "en", sources[i % 6], None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def odd_rows() -> list[tuple]:
    """Null and repeated ids, and rows that agree in all columns."""
    rows = documents(2, 20)
    return rows + [(None, rows[3][1], None, None, None), (None, "no id at all", None, "a", 1)] + [rows[4]] * 3 + [(rows[5][0], "other text", "en", "b", 2)]


def table(spark, rows, schema: str = SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)
