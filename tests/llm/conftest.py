import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string, row string, h long, body string, size int, page_content string"
CLASHES = (None, "x", None, 7, "b", 3, "p")


def make_rows(seed: int = 5, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages and lines, nulls, empty and very long texts, and repeated rows."""
    rng = random.Random(seed)
    vocab = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(60)] for k, a in {"en": "theandofirs", "fr": "éleauxquoi", "de": "erungschäö"}.items()}
    passage = " ".join(rng.choices(vocab["en"], k=35))
    line = "  This line is found Everywhere, more or less\t"
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr", "de"])
        words = rng.choices(vocab[lang], k=rng.randint(1, 160))
        if i % 4 == 1:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        text = " ".join(w + rng.choice(["", "", "", "\n", ",", " "]) for w in words)
        if i % 3 == 0:
            text = f"{text}\n{line if i % 2 else line.upper()}\nshort\n"
        if i % 7 == 3:
            text = rows[i - 2][1]
        if i % 9 == 5 and rows[i - 1][1]:
            text = rows[i - 1][1] + " and one word more"
        if i % 20 == 8:
            text = None
        if i % 20 == 9:
            text = ""
        if i % 20 == 10:
            text = " \n \n!!! 123"
        rows.append((i * 3 % 61, text, lang if i % 11 else None, rng.choice(["b", "a", "ç", None]), len(text or ""), *CLASHES))
    rows.append((500, passage * 400, "en", "a", 1, *CLASHES))
    rows.append((501, "ab" * 3000 + " " + "x y " * 2000, "en", "a", 1, *CLASHES))
    rows += [rows[4], rows[4], rows[8]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
