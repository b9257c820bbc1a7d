import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n, size=400):
    return " ".join(f"{'abcdefghij'[r.randint(0, 9)]}{r.randint(0, size)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with near and exact copies, shared passages, nulls, empty and long texts, ties, repeated rows and null ids."""
    r = random.Random(4)
    base, shared = words(r, 120), words(r, 80)
    rows = [[i, words(r, r.randint(60, 200)), "en", f"src{i % 3}"] for i in range(30)]
    for i in range(30, 44):  # near copies at different distances
        w = base.split()
        for _ in range(r.randint(0, 8)):
            w[r.randint(0, len(w) - 1)] = f"x{i}"
        rows.append([i, " ".join(w), "fr", "src1"])
    rows += [[i, base, "fr", "src1"] for i in (50, 47, 49)]
    rows += [[i, f"{words(r, 30)}\n{shared}\n{words(r, 20)}", "de", "src2"] for i in range(60, 66)]
    rows += [[70, None, None, None], [71, "", "en", "s"], [72, "   \n\t ", "xx", "s"], [73, "one two", "en", "s"], [74, "ONE two", "en", "s"], [75, "a b c d e f", "en", "s"]]
    rows += [[80, words(r, 4000), "es", "s"], [81, "aaaa " * 600, "es", "s"], [82, "é日🙂ß " * 90, "en", "s"], [83, "é日🙂ß " * 90 + "end", "en", "s"]]
    rows += [rows[3], [None, words(r, 90), "en", "s"], [None, base, None, "s"]]
    rows += [[90, f"mail bob.x@host-1.example.com, ip 10.0.0.255 or 999.1.1.1 {words(r, 60)}", "en", "s"], [91, "card 4111 1111 1111 1111 call +1 (555) 555-1234 " + words(r, 60), "en", "s"]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
