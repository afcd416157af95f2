import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
#: Names that operators use inside.
CLASHING = ["row", "fp", "words", "lines", "label", "score", "at", "bucket", "text_hash", "id", "nth", "found_id"]


def prose(n: int, seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ing"]) for _ in range(n))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    one = prose(80, 1)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, one), (5, one), (6, one + " tail"), (6, one + " tail"), (None, one),
        (None, None), (7, "\n".join([one, "Licence line", "", "  licence LINE "])), (8, "<|endoftext|>a<|endoftext|>"),
        (9, "x" * 40_000), (10, " " * 20_000), (11, prose(9_000, 2)), (12, "中文 字符 " * 300), (13, "é \x1c \x85 İ ΣΑΣ '’s"),
        (14, "one two"), (15, "A\r\nB\x0bC\n"), (16, "\n\n\n"),
    ]
    return rows + [(20 + i, f"Licence line\n{prose(30, 100 + i)}\n\tlicence line") for i in range(10)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        data = [(i, t, None, "s" if i else None, len(t) if t else None) for i, t in rows]
        if extra:
            schema += "".join(f", {c} string" for c in CLASHING)
            data = [(*d, *["clash"] * len(CLASHING)) for d in data]
        return spark.createDataFrame(data, schema)
    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    return make_docs(awkward_texts()).repartition(3)
