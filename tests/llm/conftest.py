import pytest

WORDS = "the of and river stone cloud garden window market silver morning paper bridge light harbor winter".split()


def prose(seed: int, n: int = 120) -> str:
    """n words in lines that end with a full stop, the same for a seed."""
    import random

    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(["", "s", "ing", str(rng.randint(0, 999))]) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + 12]).capitalize() + "." for k in range(0, n, 12))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, row long, part long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) with columns whose names clash with what operators add."""

    def documents(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, 1, 2, 3) for i, t in rows], SCHEMA)

    return documents


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a null id, repeated rows, a very long text, one endless word, blanks only."""
    long = "\n".join(prose(k, 600) for k in range(40))
    return [(1, prose(1)), (2, None), (3, ""), (None, prose(2)), (4, prose(3)), (4, prose(3)), (5, prose(1)), (6, long), (7, "x" * 50_000), (8, " \t\n \x0b"), (9, "é" * 10 + " <|endoftext|> \x1c\x85 end")]
