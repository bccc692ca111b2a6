import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def words():
    """A supply of invented words, the same every time."""

    def make(n, seed=1):
        parts, out, x = ["an", "ther", "or", "the", "in", "est", "al", "ou", "ver", "io", "ch", "da"], [], seed
        for _ in range(n):
            x = (x * 1103515245 + 12345) % (1 << 31)
            out.append(parts[x // 7 % 12] + parts[x // 1009 % 12] + parts[x // 77777 % 12])
        return out

    return make


@pytest.fixture
def docs(spark):
    """Make documents of (doc_id, text) rows, with columns whose names clash with those the operators use."""
    clashes = "ids chunk word n score found range digest sketch rep node cluster blocks shingles held_out line licence edited".split()

    def make(rows, lang=None):
        df = spark.createDataFrame([(d, t, (lang or {}).get(d)) for d, t in rows], "doc_id bigint, text string, lang string")
        return df.selectExpr("*", "'src1' as source", *[f"'clash' as {c}" for c in clashes])

    return make


@pytest.fixture(scope="session")
def awkward(words):
    """Null, empty and blank texts, ties, repeated rows, odd characters, a null id and a very long text."""
    prose = " ".join(words(60, 3))
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, prose), (5, prose), (5, prose), (6, "ab"), (7, "ß é́ 日本語 \U0001f600 ▁ x  y\r\n z"),
        (8, "\x00\x1f !?."), (9, " ".join(words(30_000, 4))), (None, prose), (None, None), (10, "a" * 30_000), (11, prose + " again"),
        (12, "<|endoftext|> <s> </s> <0x41> \n\n<|endoftext|>"), (20, prose[: len(prose) // 2]),
    ]


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF
