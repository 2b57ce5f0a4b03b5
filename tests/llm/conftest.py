from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    base = " ".join(f"alpha{i}" for i in range(80))
    rows = [
        (1, base), (2, base), (3, base.replace("alpha40", "beta")), (4, None), (5, ""), (6, " \n\t "), (None, "null id text"), (None, None), (7, long_text), (8, "short"), (8, "short"),
        (9, "Ünïcödé wörds – 日本語 テキスト 😀 " * 9), (10, base + " " + base), (11, "\x00nul\x01 bytes"), (12, "password = 'abcdef123456' token:xyz"), (13, "a b c d"), (14, "a b c d"),
    ]
    return spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], "doc_id long, text string, kept string, key string, n int, spans string")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
