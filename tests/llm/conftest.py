from __future__ import annotations

import pytest

#: Texts that every operator must take: null, empty, white space, a repeated row, a long word, a long text.
AWKWARD = [None, "", " \n\t ", "one", "one", "x" * 5000, "word " * 4000, "Ünïcode 日本語 😀 text", "a b c d e f g h i j k l m n o p"]


@pytest.fixture
def awkward(spark):
    """Documents with awkward texts, null ids and extra columns that carry names the operators use."""
    rows = [(i, t, "en", "s", i, "x", 1.0, True) for i, t in enumerate(AWKWARD)] + [(None, "no id here at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double, found boolean")


@pytest.fixture
def empty(awkward):
    return awkward.limit(0)
