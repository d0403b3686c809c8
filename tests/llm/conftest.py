import pytest

#: Texts that any operator must take: empty, blank, long, odd white space, other scripts, control strings.
ODD = [
    None, "", " ", "\n", "\n\n \t", "a", "  a  b\n\n c ", "a \n b\r\n\tc\x1cd e f\u0085g", "don't we'll I'VE 'S",
    "é́ ̈x ﬁ Ǆ İstanbul ΑΣ ς σ", "日本語のテキスト、改行\nなし。", "<|endoftext|> </s> [INST]", "x" * 5000, "ab " * 3000, "😀😀 1234567 ½ ² ٣",
    "a \n", "\n a", "a  ", " \na", "tab\tsep \t x", "mixed\n\nblank\n \nline", " line sep ", "\x00nul\x01 \x1f",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, repeated rows and ids, and columns whose names operators use themselves."""
    rows = [(i, t, "n/a", -1, "x") for i, t in enumerate(ODD)]
    rows += [(3, "again", "n/a", -1, None), (3, "again", "n/a", -1, None), (None, "no id", None, None, None), (None, None, None, None, None)]
    schema = "doc_id long, text string, ids string, start int, kept string"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
