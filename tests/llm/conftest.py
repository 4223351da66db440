import pytest

COLUMNS = ("doc_id long, text string, source string, lang string, n_chars long, row string, rank long, slice int, size long, "
           "n_words long, spans string, items string, keep string, n_removed string, n_pseudonyms string, host string, node long, quality string, "
           "_ long, _host string, _path string, _id long, _node long, _own long, row_ string, `my col` string, `a.b` string, `b``c` long, c0 string, none long")
PASSAGE = ("The river runs past the old mill and the long wall. Two men stand there and look at the water all day. "
           "Nobody knows what they wait for, and nobody asks them. In the evening they walk home by the upper road.")


def row(doc_id, text, source="a"):
    return (doc_id, text, source, "en", len(text or ""), "x", 1, 1, 1, 1, "x", "x", "x", "x", "x", "x", 1, "x",
            7, "h", "p", 8, 9, 10, "r", "m", "d", 11, "c", 12)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs, empty and very long texts, repeated rows, equal texts, and names that operators use themselves."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [row(1, PASSAGE), row(2, PASSAGE + " And then it rained."), row(3, None), row(3, None), row(4, ""), row(None, "no id here"),
            row(None, None, None), row(5, long), row(6, "a"), row(6, "a"), row(7, "a b c d"), row(8, "  \n\t "), row(9, PASSAGE.upper())]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
