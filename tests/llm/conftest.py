import pytest


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def texts():
    """Texts with every odd case: null, empty, white space runs, other scripts, special strings, very long ones."""
    return [None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \n\nb", "\n", "a\tb", "a b",
            "it's they'll I'D", "12 345 ½x ², ok!!", "<|endoftext|>", "x <|endoftext|> y<|startoftext|>", "éàß Ünï Àa",
            "İstanbul ſ K", "日本語 текст", "é ä", "🙂 🙂🙂", "\x00\x1f \x7f", "word " * 3000,
            "z" * 30_000, "the cat sat on the mat " * 200, "one, two. three!\nfour; five\n\n\nsix  seven"]


@pytest.fixture(scope="session")
def odd_documents(spark, texts):
    """The texts as a table with repeated rows, a null id and extra columns whose names clash with working names."""
    rows = [(i, t, "en", "src0", len(t or ""), i, "x") for i, t in enumerate(texts)]
    rows += [rows[4], rows[24], (None, "null id", None, None, None, None, None), (4, "same id", "en", "s", 7, 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "`row_id` long, `a.b` string").repartition(3)
