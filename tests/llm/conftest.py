import pytest

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their".split()


def prose(n, seed):
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] + str((seed + i // 5) % 17) for i in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, blanks, copies, near copies, shared passages, odd white space and a very long one."""
    base = {i: prose(30 + 17 * i, i) for i in range(12)}
    long = prose(6000, 99)
    shared = prose(40, 500)
    out = dict(base)
    out |= {20: base[3], 21: base[3], 22: base[11].replace(" ", "\n", 1), 23: base[11] + " tail", 24: "Head " + base[11]}
    out |= {30: f"{prose(20, 60)} {shared} {prose(20, 61)}", 31: f"{shared} {prose(10, 62)}", 32: f"{prose(5, 63)}\n\n{shared}\n\n"}
    out |= {40: None, 41: "", 42: " \t\n ", 43: "one", 44: "one two", 45: "one  two", 46: "a " * 80, 47: "Ünïcödé 漢字 ğ ! # $ %% && || <> <b>\r\nline\x0bline", 48: "x\ny\nx\n \nx\n"}
    out |= {50: long, 51: long + " end", 52: "ABC def\xa0ghi jkl", 53: "<|endoftext|> a  b   c\t\td", 54: "--- !!! ..."}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names clash with the operators' own."""
    rows = [(i, t, "en", None, -1, "x", 1) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, n bigint").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
