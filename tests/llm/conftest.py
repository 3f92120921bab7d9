import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "river stone light garden window paper silver morning winter music copper letter forest bridge candle market".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 16) % len(WORDS)] + ("s" if x & 4096 else ""))
    return " ".join(out)


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and wordless texts, repeated rows, equal ids, one very long text."""
    rows = [(i, prose(i, 20 + 7 * (i % 9)), "en", f"s{i % 3}", 100) for i in range(1, 40)]
    rows += [(50, "", "en", "s0", 0), (51, None, None, None, None), (None, "no id at all", "en", None, 12), (None, None, None, "s1", None)]
    rows += [(52, " \t\r\n \x0b\x0c", "en", "s1", 6), (53, prose(5, 60), "en", "s2", 1), (53, prose(5, 60), "en", "s2", 1), (54, "one", "en", "s2", 3)]
    rows += [(55, prose(9, 6000), "en", "s0", 1), (56, "Ünïcödé   word\u2003here Ａ '\x1c' <|endoftext|> don't 123", "de", "s0", 1), (57, prose(5, 60) + " stone", "en", "s1", 1)]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(documents):
    """Columns that operators might want to add themselves."""
    names = ["length", "_bucket", "size", "score", "predicted", "fp", "component_id", "_key", "copies", "rid", "piece", "h", "label", "key"]
    return documents.selectExpr("*", *[f"'x' as {n}" for n in names])


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
