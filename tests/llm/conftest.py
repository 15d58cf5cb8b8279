import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use inside or return.
CLASHES = "n_words long, kept string, fail_bits long, runs string, epoch long, score double, doc string, tid long, spans long, node long, fp long, key string, list int"

PASSAGE = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, clashes=False):
        full = [(tuple(r) + ("en", "src1", None)[len(r) - 2 :])[:5] for r in rows]
        if clashes:
            n = len(CLASHES.split(", "))
            return spark.createDataFrame([r + (None,) * n for r in full], f"{SCHEMA}, {CLASHES}")
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def edge():
    """Nulls, empty and blank texts, a very long text, copies, a repeated row and a null id."""
    long_text = " ".join(f"long{i % 7000} tail{i % 13}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, PASSAGE), (5, PASSAGE), (6, "x " + PASSAGE + " y"), (7, "one"), (7, "one"),
        (8, "one two"), (None, PASSAGE), (9, long_text), (10, "é" * 60 + " ß " + "é" * 60), (11, "word " * 40), (12, "a\nb\na\n\na"),
        (13, PASSAGE, None, None), (14, "42 %% !!", "de", ""),
    ]
