import pytest
from text_maker import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, shard int, h string, doc string, fp binary, mark string, t string, spans string, license string, sequence_id long, kd_h long, mix_rate double, sd_mark string, sd_id long, sd_spans string, own_mark long, own_doc long, own_spans string, node string, root string"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns that clash with the operators' own."""
    shared = words(120, 7)
    texts = ["", None, "a", "two words", "   \n\t ", words(60_000, 1), "x" * 300_000, shared, shared, shared + " end", words(30, 2) + " " + shared, "É" * 700, "<|endoftext|> in a text", words(300, 3)]
    rows = [(i, t, "en" if i % 2 else None, "s0" if i % 3 else None, len(t or "") if i % 4 else None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[13], (None, shared, None, None, None), (None, None, None, None, None), (13, "same id, other text", "de", "s1", 3), (-1, shared, "en", "s0", 1), (-1, None, None, "s1", None)]
    extra = (0.5, True, 3, "h", "d", b"f", "m", "t", "s", "l", 9, 1, 0.1, "m", 2, "s", 3, 4, "s", "n", "r")
    return spark.createDataFrame([(*r, *(extra if i % 2 else (None,) * len(extra))) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
