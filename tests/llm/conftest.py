import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, fp string, kept string, n int, pii_spans int, length string, row int"


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty, blank, long and odd texts, ties and repeats."""
    long = ("alpha beta gamma delta " * 9000) + "tail@example.org"
    return [
        None, "", " \t\n", "word", "Word word", "a  b\tc", "a b c", "a\nb\x0bc", long, long, long + " x",
        "Mail jo.doe+x@mail.example.co.uk, or call +1 (415) 555-0100 now. a@b.c_d@e.f.g",
        "ip 10.0.0.255 and 999.1.1.1 and 1.2.3.4.5.6.7.8 0001.02.3.4", "card 4111 1111 1111 1111 and 4111-1111-1111-1112; 79927398713",
        "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33; ssn 123-45-6789, 987-65-4321",
        "9" * 3000, "1 " * 20000, "x" * 200000, " " * 50000, "<|endoftext|>the end<|startoftext|> 's it's",
        "Ünïcödé ÇA va? naïve é   emoji \U0001f600 日本語 İstanbul ΣΣ",
        "Released under the MIT License.", "code. licensed under the apache license, version 2.0. more", "the same near copy of a text that goes on for some words",
        "the same near copy of a text that goes on for some words", "12345 !!! ???", "+1+2+3 @@@ ..@..", "0 0 0 0 0 0 0 0 0 0 0 0",
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids in no order, a null lang and source, and columns whose names clash with inner ones."""
    rows = [(i * 7 % 101, t, None if i % 5 == 0 else ("en", "fr", "de", "es")[i % 4], None if i % 3 == 0 else "src0", 1, i, "x", None, 0, 0, "l", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
