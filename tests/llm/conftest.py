import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text, source), with extra columns whose names operators might use themselves."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 1, "x", None) for i, t, s in rows]
        return spark.createDataFrame(full, DOCUMENTS + ", score int, _hits string, rank int")

    return make


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
