import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, record string, `a.b` int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def build(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["host"] * len(texts) if sources is None else sources
        rows = [
            (i, t, None, s, None if t is None else len(t), f"r{k}", k)
            for k, (i, t, s) in enumerate(zip(ids, texts, sources, strict=True))
        ]
        return spark.createDataFrame(rows, SCHEMA)

    return build
