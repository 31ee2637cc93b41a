"""Every registered query of this subpackage over the smallest tables."""

import pytest

from lodestream.llm import bpe, queries
from tests.queries import SF_DIR, check, connection

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    check(spark, con, queries.QUERIES[name], queries.ORACLE_SQL.get(name))


def test_ids_are_those_of_the_library(spark, con):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.VOCABULARY.replace(".tiktoken", ".json")
    library = tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rows = con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    want = {i: e.ids for (i, _), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False))}
    assert {r.doc_id: list(r.ids) for r in queries.p8_ids(spark, str(SF_DIR)).collect()} == want
