import os

import pytest

from lexspark.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no vocabulary here")

TEXTS = ["", " ", "Madde 5 – (1) Kira sözleşmesi yazılı yapılır.\n\n  a) Bedel,", "<|endoftext|> I'll don't", "👩‍⚖️ əğer çox", "ab" * 3000, "\t\n  x  ", "１２３ ﬁ ²½", None]


def test_ids_match_the_library_and_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.TOKENIZER)
    library.encode_special_tokens = True
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.token_ids(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted((r["doc_id"], r["ids"]) for r in out.collect())
    want = sorted((i, library.encode(t, add_special_tokens=False).ids if t else []) for i, t, _ in rows)
    assert got == want
    back = out.select("doc_id", bpe.decoded(out.ids).alias("text"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted((i, t or "") for i, t, _ in rows)
    counts = {(r["doc_id"], r["n_tokens"]) for r in bpe.token_counts(df).collect()}
    assert counts == {(i, len(x)) for i, x in want}


def test_empty_table(spark):
    assert bpe.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
