import zlib

import numpy as np
import pytest

from condist.llm import token_files
from condist.llm.scratch import shared_path
from condist.llm.tokens import default_tokenizer, encoder


def truth(texts):
    tk, at, out = encoder(default_tokenizer()).tokenizer, 0, []
    for doc_id in sorted(texts):
        ids = [*tk.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert sorted(map(tuple, token_files.op4_token_files(spark, d).collect())) == truth(texts)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_edges_and_selective_reads(spark, encoding):
    texts = {9: None, 2: "", 3: "word " * 30000, -4: "tie", 5: "tie", 6: "a <|endoftext|> b"}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, shard int").repartition(3)
    path = shared_path(spark, "tokens")
    token_files.write(df, path, encoding=encoding)
    got = token_files.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == truth(texts)
    assert [(r.doc_id, list(r.ids)) for r in token_files.documents(spark, path, 2, 2).collect()] == [(2, [2])]
    meta = token_files.metadata(spark, path)
    assert "ids" not in meta.columns and meta.count() == 6


def test_repeated_null_and_empty(spark):
    path = shared_path(spark, "tokens")
    token_files.write(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), path)
    assert sorted(r.start for r in token_files.read(spark, path).collect()) == [0, 2, 4]
    path = shared_path(spark, "tokens")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_files.read(spark, path).collect() == []
