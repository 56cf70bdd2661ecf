import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomkv.llm import token_files, tokens

SF = "/root/testdata/sf0.01"


def encoded(coder, texts):
    """A list of ids for each text."""
    ids, counts = coder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    assert len(ids) == counts.sum()
    return [ids[b - n : b].tolist() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_the_whole_text(name, monkeypatch):
    import pyarrow.parquet as pq

    coder = tokens.Encoder(tokens.tokenizer_path(name))
    texts = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:300]
    texts += ["", None, " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "x\n y", "x \ny", "tab\tb", "don't\nwe'll", "a\xa0b", "é ́x", "<|endoftext|> a <|endoftext|>", "ΑΣ ΣΑΣ\nİx", "a\x1cb", "a　b c", "q\r\nr", "z" * 500 + " z", "a×b÷c", "Привет мир 中文 字", "x\n\n\ny", "  lead", "'tis 's don't,'s", "very long text, 12 'words' é\n" * 30_000]
    whole = coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    want = [x.ids for x in whole]
    assert encoded(coder, texts) == want and encoded(coder, texts) == want
    assert encoded(coder, texts[3:])[4:] == want[7:] and encoded(coder, []) == []
    # a cache that starts anew after each batch, and texts cut a few at a time
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    monkeypatch.setattr(tokens, "STEP_BYTES", 300)
    assert encoded(tokens.Encoder(tokens.tokenizer_path(name)), texts) == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="aZÉßÅĲ' \n\t.,!?1é\u0301\x1f\xa0\x01×\0", max_size=12), max_size=5))
def test_pieces_of_odd_texts(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        coder = tokens.encoder(tokens.tokenizer_path(name))
        whole = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert encoded(coder, texts) == [x.ids for x in whole]


@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano_select(steps):
    values = np.cumsum(np.array(steps, np.int64))
    code = token_files.EliasFano(len(values), *token_files.EliasFano.of(values).parts())
    assert code.select(np.arange(len(values))).tolist() == values.tolist()
    assert code.select(np.arange(len(values))[::-7]).tolist() == values[::-7].tolist()
    for beyond in (-1, len(values)):
        with pytest.raises(IndexError):
            code.select(np.array([beyond]))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 100_000))
    assert sum(map(len, token_files.EliasFano.of(values).parts()[1:])) * 8 < 100_000 * (2.5 + np.log2(values[-1] / 100_000))


def test_files_read_back(spark, tmp_path):
    rows = [(i, f"word{i} " * (i % 9), "x") for i in range(-3, 40)] + [(None, None, "x"), (None, "nameless", "x"), (7, "again", "y"), (7, "again", "y"), (1 << 62, "long " * 900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    path = tokens.tokenizer_path("word_bpe_49k.json")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        token_files.write_token_files(docs, f"file://{tmp_path}/f", path, parts=3, block_ids=50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, f"file://{tmp_path}/f").collect())
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [x[1] for x in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    whole = [[*x, 2] for x in encoded(tokens.encoder(path), [t for _, t, _ in rows])]
    want = [(d is not None, d or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _, _), x in zip(rows, whole, strict=True)]
    assert sorted((d is not None, d or 0, n, crc) for _, d, n, crc in got) == sorted(want)
    blocks = [x.asDict() for x in spark.read.parquet(f"file://{tmp_path}/f").orderBy("part", "block").collect()]
    assert len(blocks) > 6 and [i for x in blocks for i in token_files.block_documents(x)[3].tolist()] and {x["id_bytes"] for x in blocks} == {2}


def test_width_follows_the_vocabulary(spark, tmp_path):
    assert (token_files.id_width(65_536), token_files.id_width(65_537)) == (2, 4)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    token_files.write_token_files(docs, f"file://{tmp_path}/w", tokens.tokenizer_path("word_bpe_49k.json"), end_id=70_000)
    (x,) = spark.read.parquet(f"file://{tmp_path}/w").collect()
    assert x.id_bytes == 4 and token_files.block_documents(x.asDict())[3].tolist()[-1] == 70_000


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(docs, f"file://{tmp_path}/e", tokens.tokenizer_path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0
