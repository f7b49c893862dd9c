import os
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from helpers import AWKWARD, docs
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from ledgerloom.llm import tokens
from ledgerloom.llm.token_files import TokenFiles, token_digests, write_token_files
from ledgerloom.llm.tokens import slices, tokenizer

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", "  a  b", "a\n\nb c", " x", " ", "a \n b", "don't  we'll 's", "x\x1cy z", " a b　c", "é ́e", "a\tb c\r\nd", "<|endoftext|> a", "Σας ΣΑΣ  İ", "a\x85 b", "x  ", "plain text, yes.\nAnd more", "one\x0btwo \x0b three", "a½ ½ b 7 ²7 ³", "½", "  ½  7", "Ġa Ġ b"]


def library(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_give_the_librarys_ids(path):
    for texts in (ODD, ["plain text, yes", "don't we'll"], [x + " word " + x for x in ODD]):
        ids, at = tokenizer(path).encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == library(path, texts)


def test_ids_of_slices():
    texts = [f"Text {i} É  word{i % 7}\nand more" for i in range(50)]
    for path in (BYTES, WORDS):
        ids, at = tokenizer(path).encode(pa.array(texts).slice(20, 10))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == library(path, texts[20:30])


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_beyond_those_kept(path, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 20)
    coder = tokens.ChunkTokenizer(path)
    for k in range(3):
        texts = [f"w{i * 7 % 50}x{k} ½ word{i} , e\u0301{i}" for i in range(1500)]
        ids, at = coder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == library(path, texts)


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c"]})
    assert [s.num_rows for s in slices(batch, characters=12)] == [2, 1, 2]


def ordered(rows):
    signed = lambda t: int(np.array(xxh64_intdigest(t.encode(), 42), np.uint64).view(np.int64))
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1]))


def test_round_trip(spark, tmp_path):
    rows = AWKWARD + [(100 + i, f"text number {i} with words") for i in range(50)]
    files = write_token_files(docs(spark, rows, start="clash").repartition(4), str(tmp_path / "t"), BYTES, 2)
    want = [ids + [2] for ids in library(BYTES, [t for _, t in ordered(rows)])]
    again = TokenFiles(str(tmp_path / "t"))
    assert len(again) == len(rows) and files.manifest["tokens"] == sum(map(len, want))
    assert [again[k].tolist() for k in range(len(again))] == want
    assert again[0].dtype == np.uint16 and sum(os.path.getsize(tmp_path / "t" / x) for x in os.listdir(tmp_path / "t") if x.endswith(".bin")) == 2 * sum(map(len, want))
    with pytest.raises(IndexError):
        again[len(again)]


def test_digests(spark):
    got = sorted(map(tuple, token_digests(docs(spark, AWKWARD), BYTES, 2).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in ordered(AWKWARD):
        ids = library(BYTES, [t])[0] + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_digests(docs(spark, []), BYTES, 2).count() == 0


def test_rows_without_ids_fill_many_parts(spark, tmp_path):
    rows = [(None, f"text {i}") for i in range(2000)] + [(7, "last")]
    files = write_token_files(docs(spark, rows), str(tmp_path / "t"), BYTES, 2)
    sizes = [p["documents"] for p in files.manifest["parts"]]
    assert sum(sizes) == 2001 and len(sizes) > 4 and max(sizes) < 800
    want = [ids + [2] for ids in library(BYTES, [t for _, t in ordered(rows)])]
    assert [files[k].tolist() for k in (0, 1000, 2000)] == [want[k] for k in (0, 1000, 2000)]
