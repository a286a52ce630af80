"""Encoding, decoding and token files against the tokenizers library and exact round trips."""

import hashlib
import io
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cairnway.llm import bpe, token_files
from cairnway.llm.queries import QUERIES, TOKENIZERS, vocabulary

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(TOKENIZERS).exists(), reason="no vocabulary files")
ODD = [
    "", " ", "  a", "a  b", "a \n b\n", "don't stop'll we've", "x<|endoftext|>y <|endoftext|>", "\x1c\x1d a\x85b c",
    "naïve Σίσυφος ΣΑΣ 日本語のテキスト 🙂🙂 é İstanbul", "a" * 3000, "12345 67 ½ ²", "́x ́", "tab\tsep\r\nline",
    "'s 's'S 'RE", "ﬁ ﬀ  nbsp ​ zero", "<|startoftext|> <|endof text|>", "Ǆ ß ẞ ŉ", "aaaaaaaaab aab aaab" * 30,
]


def texts():
    rng = random.Random(5)
    alphabet = "abcdeABC  \n\t'.,!?éß漢字🙂0123<|>"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()


def test_bpe_equals_library():
    definition = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_str(definition), bpe.Bpe(definition)
    ids, ends = own.encode(pa.array(texts()))
    begin = 0
    for text, end in zip(texts(), ends, strict=True):
        assert ids[begin:end].tolist() == library.encode(text, add_special_tokens=False).ids, text
        begin = end
    assert own.decode(ids, ends) == [
        library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts()
    ]


def test_bpe_decode_of_broken_bytes():
    definition = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_str(definition), bpe.Bpe(definition)
    rng = random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(256) for _ in range(8)]
        assert own.decode(np.array(ids), np.array([8])) == [library.decode(ids, skip_special_tokens=False)]


def test_op9_query(spark, documents):
    library = Tokenizer.from_str(vocabulary("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r for r in QUERIES["op9_bpe"](spark, FOLDER).collect()}
    assert len(rows) == len(documents)
    for d in documents:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        assert rows[d["doc_id"]]["n_tokens"] == len(ids)
        assert rows[d["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert rows[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_pieces_equal_whole_texts():
    definition = vocabulary("word_bpe_49k.json")
    library, own = Tokenizer.from_str(definition), token_files.Encoder(definition, True)
    ids, ends = own.encode(pa.array(texts()))
    begin = 0
    for text, end in zip(texts(), ends, strict=True):
        assert ids[begin:end].tolist() == library.encode(text, add_special_tokens=False).ids, text
        begin = end


def test_words_in_rows_equal_words_alone():
    definition = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_str(definition)
    odd = ["", " ", "  ", "\0", "a\0b", "don't !'s ''ll 'd x' </w> w</w>", "\u0130stanbul \u00c5ngstr\u00f6m a\u030a",
           "<|endoftext|>", "a<|endoftext|>b <| |>", "12 3four\u00bd\t5\r\n6", "\u6f22\u5b57 kana", "\x07bell \x7f", "\u01c5 \u0149"]
    for rows in (odd, [t for t in odd if t.isascii()], odd[:3], odd[3:4], odd[7:8], odd * 3):
        for marked in (True, False):
            own = token_files.Encoder(definition, True)
            if not marked:
                own.closing[:] = False  # then every row is encoded word by word
            ids, ends = own.encode(pa.array(rows))
            for text, begin, end in zip(rows, [0, *ends[:-1]], ends, strict=True):
                assert ids[begin:end].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_op2_query(spark, documents):
    library = Tokenizer.from_str(vocabulary("word_bpe_49k.json"))
    rows = {r["doc_id"]: r for r in QUERIES["op2_token_files"](spark, FOLDER).collect()}
    start = 0
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        r = rows[d["doc_id"]]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def made(docs, wide=False):
    out = io.BytesIO()
    writer = token_files.Writer(out, wide)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, np.uint32))
    writer.close()
    return out.getvalue()


def test_reader_takes_only_asked_frames():
    docs = [(i, range(i % 7 * 3000)) for i in range(60)] + [(None, [1, 2])]
    reader = token_files.Reader(pa.BufferReader(made(docs)))
    opened, plain = [], reader.frame
    reader.frame = lambda k: opened.append(k) or plain(k)
    assert {i: ids.tolist() for i, _, ids in reader.documents({6, 7, 13})} == {i: list(range(i % 7 * 3000)) for i in (6, 7, 13)}
    assert 0 < len(set(opened)) < len(reader.table) - 1
    assert [i for i, _, _ in reader.documents()] == [i for i, _ in docs]


def test_damage_is_found_and_plain_tools_read_the_file():
    import zstandard

    data = made([(1, range(5000)), (2, range(70_000))], wide=True)
    whole = b""
    for chunk in zstandard.ZstdDecompressor().read_to_iter(io.BytesIO(data), read_size=1 << 16, write_size=1 << 16):
        whole += chunk
    assert np.frombuffer(whole, "<u4")[:5000].tolist() == list(range(5000))
    reader = token_files.Reader(pa.BufferReader(data))
    reader.table[0, 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        reader.frame(0)


def test_edges(spark, tmp_path):
    rows = [(3, "b", "x"), (None, None, "y"), (3, "a a", "z"), (3, "a a", "z"), (1, "", "w"), (2, "q " * 90_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    definition = vocabulary("word_bpe_49k.json")
    manifest = token_files.write_token_files(docs, definition, f"file://{tmp_path}/a", 2, pieces=True)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 3]
    assert [len(r["ids"]) // 4 for r in got] == [1, 1, 90_001, 3, 3, 2]
    assert token_files.read_token_files(
        token_files.write_token_files(docs.limit(0), definition, f"file://{tmp_path}/b")
    ).collect() == []
    encoded = bpe.encode(docs, vocabulary("byte_bpe_50k.json"))
    assert bpe.decode(encoded, vocabulary("byte_bpe_50k.json")).where("n_tokens = 0").count() == 2
    assert bpe.encode(docs.limit(0), vocabulary("byte_bpe_50k.json")).collect() == []
