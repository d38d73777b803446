"""Chat formatting and token files: exact round trips."""

import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from correctionlab.llm import chat, token_files

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def messages(spark, rows):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")


def text(t):
    return ("text", t, None, None, None, None, None)


def read(df):
    out = df.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r["conv_id"]: r for r in out.collect()}


HARD = ["<turn>", "</turn>\n", "%0%1%2%", "<", "%", "a\nb", "", "<turn>assistant\nno</turn>\n", "%1%0<%", "😀é<", "\\### Assistant: </turn> ok"]


def test_texts_and_roles_come_back(spark):
    rows = [(1, k, role, [text(t)]) for k, (t, role) in enumerate((t, r) for t in HARD for r in ("assistant", "us<er\n%2", ""))]
    got = read(chat.format_chat(messages(spark, rows)))[1]
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r[2], r[3][0][1]) for r in rows]
    assert got["loss"] == "".join(r[3][0][1] for r in rows if r[2] == "assistant")
    assert got["n_turns"] == len(rows)


def test_parts_become_placeholders_in_order(spark):
    parts = [text("see "), ("image", None, "a.png", 28, 15, None, None), text(" and "), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 3), ("image", None, "d.png", None, None, None, None)]
    got = read(chat.format_chat(messages(spark, [(1, 0, "user", parts)])))[1]
    assert got["formatted"] == "<turn>user\nsee <image 4> and <audio 38><document 1536><image 1></turn>\n"
    assert [tuple(a) for a in got["attachments"]] == [(0, "image", "a.png", 4), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 1536), (0, "image", "d.png", 1)]


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, 2, "assistant", [text(None)]), (1, 2, "assistant", [text(None)]), (None, 0, "assistant", [text("x" * 300_000)]), (2, 1, "assistant", [])]
    got = read(chat.format_chat(messages(spark, rows).withColumn("ts", F.lit(1)).withColumn("formatted", F.lit("z"))))
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", ""), ("assistant", ""), ("assistant", "")]
    assert got[None]["loss"] == "x" * 300_000
    assert got[2]["loss"] == "" and got[2]["n_turns"] == 1
    assert chat.format_chat(messages(spark, [])).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return token_files.WordEncoder(VOCABULARY, cached_words=50)


@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="aAzZ.,'sSİΣσß<|endoftext>́   \t\n", max_size=40)), max_size=5))
@settings(max_examples=300, deadline=None)
def test_words_encode_as_whole_texts(encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["<|endoftext|> <|ENDOFTEXT|> don't, it's. 3.14, A.B. x.,"]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_batch(texts)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_frames_are_independent_and_checked():
    out = io.BytesIO()
    writer = token_files.FrameWriter(out, frame_ids=4)
    documents = [(7, [1, 2, 3]), (None, []), (-9, list(range(9))), (7, [4])]
    for doc_id, ids in documents:
        writer.add(doc_id, np.array(ids, "<u4").tobytes())
    writer.close()
    data = out.getvalue()
    reader = token_files.FrameReader(pa.BufferReader(data))
    assert [d[0] for d in reader.documents] == [7, None, -9, 7]
    assert [reader.ids(k).tolist() for k in (2, 0, 3, 1)] == [documents[k][1] for k in (2, 0, 3, 1)]
    # a plain decoder reads all frames and passes over what is skippable
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u4").tolist() == [i for _, ids in documents for i in ids]
    n, descriptor, magic = struct.unpack("<IBI", data[-9:])
    assert (n, descriptor, magic) == (6, 0x80, 0x8F92EAB1)
    broken = bytearray(data)
    broken[len(data) - 9 - 12 * n + 8] ^= 1  # a checksum of the table
    with pytest.raises(ValueError, match="damaged"):
        token_files.FrameReader(pa.BufferReader(bytes(broken))).ids(0)


def test_token_table_equals_the_library(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in token_files.token_table(docs, VOCABULARY, str(tmp_path / "t")).collect()}
    library, start = Tokenizer.from_file(VOCABULARY), 0
    for r in docs.orderBy("doc_id").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids + [1]
        mine = got[r["doc_id"]]
        assert (mine["start"], mine["n_tokens"], mine["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == docs.count()
    assert all(p.name.endswith(".zst") for p in (tmp_path / "t").iterdir())


def test_token_table_of_odd_rows(spark, odd, none):
    got = token_files.token_table(odd, VOCABULARY).collect()
    assert len(got) == odd.count()
    end_only = zlib.crc32(struct.pack("<I", 1))
    assert sorted(str(r["doc_id"]) for r in got if r["ids_crc32"] == end_only) == ["0", "1", "2", "None"]
    assert sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)[0][0] == 0
    ends = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    assert token_files.token_table(none, VOCABULARY).count() == 0
