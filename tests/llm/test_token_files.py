import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessella.llm import _text as X
from tessella.llm import byte_ids, token_files

PATH = public_tokenizers.path(byte_ids.FILE)
PARTS = ["'s", "'re", "'ll", "'d", "''s", "'", "s", " ", "  ", "\n", "\t", "a", "Z", "é", "9", "²", ".", "!!", "\xa0", "\x85", "’", "漢", "😀", "ß", "\x1c", "​", " 's", "x'tes", "\r\n", "ǅ", "ª", "<|endoftext|>"]


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_are_the_librarys(texts):
    r = random.Random(1)
    own = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [t or "" for _, t in texts]
    encoder = byte_ids.load(PATH)
    ids, count = encoder.encode(*X.utf8(pa.array(own)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [e.ids for e in library().encode_batch(own, add_special_tokens=False)]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_ids, "REMEMBER", 5)
    encoder, t = byte_ids.Encoder(PATH), library()
    for text in ["one two three four five six seven", "eight nine one two", "one"]:
        assert encoder.encode(*X.utf8(pa.array([text])))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def slow_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert slow_crc(b"123456789") == 0xE3069283
    r = random.Random(2)
    runs = [bytes(r.randrange(256) for _ in range(n)) for n in (4, 5, 127, 128, 129, 255, 256, 1000, 8)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in runs])])
    assert token_files.crc32c(np.frombuffer(b"".join(runs), np.uint8), first).tolist() == [slow_crc(x) for x in runs]
    framed, size = token_files.frames(runs)
    places = np.cumsum(size) - size
    assert token_files.unframe(framed, places) == runs
    length, mask = struct.unpack_from("<QI", framed)
    crc = slow_crc(struct.pack("<Q", 4))
    assert (length, mask) == (4, (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF)
    broken = bytearray(framed)
    broken[14] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.unframe(bytes(broken), places)


def test_files(spark, odd_docs, tmp_path):
    t = library()
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()))
    folder, manifest = token_files.write(odd_docs, f"file://{tmp_path}/out")
    got = [tuple(r) for r in token_files.digests(spark, folder, manifest).orderBy("start").collect()]
    want, start = [], 0
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    lists = {(i, tuple(t.encode(x, add_special_tokens=False).ids + [0])) for i, x in rows}
    plain = [(r.doc_id, tuple(r.ids)) for r in token_files.read(spark, folder, manifest).collect()]
    mixed = [(r.doc_id, tuple(r.ids)) for r in token_files.read(spark, folder, manifest, shuffle=3).collect()]
    assert set(plain) == lists and sorted(mixed) == sorted(plain) and mixed != plain


def test_null_ids_and_empty(spark, odd_docs, tmp_path):
    df = spark.createDataFrame([(None, "x"), (2, None)], "doc_id long, text string")
    folder, manifest = token_files.write(df, f"file://{tmp_path}/a")
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_files.digests(spark, folder, manifest).orderBy("start").collect()] == [(None, 0, 2), (2, 2, 1)]
    folder, manifest = token_files.write(odd_docs.limit(0), f"file://{tmp_path}/b")
    assert token_files.digests(spark, folder, manifest).count() == 0
    assert token_files.read(spark, folder, manifest).count() == 0


def test_literals_of_added_tokens_are_what_the_library_makes_of_them(spark, tmp_path):
    own = ["a <|endoftext|> b", "plain", "<|endoftext|><|endoftext|> 漢", "<|endoftext", "|> x", "", "end<|endoftext|>"]
    t = Tokenizer.from_file(PATH)
    want = [t.encode(x, add_special_tokens=False).ids for x in own]
    ids, count = byte_ids.load(PATH, plain=False).encode(*X.utf8(pa.array(own)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want and want[0] == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    folder, manifest = token_files.write(docs, f"file://{tmp_path}/out")
    assert {r.doc_id: list(r.ids) for r in token_files.read(spark, folder, manifest).collect()} == {i: [*x, 0] for i, x in enumerate(want)}
