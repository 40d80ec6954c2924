import os
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loopweave.llm import token_records as tr

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(7, "Hello, world!"), (3, None), (5, ""), (5, "again  twice\n\tx "), (None, "no id"),
        (900, "été 漢字 😀 it's <|endoftext|> 12345 "), (1, "word " * 40_000), (7, "Hello, world!")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_pieces_encode_like_the_whole_text(tokenizer, rnd):
    encoder = tr.Encoder(tokenizer.to_str(), 2)
    signs = "ab Z'sl9 0.,!\n\t\r\x0b\x1c\x1d\x85\xa0 　​é漢字😀ſ\0 "
    for i in range(4000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.choice([0, 1, 2, 5, 12, 40])))
        text += "<|endoftext|> x" * (i % 50 == 0)
        want = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == want, repr(text)


def expected(tokenizer, rows):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(table, tokenizer):
    docs = table("doc_id long, text string, shard string", [(*r, "x") for r in ROWS], 4)
    got = sorted(map(tuple, tr.tokenized(docs, PATH).collect()), key=lambda r: r[1])
    assert got == expected(tokenizer, ROWS)


def test_an_index_finds_each_record_in_its_file(table, tokenizer):
    index = tr.write_records(table("doc_id long, text string", ROWS), PATH)
    for r in index.collect():
        with open(os.path.join(index.records_at, r.file), "rb") as f:
            f.seek(r.offset)
            payload = tr.unframe(f.read(r.size))
        doc, flags = struct.unpack_from("<qB", payload)
        assert (flags & 127, None if flags & 128 else doc) == (2, r.doc_id)
        assert len(payload) == 9 + 2 * r.n_tokens
    names = {r.file for r in index.collect()}
    assert set(os.listdir(index.records_at)) - {f".{n}.crc" for n in names} == names


def test_damage_is_noticed():
    record = bytearray(tr.frame(b"payload"))
    assert tr.unframe(bytes(record)) == b"payload"
    for at in (0, 9, 14, len(record) - 1):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            tr.unframe(bytes(broken))


def test_empty_table(table):
    assert tr.tokenized(table("doc_id long, text string", []), PATH).count() == 0


def test_pieces_are_known_by_the_words_of_the_text(tokenizer):
    """No copy of a word with its space before it; a word after a space is not one without."""
    encoder = tr.Encoder(tokenizer.to_str(), 2)
    letters = "".join(map(chr, range(0xC0, ord(tr.FIRST_RARE))))
    for text in ("the cat, the.", ",the", " the", "the  the", ". .", "", " ", f"a {letters} {letters}!",
                 " ".join(map(chr, range(0x250))), "the\n the", "é é. \u00a0 é", "the, the ,"):
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        for _ in range(2):  # made, then remembered
            assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == want, repr(text)
    assert "cat" in encoder and " cat" not in encoder


def test_a_worker_keeps_its_encoder_and_two_generations(monkeypatch):
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).to_str()
    one = tr.encoder_of(vocabulary, 2)
    assert tr.encoder_of(vocabulary, 2) is one and tr.encoder_of(vocabulary, 3) is not one
    monkeypatch.setattr(tr, "CACHED_PIECES", 4)
    small = tr.Encoder(vocabulary, 2)
    text = "the words of a text come again and again, the words of a text " * 5
    assert small.encode(text) == small.plain(text) + small.end
    assert len(small) <= 8 and len(small.older) <= 8  # a piece may add its parts as well


def test_a_hot_id_spreads_over_files(table, tmp_path, spark, request):
    # Small ranges would be read together.
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    request.addfinalizer(lambda: spark.conf.set(name, before))
    spark.conf.set(name, "false")
    rows = [(None, f"text {i}") for i in range(400)] + [(7, "the same")] * 400
    index = tr.write_records(table("doc_id long, text string", rows, 6),
                             public_tokenizers.path("byte_bpe_50k.json"), path=str(tmp_path / "r"))
    files = {}
    for r in index.collect():
        files.setdefault(r.doc_id, set()).add(r.file)
    assert len(files[None]) > 1 and len(files[7]) > 1


def test_a_plain_word_is_merged_at_once(tokenizer, monkeypatch):
    """Most pieces are a space and ASCII letters: a single pre-token, which needs no splitting."""
    encoder, text = tr.Encoder(tokenizer.to_str(), 2), "Of plain words and unheardofwordings too"

    def made(piece):
        assert piece == "Of", piece
        return encoder.plain(piece)

    monkeypatch.setattr(encoder, "made", made)
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == tokenizer.encode(
        text, add_special_tokens=False).ids + [2]
