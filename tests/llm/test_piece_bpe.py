"""Encoding and decoding against the sentencepiece library."""

import random

import pytest
from pyspark.sql import functions as F

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm import piece_bpe  # noqa: E402
from tessera.llm.piece_bpe import PieceCoder, decode_pieces, encode_pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return PieceCoder(PATH)


def texts(own, n, seed):
    rng, pieces = random.Random(seed), list(own.ids)
    for _ in range(n):
        way = rng.randrange(5)
        if way == 0:
            yield "".join(rng.choice(" ab\n e▁sthion.,\t\r") for _ in range(rng.randint(0, 60)))
        elif way == 1:
            yield "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))).replace("▁", rng.choice("  ▁"))
        elif way == 2:
            ranges = [(0, 127), (0xA0, 0x250), (0x300, 0x500), (0x600, 0xA00), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F700)]
            yield "".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(0, 20)))
        elif way == 3:
            yield " " * rng.randint(0, 80) + rng.choice(["a", "", "th  e", "\n"]) + " " * rng.randint(0, 40)
        else:
            yield " ".join("".join(rng.choice(["tion", "er", "the", "qu", "é", "ß", "S", "ing", "'s", "0"]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12)))


def test_ids_and_texts_equal_the_librarys(own, library):
    for text in texts(own, 6000, 1):
        ids = library.encode(text)
        assert own.encode(text).tolist() == ids, text
        assert own.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(own, library):
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randint(0, 300) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_backtracking_equals_the_merges_themselves(own):
    """Whole texts as one unit, so that no cut helps: equal to merging by score, and places do fail on the way."""
    rng, pieces, back = random.Random(3), [p for p in own.ids if p.isascii() and len(p) > 1], 0
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
        assert own.pieces(text) == own.merged(text), text
        back += own.pieces(text)[0] != max((p for p in own.parts if text.startswith(p)), key=len)
    assert back


def test_cuts_only_where_no_piece_crosses(own):
    assert own.unit.pattern == piece_bpe._CUTS[0][0]
    import re

    for cut, held in piece_bpe._CUTS:
        got = re.compile(cut).findall("▁▁ab,▁c▁▁.▁é日本▁")
        assert "".join(got) == "▁▁ab,▁c▁▁.▁é日本▁" and not any(re.search(held, p) for p in own.ids)


def test_very_long_texts_without_a_cut(own, library):
    text = "0123456789abcdef" * 8000 + "日本語" * 20000 + "\n" * 30000 + " " * 30000
    ids = library.encode(text)
    assert own.encode(text).tolist() == ids and own.decode(ids) == text


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 8)
    own = PieceCoder(PATH)
    for text in texts(own, 300, 4):
        assert own.encode(text).tolist() == library.encode(text)
    assert len(own.pairs) <= 8


def test_rows(spark, library):
    rows = [(1, "a b", "x", 0), (1, "a b", "x", 0), (2, None, None, 1), (3, "", "", 2), (None, "é  z", "q", 3), (4, "w" * 100000, "r", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, row int")
    got = encode_pieces(docs, PATH, decoded="decoded").orderBy("row").collect()
    again = decode_pieces(encode_pieces(docs, PATH), PATH).orderBy("row").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in again]
    assert len(got) == 6 and [r["row"] for r in got] == [0, 0, 1, 2, 3, 4]
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["ids"])
    assert encode_pieces(docs.limit(0), PATH, decoded="decoded").count() == 0
    assert encode_pieces(docs, PATH).columns == ["doc_id", "text", "row", "ids"]
    none = spark.createDataFrame([(None, 1), ([], 2)], "ids array<long>, decoded int")
    assert [tuple(r) for r in decode_pieces(none, PATH).select("decoded").collect()] == [(None,), ("",)]


def test_query(spark, library, tmp_path):
    import hashlib

    from tessera.llm.queries import op12_sentencepiece

    texts_ = [None, "", "One  two", "é" * 50, "▁", "\x00\n"]
    spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op12_sentencepiece(spark, str(tmp_path)).collect():
        ids = library.encode(texts_[r["doc_id"]] or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_other_files_are_refused(tmp_path):
    with pytest.raises(Exception):
        PieceCoder(str(tmp_path / "none.model"))
