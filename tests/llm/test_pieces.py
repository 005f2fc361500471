"""Encoding, offsets and decoding against the library, on real and odd texts."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from llm_fixtures import SF_DIR, documents

from pyspark.sql import functions as F

from sessiongrid.llm import pieces
from sessiongrid.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "  ", " a", "▁", "▁ x", "\x00a\x01", "漢字 🙂🙂 ▁▁ <s> <0x0A>\n\n\t", "x" * 5000, "é" * 3000, "⁇ a", "a  b   c    d", "﻿x", "á", "ｆｕｌｌ  ①  x",
    "  lead and trail  ", "ﷺ 　 ㌀ﬁ", "Å é", " 　", "​​", "𐍈𐍈a𐍈", "\U0010fffd", "word" * 20_000,
]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_query_equals_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op13_pieces"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_spans_equal_library(model, library):
    for text in ODD:
        raw = text.encode()
        ids, begins, ends, counts = model.encode([raw])
        assert ids.tolist() == library.encode(text) and counts.tolist() == [len(ids)]
        for piece, i, begin, end in zip(library.encode(raw, return_type="proto").pieces, ids, begins, ends):
            if model.kinds[i] != pieces.BYTE:
                assert (piece.begin, piece.end) == (begin, end)
            else:  # the whole character that the byte is of
                assert model.surfaces[i] in {bytes([b]) for b in raw[begin:end]} and len(raw[begin:end].decode()) == 1


def test_many_texts_at_once(model):
    ids, begins, ends, counts = model.encode([t.encode() for t in ODD])
    at = 0
    for text, n in zip(ODD, counts):
        alone = model.encode([text.encode()])
        for whole, part in zip((ids, begins, ends), alone):
            assert whole[at : at + n].tolist() == part.tolist()
        at += n
    assert at == len(ids) and all(len(c) == 0 for c in model.encode([]))


def test_queue_and_rounds_agree(model, monkeypatch):
    """Parts merged by the queue and all at once, with runs of marks, whose pieces share one score."""
    draw = random.Random(4)
    texts = ["".join(draw.choice("aeinrst  ▁é漢") for _ in range(draw.randrange(90))).encode() for _ in range(300)]
    together = model.encode(texts)
    model.known = pieces.Parts()
    monkeypatch.setattr(pieces, "LONG", 0)
    for a, b in zip(together, model.encode(texts)):
        assert a.tolist() == b.tolist()
    model.known = pieces.Parts()


def test_decode_equals_library(model, library):
    """Random ids: bytes that are no text, control and unknown ids, marks at the start."""
    draw = random.Random(1)
    for _ in range(5000):
        ids = [draw.choice([draw.randrange(300), draw.randrange(32_000), 28_705, 259, 260]) for _ in range(draw.randrange(8))]
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normaliser_equals_library(rule):
    """Longest prefixes through compiled character maps of the library's own rules, with the alignment."""
    for squeeze, prefix, escape in [(s, p, e) for s in (True, False) for p in (True, False) for e in (True, False)]:
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=escape)
        spec = dict(pieces.fields(dict(pieces.fields(library.serialized_model_proto()))[3]))
        own = pieces.PieceModel({}, pieces.np.zeros(0), pieces.np.zeros(0), [], [], None, 0, pieces.CharacterMap(spec.get(2, b"")), prefix, squeeze, escape, True)
        for text in ODD[:-1]:
            expected, places = library.normalize(text, with_offsets=True)
            normal, align = own.normalise(text.encode())
            starts = [i for i, b in enumerate(normal) if b & 0xC0 != 0x80] + [len(normal)]
            assert normal.decode() == expected
            assert [len(text.encode()[: align[i]].decode()) for i in starts] == list(places)


def test_unknown_runs_are_one_piece(model):
    """Without byte pieces, as in other models, a run of unknown characters is one unknown id."""
    plain = pieces.read_model(PATH)
    plain.byte_ids = None
    ids, begins, ends, counts = plain.encode(["a \U0001f9ff\U0001f9ff\U0001f9ff b".encode(), "\U0001f9ff".encode()])
    unknown = ids == plain.unknown
    assert unknown.sum() == 2 and (ends - begins)[unknown].tolist() == [12, 4] and counts.sum() == len(ids)


def test_round_trip_with_odd_rows(spark, model, odd_texts):
    docs = documents(spark, odd_texts)
    for name in ("ids", "begins", "__text", "decoded", "__ids", "n_tokens"):
        docs = docs.withColumn(name, F.lit("extra"))
    rows = pieces.decode(pieces.encode(docs, model), model).collect()
    assert len(rows) == len(odd_texts) and {"begins", "ends", "decoded", "n_tokens"} <= set(rows[0].asDict())
    assert sorted(map(str, rows)) == sorted(map(str, pieces.encode(docs, model, decoded="decoded").collect()))
    for r in rows:
        assert r.decoded == (r.text or "").replace("▁", " ") and len(r.ids) == len(r.begins) == len(r.ends)
        assert bool(r.ids) == bool(r.text)
    lists = spark.createDataFrame([(1, None), (2, []), (3, [None, 12, None])], "k int, ids array<int>")
    assert [r.decoded for r in pieces.decode(lists, model).orderBy("k").collect()] == ["", "", "\t"]
    assert pieces.digest(pieces.decode(pieces.encode(documents(spark, []), model), model), ["doc_id"]).count() == 0
