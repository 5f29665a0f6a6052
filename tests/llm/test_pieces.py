"""The encoder against the library: ids, spans, decoded texts, and a real character map."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerloom.llm import pieces

ODD = ["", " ", "   ", "  a  b \n", "a▁b <s> </s> <unk>", "�", "日本語\U0001f600 \U00012345x", "ＡＢＣ ﬁ x\t", "a" * 5000, "\x00x", "é é", "\n\n \r\n", "　 x ▁▁ ▁"]


@pytest.fixture(scope="module")
def model() -> bytes:
    return pieces._model_bytes(None)


def _texts(n: int = 300) -> list[str]:
    rng = random.Random(5)
    alphabet = "abc éñ the of  ▁\U0001f600日\n\t<>1"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("table_bytes", [5_000, pieces.TABLE_BYTES])
def test_ids_spans_and_decoding_equal_the_library(model, table_bytes):
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoder = pieces.Encoder(model, table_bytes)
    texts = _texts()
    for at in range(0, len(texts), 40):
        part = texts[at : at + 40]
        for text, e in zip(part, encoder.encode([t.encode() for t in part])):
            assert e.ids.tolist() == lib.encode(text)
            assert encoder.decode(e.ids) == lib.decode(e.ids.tolist())
            spans = [dict(pieces.fields(v)) for k, v in pieces.fields(lib.encode(text, out_type="serialized_proto")) if k == 2]
            assert list(zip(e.begins.tolist(), e.ends.tolist())) == [(s.get(4, 0), s.get(5, 0)) for s in spans], text
    assert encoder.held <= table_bytes // 2 + 40 * 30 * 230 and max(map(len, encoder.known)) <= pieces.LONGEST_UNIT


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze, prefix", [(True, False), (False, False), (True, True), (False, True)])
def test_longest_prefixes_of_a_compiled_map(model, rule, squeeze, prefix):
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = next(v for k, v in pieces.fields(lib.serialized_model_proto()) if k == 3)
    encoder = pieces.Encoder(model)
    encoder.set_map(pieces.CharMap(dict(pieces.fields(spec))[2]))
    encoder.prefix, encoder.squeeze = prefix, squeeze
    plain = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=squeeze, escape_whitespaces=True, add_dummy_prefix=prefix)
    for text in _texts(100):
        made, source = encoder.normalise(text.encode())
        assert made.replace(b"\xff", "▁".encode()).decode() == plain.normalize(text), text
        assert len(source) == len(made) + 1 and (source[1:] >= source[:-1]).all() and source[-1] <= len(text.encode())


def test_very_long_texts(spark, model):
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["wörd der " * 60_000, "日" * 30_000, "x" * 50_000 + " y"]
    got = {r.doc_id: r for r in pieces.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ids = lib.encode(text)
        assert got[i].n_tokens == len(ids) and got[i].source_bytes == len(text.encode())
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_decoding_broken_byte_runs(model):
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoder = pieces.Encoder(model)
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, *range(3, 259), 264, 28705, 500]) for _ in range(rng.randrange(9))]
        assert encoder.decode(ids) == lib.decode(ids), ids


def test_rows(spark):
    rows = [(1, "a b", "x"), (None, "c", "y"), (2, None, None), (2, None, None), (3, "", "z")]  # a column of a clashing name beside
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    e = {(r.doc_id, tuple(r.ids)) for r in pieces.encode(docs).collect()}
    assert (2, ()) in e and (3, ()) in e and len(e) == 4
    back = pieces.decode(pieces.encode(docs)).orderBy(F.col("doc_id").asc_nulls_first(), "text").collect()
    assert [(r.doc_id, r.text) for r in back] == [(None, "c"), (1, "a b"), (2, ""), (2, ""), (3, "")]
    assert pieces.digests(docs.limit(0)).count() == 0
    assert pieces.digests(docs).count() == 5
