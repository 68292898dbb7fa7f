"""Byte-level BPE by the pair occurrence index against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
import tokenizers

from casegrid.llm import bpe, queries

FILE = public_tokenizers.path(queries.BYTE_MODEL)
PARTS = ["a", "B", "'s", "'re", " ", "  ", "é", "é", "1", "²", "_", "-", ".", "\n", "\r\n", "<|endoftext|>", "日本", "　", "\x1c", "ß", "İ", "٣", "👍", "՘", "\U0001e5d0", "\x00", "the", "ing", "tion"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder():
    return bpe.BpeEncoder(FILE)


def test_ids_and_decoding_are_the_librarys(docs, rows, library):
    got = bpe.encode_texts(docs, ["doc_id", "lang"], FILE)
    want = [(str(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got.collect()) == sorted(want)
    back = bpe.decode_ids(got, ["doc_id"], FILE)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((k, library.decode(i, skip_special_tokens=False)) for k, i in want)


@pytest.mark.parametrize("many", [2, 24, 10**9])
def test_made_texts_with_few_or_many_places_at_once(library, monkeypatch, many):
    monkeypatch.setattr(bpe, "MANY", many)
    rng = random.Random(many)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += ["a" * 5001, "aab" * 3000, " " * 9999, "ab " * 100, "".join(chr(rng.randint(0x61, 0x70)) for _ in range(20_000))]
    encoder = bpe.BpeEncoder(FILE)
    for text, ids, own in zip(texts, encoder.encode(texts), library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert own.ids == ids.tolist(), repr(text[:60])


def test_every_code_point(library, encoder):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0)]
    texts = [" ".join(f"a{chr(c)}B{chr(c)}1{chr(c)}." for c in points[i : i + 300]) for i in range(0, len(points), 300)]
    for text, ids, own in zip(texts, encoder.encode(texts), library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert own.ids == ids.tolist(), repr(text[:40])


def test_words_are_parted_alike_and_make_up_the_text(library, encoder):
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 20)))
        assert "".join(encoder.words(text)) == text
        plain = text.replace("<|endoftext|>", "")
        assert encoder.words(plain) == encoder._library_words(plain)


def test_special_strings_as_plain_text(library):
    plain = tokenizers.Tokenizer.from_file(FILE)
    plain.encode_special_tokens = True
    text = "a <|endoftext|> b<|endoftext|>"
    assert bpe.BpeEncoder(FILE, specials=False).encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert bpe.BpeEncoder(FILE).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_decoding_any_ids(library, encoder):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_kept_words_are_bounded_and_long_ones_are_not_kept(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 20_000)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 2_000)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(100)) + " " + "x" * 3000 + str(i) for i in range(60)]
    encoder = bpe.BpeEncoder(FILE)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.kept) + len(encoder.older) < 600 and max(map(len, encoder.kept), default=0) <= bpe.KEPT_WORD


def test_a_word_of_a_megabyte(library, encoder):
    rng = random.Random(4)
    word = "".join(rng.choice("aeinrst") for _ in range(1 << 20))
    ids = encoder.encode([word])[0]
    assert encoder.decode(ids.tolist()) == word
    assert ids.tolist() == library.encode(word, add_special_tokens=False).ids


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.PairIndex(bpe.np.arange(256), [(256, 99), (97, 98)], [257, 256])


def test_odd_tables(spark, no_docs):
    assert bpe.encode_texts(no_docs, ["doc_id"], FILE).count() == 0
    rows = spark.createDataFrame([(1, [64, 65]), (2, []), (3, None), (3, None)], "`a b` int, ids array<int>")
    out = [(r[0], r[1]) for r in bpe.decode_ids(rows, ["a b"], FILE).collect()]
    assert sorted(x for x, _ in out) == [1, 2, 3, 3] and dict(out)[2] == "" and dict(out)[3] is None
    with pytest.raises(ValueError):
        bpe.decode_ids(rows.withColumnRenamed("a b", "text"), ["text"], FILE)


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    out = {r["doc_id"]: r for r in queries.op11_byte_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        got = out[r["doc_id"]]
        assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
