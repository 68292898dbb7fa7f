"""SentencePiece and token files against their libraries."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from casegrid.llm import pieces, queries, tokenfiles

PIECES, WORDS = public_tokenizers.path(queries.PIECE_MODEL), public_tokenizers.path(queries.WORD_MODEL)


def test_ids_and_decoding_are_the_librarys(docs, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode_texts(docs, ["doc_id", "lang"], PIECES)
    out = got.collect()
    assert len(out) == len(rows)
    want = sorted((str(r[0]), sp.encode(r[1] or "", add_eos=True)) for r in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in out) == want
    back = pieces.decode_ids(got, ["doc_id"], PIECES).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((k, sp.decode(i)) for k, i in want)


def test_spans_cover_the_text(rows):
    encoder = pieces.Encoder(PIECES)
    for _, text, *_ in rows:
        source = (text or "").encode()
        ids, begins, ends = encoder.encode(text)
        assert len(ids) == len(begins) == len(ends) and (begins <= ends).all() and begins[0] == 0 and ends[-1] == len(source)
        assert b"".join(source[a:b] for a, b in zip(begins, ends, strict=True)) == source
        for i, a, b in zip(ids.tolist(), begins, ends, strict=True):
            piece = encoder.sp.id_to_piece(i)
            if not encoder.sp.is_byte(i) and not encoder.sp.is_control(i):
                assert piece.replace("▁", " ").strip(" ") == source[a:b].decode().strip(" ").replace("▁", "").strip(" ") or "▁" in source[a:b].decode()


def darts(entries):
    """A double-array trie with the pool of its replacements, placed by first fit."""
    pool, values = b"", {}
    for k, v in entries.items():
        values[k] = len(pool)
        pool += v + b"\0"
    units, used, bases = [0] * 8192, {0}, set()

    def place(node, keys, depth):
        chars = sorted({k[depth] if depth < len(k) else 0 for k in keys})
        base = next(b for b in range(1, 4000) if b not in bases and all((b ^ c) not in used for c in chars) and (node ^ b) < (1 << 21))
        bases.add(base)
        units[node] |= (node ^ base) << 10
        used.update(base ^ c for c in chars)
        for c in chars:
            child = base ^ c
            below = [k for k in keys if (k[depth] if depth < len(k) else 0) == c]
            if c == 0:
                units[node] |= 1 << 8
                units[child] = values[below[0]] | (1 << 31)
            else:
                units[child] |= c
                place(child, below, depth + 1)

    place(0, list(entries), 0)
    raw = b"".join(u.to_bytes(4, "little") for u in units)
    return len(raw).to_bytes(4, "little") + raw + pool


def test_longest_prefix_normalisation_records_its_source():
    entries = {"ﬁ".encode(): b"fi", "①".encode(): b"1", b"ab": b"X", b"abc": b"YZ", "　".encode(): b" "}
    encoder = pieces.Encoder(PIECES)
    encoder.map = pieces.CharacterMap(darts(entries))
    assert encoder.map.longest(b"abcd", 0) == (3, b"YZ") and encoder.map.longest(b"abd", 0) == (2, b"X") and encoder.map.longest(b"b", 0) is None
    out, align = encoder.normalise("ﬁabc①")
    assert out == "▁fiYZ1".encode()
    assert align.tolist() == [0, 0, 0, 0, 0, 3, 3, 6, 9]
    encoder.squeeze = True
    out, align = encoder.normalise("  a　 b ")
    assert out == "▁a▁b".encode() and align.tolist()[-1] == len("  a　 b ".encode())


def test_token_files_hold_the_librarys_ids(spark, docs, rows):
    library = tokenizers.Tokenizer.from_file(WORDS)
    path = tokenfiles.write_shards(docs, WORDS, 1)
    out = tokenfiles.read_shards(spark, path).collect()
    ids = {(r[0], zlib.crc32(np.array(x, "<u4").tobytes())): len(x) for r in rows for x in [[*library.encode(r[1] or "", add_special_tokens=False).ids, 1]]}
    assert {(r["doc_id"], r["ids_crc32"]): r["n_tokens"] for r in out} == ids
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x))


def test_units_are_encoded_as_whole_texts():
    import random

    rng = random.Random(2)
    parts = ["a", "B", "'s", "'", " ", "é", "e", "\u0301", "1", "²", "_", "-", ".", "\n", "<|endoftext|>", "日", "　", "\x1c", "ß", "İ", "Σ", "٣", "Ⅷ", "\u200d", "J\u030c"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(3000)]
    encoder = tokenfiles.WordEncoder(WORDS)
    assert encoder.parted and encoder.direct
    library = tokenizers.Tokenizer.from_file(WORDS)
    for text, ids in zip(made, encoder.ids(made), strict=True):
        assert library.encode(text, add_special_tokens=False).ids == ids.tolist(), repr(text)


def test_every_code_point_is_encoded_as_the_library_does():
    encoder = tokenfiles.WordEncoder(WORDS)
    library = tokenizers.Tokenizer.from_file(WORDS)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # Alone beside letters, digits and marks, a few hundred to a text; the low ones, which are parted here, with each other too.
    texts = [" ".join(f"a{chr(c)}B{chr(c)}1" for c in points[i : i + 300]) for i in range(0, len(points), 300)]
    low = [chr(c) for c in (*range(0, 0x100), *range(0x100, 0x260, 7), 0x130, 0x131)]
    texts += [" ".join(f"{a}{b}" for b in low) for a in low]
    for text, ids, own in zip(texts, encoder.ids(texts), library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert own.ids == ids.tolist(), repr(text[:40])


def plain_repair(ids, least):
    """Re-Pair with one pair, the most frequent, at a time: symbols left and rules."""
    sequence, top, rules = list(ids), max(ids) + 1, 0
    while True:
        uses, i = {}, 0
        last = {}
        for i, pair in enumerate(zip(sequence, sequence[1:])):
            if last.get(pair) != i - 1 or pair[0] != pair[1]:
                uses[pair] = uses.get(pair, 0) + 1
                last[pair] = i
        pair, n = max(uses.items(), key=lambda x: x[1], default=(None, 0))
        if n < least:
            return len(sequence), rules
        out, i = [], 0
        while i < len(sequence):
            if tuple(sequence[i : i + 2]) == pair:
                out.append(top)
                i += 2
            else:
                out.append(sequence[i])
                i += 1
        sequence, top, rules = out, top + 1, rules + 1


def test_shards_are_smaller_than_16_bit_ids_and_near_plain_repair(rows):
    encoder = tokenfiles.WordEncoder(WORDS)
    found = [np.append(x, 1).astype(np.uint32) for x in encoder.ids([r[1] or "" for r in rows])]
    ids, counts = np.concatenate(found), np.array([len(x) for x in found])
    data = tokenfiles.compress(ids, counts, 49408)
    shard = tokenfiles.Shard(data)
    assert shard.expand(shard.sequence(0, shard.symbols)).tolist() == ids.tolist()
    if len(ids) > 5000:
        assert len(data) < 2 * len(ids)
    words = np.random.default_rng(3).zipf(1.3, 3000) % 60
    own = tokenfiles.Shard(tokenfiles.compress(words.astype(np.uint32), np.array([len(words)]), 60))
    left, rules = plain_repair(words.tolist(), tokenfiles.LEAST_USES)
    assert own.symbols + 2 * len(own.rules) <= 1.05 * (left + 2 * rules)
    symbols = own.sequence(0, own.symbols)
    pairs = np.stack([symbols[:-1], symbols[1:]])[:, symbols[:-1] != symbols[1:]]
    assert np.unique(pairs, axis=1, return_counts=True)[1].max() < tokenfiles.LEAST_USES


@pytest.mark.parametrize("counts", [[], [0], [0, 0, 1], [3, 0, 2], [400, 0, 600, 1], [5000]])
def test_grammar_round_trip_and_random_access(counts):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 6, sum(counts)).astype(np.uint32)
    shard = tokenfiles.Shard(tokenfiles.compress(ids, np.array(counts, np.int64), 10))
    assert shard.expand(shard.sequence(0, shard.symbols)).tolist() == ids.tolist() and shard.counts().tolist() == counts
    assert shard.expand_many(shard.sequence(0, shard.symbols)).tolist() == ids.tolist()
    edge = np.concatenate([[0], np.cumsum(counts)]).astype(int)
    for k in range(len(counts)):
        own = ids[edge[k] : edge[k + 1]].tolist()
        assert shard.document(k).tolist() == own
        for a, b in ((0, 0), (0, len(own)), (len(own) // 3, len(own) // 2)):
            assert shard.slice(k, a, b).tolist() == own[a:b]
    if len(ids) > 4000:
        assert shard.symbols <= len(ids) / 2 and len(shard.rules)


def test_empty_tables(spark, no_docs):
    assert pieces.encode_texts(no_docs, ["doc_id"], PIECES).count() == 0
    assert tokenfiles.read_shards(spark, tokenfiles.write_shards(no_docs, WORDS, 1)).count() == 0


def test_library_places_agree_with_the_alignment():
    encoder = pieces.Encoder(PIECES)
    for text in ("Hello wörld, 日本 x", " a  b ", "", "é\U0001F600\u0301"):
        ids, begins, ends = encoder.encode(text, end=False)
        own = encoder._library_places(text)
        assert len(own[0]) == len(ids) and sorted(set(ends.tolist()))[-1:] == sorted(set(own[1].tolist()))[-1:]


def test_decoding_takes_any_key_names(spark):
    rows = spark.createDataFrame([(1, [35, 36]), (2, []), (3, None), (3, None)], "`a b` int, ids array<int>")
    out = [(r[0], r[1]) for r in pieces.decode_ids(rows, ["a b"], PIECES).collect()]
    assert sorted(x for x, _ in out) == [1, 2, 3, 3] and dict(out)[2] == "" and dict(out)[3] is None


def test_kept_words_are_bounded_by_bytes(monkeypatch):
    import random

    rng = random.Random(9)
    encoder = tokenfiles.WordEncoder(WORDS)
    library = tokenizers.Tokenizer.from_file(WORDS)
    monkeypatch.setattr(tokenfiles.WordEncoder, "KEPT", 30)
    # Texts without white space are one new word each.
    texts = ["".join(rng.choice("aeinrst") for _ in range(n)) for n in (3, 40, 70, 5000, 1 << 20) for _ in range(1 if n > 5000 else 60)]
    for text in texts:
        assert encoder.ids([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.kept) <= 60 and max(map(len, encoder.kept), default=0) <= tokenfiles.WordIds.LONGEST
