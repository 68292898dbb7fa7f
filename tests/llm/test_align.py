"""Cross-tokenizer alignment against a plain version over the libraries."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from casegrid.llm import align, queries
from casegrid.llm.bpe import byte_alphabet

A, B = public_tokenizers.path(queries.BYTE_MODEL), public_tokenizers.path(queries.PIECE_MODEL)


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    spelt = {c: b for b, c in byte_alphabet().items()}
    return a, sentencepiece.SentencePieceProcessor(model_file=B), spelt


def groups_of(text, libraries):
    """Groups of (A ids, B ids) of one text, byte by byte."""
    a, b, spelt = libraries
    if not text:
        return []
    left = [(i, bytes(spelt[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return []
    ends = []
    for side in (left, right):
        at, out = 0, []
        for i, x in side:
            at += len(x)
            out.append((at, i))
        ends.append(out)
    common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
    out = [([], []) for _ in common]
    for k, side in enumerate(ends):
        for e, i in side:
            out[bisect.bisect_left(common, e)][k].append(i)
    return out


def plain(rows, libraries):
    """Rows of (id, text) to the operator's rows."""
    made = [groups_of(t, libraries) for _, t in rows]
    count = Counter()
    for groups in made:
        count.update({(x, y) for g, h in groups for x in g for y in h})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (k, _), groups in zip(rows, made):
        links = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((str(k), sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


def made_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "B", "'s", " ", "  ", "é", "é", "1", "42", "²", "_", "-", ".", ",", "\n", "\t", "<|endoftext|>", "<s>", "<0x0A>", "日本", "　", "▁", "ß", "👍", "\x00", "the", "ing", "tion", " Hello", "(x)", "://"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_odd_rows(spark, docs, rows, libraries):
    assert got(align.align_documents(docs, A, B)) == plain([r[:2] for r in rows], libraries)


@pytest.mark.parametrize("chunk,wide", [(10**7, 1024), (2_000, 2)])
def test_made_texts_with_many_copies(spark, monkeypatch, libraries, chunk, wide):
    texts = made_texts(600, chunk)
    rows = [(i, texts[i % 600] if i % 3 else texts[7]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = align.part_edges(7)
    assert (parts & np.uint64(0xFFFF) == 0).all()
    monkeypatch.setattr(align, "PART_CHARS", 1_000)
    if chunk < 10**6:
        # Workers are forked before: what they run is changed through what is sent to them.
        work = align.Aligner(A, B)
        monkeypatch.setattr(align, "WIDE", wide)
        found = work.align(texts)
        want = plain([(f"{i:04}", t) for i, t in enumerate(texts)], libraries)
        assert list(zip(found.n_a, found.n_b, found.n_groups, found.n_links, found.digests)) == [(r[1], r[2], r[3], r[4], r[7]) for r in want]
    assert got(align.align_documents(df, A, B)) == plain(rows, libraries)


def test_wide_groups_are_counted_by_distinct_ids(monkeypatch):
    work = align.Aligner(A, B)
    texts = made_texts(300, 3)
    one = work.align(texts)
    monkeypatch.setattr(align, "WIDE", 2)
    two = work.align(texts)
    for name in ("pair_text", "pair_key", "pair_uses"):
        assert (getattr(one, name) == getattr(two, name)).all()
    assert one.pair_uses.sum() == one.n_links.sum()


def test_pieces_by_words_are_the_librarys(libraries):
    work = align.PieceWords(B)
    assert work.parted is not None
    texts = [t for t in made_texts(3000, 5) if t]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 11 == 0)]
    texts += [" ".join(f"a{chr(c)}B{chr(c)}1{chr(c)}." for c in points[i : i + 300]) for i in range(0, len(points), 300)]
    for text, ids in zip(texts, work.encode(texts), strict=True):
        assert libraries[1].encode(text) == ids[ids != align._INEXACT].tolist(), repr(text[:50])


def test_a_text_of_a_megabyte_without_spaces(libraries):
    rng = random.Random(6)
    text = "".join(rng.choice("aeinrst") for _ in range(1 << 20))
    x = align.Aligner(A, B).align([text])
    assert x.n_groups[0] > 1000 and x.pair_uses.sum() == x.n_links[0]


def test_empty_tables_and_clashing_columns(spark, no_docs, libraries):
    assert align.align_documents(no_docs, A, B).count() == 0
    df = spark.createDataFrame([(1, "one two", 5, "x"), (2, None, 6, "y"), (None, "one two", 7, "z")], "doc_id long, text string, n_a int, sha string")
    assert got(align.align_documents(df, A, B)) == plain([(1, "one two"), (2, None), (None, "one two")], libraries)
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r[1:] for r in got(align.align_documents(only, A, B))] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_query(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op13_token_alignment(spark, sf)) == plain(rows, libraries)
