"""Language model, similarity join, search, URLs and mixing against direct computation."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrid.llm import jaccard, lm, mixing, topk, urls
from casegrid.llm.keyed import pack, unpack


def words(text):
    return (text or "").encode().lower().split()


def held_by_id(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def trained(texts):
    """Counts of words, pairs and triples; a text begins after an end (0)."""
    counts = Counter(), Counter(), Counter()
    for t in texts:
        seq = [0, *words(t), 0]
        for k in range(3):
            counts[k].update(tuple(seq[i - k : i + 1]) for i in range(1, len(seq)) if i >= k)
    return counts


def smoothed(counts, mu, context, w):
    single = counts[0]
    n, v = sum(single.values()), len(single)
    p = (single[(w,)] + 1) / (n + v + 1)
    for k, m in zip((1, 2), mu):
        if k <= len(context):
            h = tuple(context[-k:])
            # A context of one word has its own count, one of two its pair's; texts begin after as many ends as there are.
            p = (counts[k][(*h, w)] + m * p) / (counts[k - 1][h] + m)
    return p


@pytest.mark.parametrize("mu", [[300.0, 40.0], None])
def test_scores_are_the_backoff_models(docs, rows, mu):
    counts = trained(t for i, t, *_ in rows if not held_by_id(i))
    n, v = sum(counts[0].values()), len(counts[0])
    mu_used = mu or [lm.fitted_mu(np.array(direct_tally(counts[k])), np.array(direct_tally(counts[k + 1]))) for k in (0, 1)]
    want = []
    for i, t, *_ in rows:
        seq = [*words(t), 0]
        base = sum(math.log10((counts[0][(w,)] + 1) / (n + v + 1)) for w in seq)
        score = sum(math.log10(smoothed(counts, mu_used, [0, *seq[:j]][-2:], w)) for j, w in enumerate(seq))
        want.append((str(i), held_by_id(i), len(seq), sum(counts[0][(w,)] > 0 for w in seq), n, round(base, 5), round(score, 5)))
    got = [(str(r[0]), *r[1:5], round(r[5], 5), round(r[6], 5)) for r in lm.score_texts(docs, mu=mu).collect()]
    assert sorted(got) == sorted(want)


def direct_tally(counter):
    keys, tokens = [0] * lm.BINS, [0] * lm.BINS
    for c in counter.values():
        keys[c.bit_length()] += 1
        tokens[c.bit_length()] += c
    return keys + tokens


def test_scores_do_not_depend_on_chunks(docs, rows, monkeypatch):
    from casegrid.llm import keyed

    scored = lambda: sorted((str(r[0]), *r[1:5], round(r[5], 5), round(r[6], 5)) for r in lm.score_texts(docs).collect())
    whole = scored()
    monkeypatch.setattr(keyed, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(keyed, "PART_CHARS", 5000)
    assert scored() == whole


def test_each_state_sums_to_one():
    counts = trained(["a b a a", "b a b", "c a b c"])
    vocabulary = [w for (w,) in counts[0]] + ["unseen"]
    for context in ([], ["a"], ["a", "b"], ["b", "unseen"], ["c"]):
        total = sum(smoothed(counts, [3.0, 2.0], context, w) for w in vocabulary)
        # The end of a text begins the next one's context here, so contexts with all their followers are those of words.
        assert abs(total - 1) < 1e-12


def test_states_follow_failure_arcs():
    one = lambda *x: np.array(x, np.int64)
    # Two tokens: a pair that was seen after a context without triples, then an unseen word.
    model = lm.Automaton([one(4, 0), one(2, 0), one(0, 0)], [one(10, 10), one(5, 4), one(3, 2)], 3, [1.0, 2.0])
    p1 = [(4 + 1) / 14, 1 / 14]
    p2 = [(2 + p1[0]) / 6, p1[1] / 5]
    p3 = [2 * p2[0] / 5, 2 * p2[1] / 4]
    assert np.allclose(model.traverse(one(0, 1, 2)), np.log10(p3))


def test_fitted_weights_expect_as_many_new_pairs_as_there_are():
    counts = trained([" ".join(f"w{(i * i + j) % 17}" for j in range(60)) for i in range(50)])
    context, pairs = np.array(direct_tally(counts[0])), np.array(direct_tally(counts[1]))
    mu = lm.fitted_mu(context, pairs)
    keys, tokens = context.reshape(2, -1)
    held = keys > 0
    c = tokens[held] / keys[held]
    assert abs((tokens[held] * mu / (c - 1 + mu)).sum() - pairs[1]) < 1e-3 * max(1, pairs[1]) or mu < 0.001


def test_held_out_copies_score_better_than_base(docs):
    r = lm.score_texts(docs, held_out=F.col("doc_id") == 9, mu=[5.0, 5.0]).where("held_out").collect()[0]
    assert r["score"] > r["base_score"]


def test_held_out_text_is_likelier_than_under_single_words(spark):
    scored = lm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    row = scored.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert row["score"] > row["base"]


def components(rows, n=3, percent=90):
    sets = [(i, frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])) for i, t, *_ in rows for w in [words(t)]]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, s) in enumerate(sets):
        if i is not None and s:
            least[find(x)] = min(i, least.get(find(x), i))
    return [(i, len(s), least.get(find(x)) if s else i) for x, (i, s) in enumerate(sets)]


def test_components_are_those_of_all_pairs(docs, rows):
    got = jaccard.link_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, components(rows)))


def test_components_of_chains_and_dense_groups(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(6):
        core = [f"g{g}w{i}" for i in range(int(rng.integers(12, 90)))]
        for _ in range(25):
            w = list(core)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 5)}"
            if rng.integers(0, 2):
                core = w  # the group drifts, so its ends are linked through the middle only
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for words_, percent in ((3, 90), (5, 80)):
        got = jaccard.link_components(docs, words=words_, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == sorted(components(rows, words_, percent))


def test_components_where_all_sets_share_tokens(spark, monkeypatch):
    """Lists that every set is in, of sets of one size most of which link with none, dealt out in small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(9)
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for g in range(30):
        own = [f"g{g}x{i}" for i in range(5)]
        for _ in range(5):
            w = shared + own
            if rng.random() < 0.7:
                w[int(rng.integers(0, len(w)))] = f"y{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.link_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    want = components(rows)
    assert sorted(map(tuple, got)) == sorted(want) and 10 < len({c for *_, c in want}) < 140


def test_orders_filter_but_lose_no_link():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(9, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 90 * (len(a) + len(b) - shared):
            continue
        count = lambda x: np.isin(x, a).astype(np.uint64) + np.isin(x, b).astype(np.uint64)
        for o in range(len(jaccard.ORDERS)):
            x, y = a[np.argsort(jaccard.ranked(a, count(a), o))], b[np.argsort(jaccard.ranked(b, count(b), o))]
            i, j = jaccard._first_shared(x, y)
            assert i < jaccard.prefix_length(len(a), 90) and j < jaccard.prefix_length(len(b), 90)
            assert jaccard._fits(len(a), i, np.array([len(b)]), np.array([j]), 90)[0]


def test_one_of_each_component_stays(docs, rows):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert sum(t is None or not t.split() for t in texts) == 3
    assert sum("term5" in (t or "").lower().split() for t in texts) == 1
    assert len(texts) == len({(str(c) if c is not None else f"none {t}") for t, c in ((r[1], x[2]) for r, x in zip(rows, components(rows), strict=True)) if t and t.split()} | {8.5}) + 3


def test_packed_integers():
    import pyarrow as pa

    x = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)
    assert unpack(pa.scalar(pack(x))).tolist() == x.tolist() and len(unpack(pack(x[:0]))) == 0


@pytest.mark.parametrize("big", [False, True])
def test_search_is_exact(spark, monkeypatch, big):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "BLOCK", 5)
    monkeypatch.setattr(topk, "STRIDE", 16)
    rng = np.random.default_rng(4)
    scale = 2e6 if big else 1.0  # big scores are beyond doubles, but not beyond 64 bits
    rows = [(i, [float(x) * scale for x in rng.normal(size=10)], 1) for i in range(200)]
    rows += [(500, rows[3][1], 1), (500, rows[3][1], 1), (501, None, 1), (502, [1.0, None], 1), (503, [float("nan")] * 10, 1), (504, [float("inf")] * 10, 1), (520, [0.0] * 10, 1)]
    table = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int"))
    got = topk.top_k(table, table.where("id % 20 = 0"), 20).collect()
    clean = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, qv in {(q, tuple(v)) for q, v in clean}:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in clean if i != q)[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert not big or max(abs(w[3]) for w in want) > 2**53


def test_scores_beyond_64_bits_are_an_error(spark):
    table = topk.quantised(spark.createDataFrame([(i, [1e12, 1e12]) for i in range(3)], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(table, table.where("id = 0")).collect()


def test_search_with_few_or_no_vectors(spark):
    none = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(none, none).count() == 0
    two = topk.quantised(spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in topk.top_k(two, two.where("id = 0")).collect()] == [(0, 1, 1, 32 * 64 + 32 * 128)]


def test_urls_rules_and_model(spark):
    given = [None, "", "no scheme", "http://WWW.Example.com/en/x?q#f", "http://a.example.com/en/1", "http://example.com", "http://x.net/es/1", "http://x.net/ES/1", "http://netx/fr/", "http://spam-farm.example.org/en/728", "https://library.town.gov/archive/1988", "x://h?p", "http://notexample.com/en/"]
    rows = [(i, u, "h") for i, u in enumerate(given)]
    out = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    show = lambda i: (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"])
    assert show(0)[:3] == show(1)[:3] == show(2)[:3] == ("", "", None)
    assert show(3) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert show(4) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert show(5)[:3] == ("example.com", "", None)
    assert show(6) == ("x.net", "/es/1", "net/es/", "block") and show(7)[2] is None and show(8)[2] is None
    assert show(9)[3] == "block" and show(10)[3] == "allow" and show(11)[:2] == ("h", "") and show(12)[2] == "com/"


def test_url_model_on_held_out_names():
    """Whole names are held out, so no host of the test is one of the training, though its words may be."""
    good, bad, kept, blocked = urls.site_names(urls.GOOD_WORDS), urls.site_names(urls.BAD_WORDS), [], []
    for fold in range(5):
        part = lambda names, own: tuple(urls.labelled_urls([n for i, n in enumerate(names) if (i % 5 == fold) == own]))  # noqa: B023, E731
        model = urls.train(part(good, False), part(bad, False))
        kept += [urls.unwanted(*urls.split_url(u), model) >= urls.BLOCK_FROM for u in part(good, True)]
        blocked += [urls.unwanted(*urls.split_url(u), model) >= urls.BLOCK_FROM for u in part(bad, True)]
    precision, recall = sum(blocked) / max(1, sum(blocked) + sum(kept)), sum(blocked) / len(blocked)
    assert precision >= 0.9 and recall >= 0.75, (precision, recall)


def test_url_model_knows_names_not_endings():
    model = urls.train()
    of = lambda u: urls.unwanted(*urls.split_url(u), model) >= urls.BLOCK_FROM
    for ending in ("example.com", "example.org", "net", "info"):
        assert not of(f"https://www.riverhistory.{ending}/en/12") and not of(f"http://university.{ending}/lectures")
        assert of(f"https://casino-bonus.{ending}/en/12") and of(f"http://www.cheap-viagra.{ending}/")


def test_exponent_meets_its_limit():
    tokens = [900, 60, 30, 10]
    a = mixing.find_exponent(tokens, 2.0)
    w = mixing.tempered([t / 1000 for t in tokens], a)
    passes = [x / t for x, t in zip(w, tokens, strict=True)]
    assert abs(max(passes) / min(passes) - 2) < 1e-6
    e = mixing.find_exponent(tokens, None, 1.0)
    assert abs(mixing.entropy(mixing.tempered([t / 1000 for t in tokens], e)) - 1.0) < 1e-6
    assert mixing.find_exponent([5]) == 1.0 and mixing.find_exponent([5, 5], 2.0) == 0.0 and mixing.find_exponent([0, 0, 3]) == 1.0


def test_mixture_fills_budgets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", " ".join(["w"] * int(rng.integers(1, 40)))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    for total in (None, 15_000, 90_000):
        out = mixing.mix(docs, total=total).collect()
        have = defaultdict(int)
        for r in out:
            have[r["source"]] += r["tokens"]
        counts = docs.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("tokens"))
        for s, tokens, _, budget in mixing.source_budgets(counts, total=total):
            assert budget <= have[s] < budget + 40 or have[s] == tokens, (s, budget, have[s])
        taken = Counter((r["doc_id"], r["pass"]) for r in out)
        assert max(taken.values()) == 1
        if total is None:
            assert {r["doc_id"] for r in out} == set(range(2000))


def test_mixture_of_odd_rows(docs, no_docs, rows):
    out = mixing.mix(docs).collect()
    assert len(out) >= len(rows) and {r["doc_id"] for r in out} == {r[0] for r in rows}
    assert mixing.mix(no_docs).count() == 0
    again = mixing.repeat_documents(docs)
    assert again.columns == docs.columns and again.count() >= len(rows)
    assert mixing.repeat_documents(no_docs).count() == 0


def test_repeated_documents_fill_budgets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", " ".join(["w"] * int(rng.integers(1, 40)))) for i in range(2000)]
    rows += [(5000 + i, "few", " ".join(["w"] * 30)) for i in range(37)] + [(7000, "same", "w w w")] * 500 + [(8000, None, "w " * 700)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    length = F.size(F.split(F.trim("text"), " "))
    have = {r["source"]: r["n"] for r in mixing.repeat_documents(docs).groupBy("source").agg(F.sum(length).alias("n")).collect()}
    counts = docs.groupBy("source").agg(F.sum(length).alias("tokens"))
    longest = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.max(length).alias("n")).collect()}
    for s, _, _, budget in mixing.source_budgets(counts):
        assert budget <= have[s] < budget + longest[s], (s, budget, have[s])
    assert {r[0] for r in mixing.repeat_documents(docs).select("doc_id").distinct().collect()} == {r[0] for r in rows}


def test_empty_tables(no_docs):
    assert lm.score_texts(no_docs).count() == 0
    assert jaccard.link_components(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0
    assert urls.judge_urls(no_docs, "doc_id", "text").count() == 0


@pytest.mark.parametrize("entropy", [None, 1.2])
def test_budgets_of_very_many_sources_are_the_same(spark, monkeypatch, entropy):
    counts = spark.createDataFrame([(f"s{i}", (i * i * 37) % 1000) for i in range(50)] + [(None, 40)], "source string, tokens long")
    few = {r[0]: r for r in mixing.budget_table(counts, 3.0, entropy).collect()}
    monkeypatch.setattr(mixing, "MOST_SOURCES", 10)
    many = {r[0]: r for r in mixing.budget_table(counts, 3.0, entropy).collect()}
    assert few.keys() == many.keys()
    assert all(abs(few[k][2] - many[k][2]) < 1e-6 and abs(few[k][3] - many[k][3]) <= 1 for k in few)


def test_mixing_and_join_with_any_column_names(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(20 + i)), "ab"[i % 2], 1, 2, 3, 4) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m_full_ int, j_digest_ int, keep_id_ int, digest_ int")
    again = mixing.repeat_documents(docs)
    assert again.columns == docs.columns and {r["doc_id"] for r in again.collect()} == set(range(40))
    kept = jaccard.keep_one(docs, words=5, percent=80)
    assert kept.columns == docs.columns and 0 < kept.count() <= 40


def test_words_whose_hashes_are_near_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "w182239 " + "aa " * 550), (2, "w262543")], "doc_id long, text string")
    r = lm.score_texts(docs, held_out=F.col("doc_id") == 2).where("held_out").collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (2, 1, 552)
    # Known words: w182239, aa and the end.
    assert abs(r["base_score"] - (math.log10(1 / (552 + 4)) + math.log10(2 / (552 + 4)))) < 1e-9


def test_a_hundred_thousand_words_are_counted_exactly(spark):
    rng = np.random.default_rng(7)
    names = [f"w{i}" for i in range(200_000)]
    rows = [(i, " ".join(names[j] for j in rng.integers(0, 200_000, 2000))) for i in range(120)]
    counts = Counter(w for i, t in rows if not held_by_id(i) for w in [*t.split(), None])
    assert len(counts) > 100_000
    n, v = sum(counts.values()), len(counts)
    out = {r["doc_id"]: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, t in rows:
        seq = [*t.split(), None]
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_by_id(i), len(seq), sum(w in counts for w in seq), n)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in seq)) < 1e-6
