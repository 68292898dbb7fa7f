"""Statistics against a plain count, and the estimate against direct concentration steps."""

import math
import re
from collections import Counter

import numpy as np

from casegrid.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] >= 2:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_statistics(docs, rows):
    got = {(r["doc_id"], r["n_words"]): tuple(r)[1:6] for r in quality.quality_report(docs).collect()}
    for r in rows:
        want = plain(r[1])
        assert got[(r[0], want[0])] == want
    out = quality.quality_report(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def made(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        n = int(rng.integers(60, 300))
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(n)]
        text = " ".join(words)
        if i % 50 == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        if i % 50 == 1:
            text = " ".join(w + " ###" for w in words)
        rows.append((i, text, "en" if i % 5 else "de", "hot" if i % 3 else f"s{i % 4}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_go_and_clean_texts_stay(spark):
    out = quality.quality_report(made(spark)).collect()
    bad = {r["doc_id"] for r in out if not r["kept"]}
    assert {i for i in range(1500) if i % 50 < 2} <= bad
    assert len([i for i in bad if i % 50 >= 2]) <= 5


def test_estimate_agrees_with_direct_steps(spark):
    docs = made(spark).withColumn("lang", quality.F.lit("en")).withColumn("source", quality.F.lit("one"))
    stats = quality.measure(docs, ["lang", "source"])
    groups, model = quality.fit_groups(stats)
    z = np.array([[float(x) for x in r] for r in stats.where(~quality.base_failed()).select(*quality.vector()).collect()])
    (row,) = model.collect()
    mean, inverse = np.array(row["mean"]), np.array(row["inverse"]).reshape(quality.D, quality.D)
    gap = z - np.median(z, axis=0)
    d = (gap**2 / (4 * quality.LEAST_SD**2)).sum(axis=1)
    for _ in range(quality.STEPS):
        near = z[np.argsort(d, kind="stable")[: math.ceil(len(z) * quality.SUPPORT)]]
        m = near.mean(axis=0)
        s = quality._floored(quality.CONSISTENCY * np.cov(near.T, bias=True))
        d = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(s), z - m)
    assert np.allclose(mean, m, atol=0.02) and np.allclose(np.linalg.inv(inverse), s, atol=0.02)


def test_estimate_is_the_least_determinant_of_all_subsets(spark, monkeypatch):
    """Groups so small that every subset of the supported size can be tried."""
    from itertools import combinations

    monkeypatch.setattr(quality, "LEAST_ROWS", 10)
    rng = np.random.default_rng(11)
    rows, n = [], 16
    for g in range(3):
        for i in range(n):
            words = int(rng.integers(200, 900))
            wild = i < 3
            stats = [words, int(words * rng.uniform(3, 9) * (4 if wild else 1)), int(words * rng.uniform(0, 0.3) * (9 if wild else 1)), int(rng.integers(0, 30)), int(words * rng.uniform(0, 0.3)), 100, int(words * rng.uniform(0, 1.5))]
            rows.append((f"g{g}", "s", *stats))
    stats = spark.createDataFrame(rows, ", ".join(["lang string", "source string", *(f"{c} long" for c in quality.STATS)]))
    _, model = quality.fit_groups(stats)
    for m in model.collect():
        z = np.array([[float(x) for x in r] for r in stats.where(quality.F.concat(quality.F.lit("="), "lang") == m["g_lang"]).select(*quality.vector()).collect()])
        h = math.ceil(n * quality.SUPPORT)
        pick = np.array(list(combinations(range(n), h)))
        least = min(np.linalg.slogdet(quality._floored(quality.CONSISTENCY * np.cov(z[p].T, bias=True)))[1] for p in pick)
        own = -np.linalg.slogdet(np.array(m["inverse"]).reshape(quality.D, quality.D))[1]
        assert own <= least + 0.35, (own, least)


def test_tables_with_any_column_names(spark):
    docs = made(spark).limit(400)
    odd = docs.selectExpr("doc_id", "text", "lang AS n_words", "source AS q_kept", "1 AS m_mean", "2 AS q_n_words", "3 AS j_lang_", "4 AS `a b`")
    kept = quality.keep_good(odd, lang_col="n_words", source_col="q_kept")
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in quality.keep_good(docs).collect())


def test_filter_keeps_columns_and_agrees_with_report(spark):
    docs = made(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in quality.quality_report(docs).collect() if r["kept"])


def test_odd_rows_pass_through(docs, no_docs):
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(no_docs).count() == 0 and quality.quality_report(no_docs).count() == 0


def test_repetition_alone_is_an_outlier_in_a_clean_group(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 8)))
    rows = []
    for i in range(600):
        lines = [" ".join(word() for _ in range(2)) for _ in range(60)]
        if i < 3:  # 27 of 60 lines are copies; other lines between them, so that no window of three words repeats
            lines[1:56:2] = [lines[1]] * 28
        text = "\n".join(lines)
        if 3 <= i < 6:  # 45 % of words are in repeated windows, on one line
            once = [word() for _ in range(110)]
            part = [word() for _ in range(45)]
            text = " ".join(part + once + part)
        rows.append((i, text, "en", "clean"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in quality.quality_report(docs).collect()}
    assert not any(out[i]["base_failed"] for i in range(600))
    assert all(out[i]["n_repeat_words"] > 0.4 * out[i]["n_words"] for i in range(3, 6))
    assert [i for i in range(6) if out[i]["kept"]] == []
    assert sum(not out[i]["kept"] for i in range(6, 600)) <= 2


def test_least_scatter_leaves_wider_directions_alone():
    scatter = np.diag((quality.LEAST_SD * [3, 0, 2, 0, 1.5]) ** 2)
    want = np.diag((quality.LEAST_SD * [3, 1, 2, 1, 1.5]) ** 2)
    assert np.allclose(quality._floored(scatter), want)
