"""Secrets and personal data against plain regular expressions."""

import hashlib
import re

from casegrid.llm import pii, secrets

PATTERNS = {
    "assign": re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def good(kind, m):
    digits = [int(c) for c in m[0] if c in "0123456789"]
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    if kind == "hex":
        return len(m[0]) >= 32
    if kind == "ip":
        return all(int(p) <= 255 for p in m[0].split("."))
    if kind == "card":
        odd = digits[-1::-2]
        even = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
        return 12 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def base(text, kinds):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, k in enumerate(kinds) for m in PATTERNS[k].finditer(text or "") if good(k, m)]
    spans = [s for _, _, s in sorted(found)]
    return [sum(s.startswith(k + ":") for s in spans) for k in kinds], hashlib.sha256(",".join(spans).encode()).hexdigest()


def same(out, rows, kinds):
    want = sorted([r[0] is None, r[0] or 0, *base(r[1], kinds)[0], base(r[1], kinds)[1]] for r in rows)
    assert sorted([r["doc_id"] is None, r["doc_id"] or 0, *[r[f"n_{k}"] for k in kinds], r["base_sha256"]] for r in out) == want


def test_secrets_agree_with_regular_expressions(docs, rows):
    found, _ = secrets.scan_versions(docs)
    same(secrets.secret_report(found).collect(), rows, ["assign", "access", "hex"])


def test_added_kinds_of_secrets(docs):
    found, _ = secrets.scan_versions(docs)
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_report(found).collect()}
    assert "ghp:" in spans[16] and "hex:" in spans[15]


def test_ledger_scans_only_what_it_lacks(spark, docs):
    found, new = secrets.scan_versions(docs)
    new = new.cache()
    again, fresh = secrets.scan_versions(docs, ledger=new)
    assert fresh.count() == 0
    key = lambda r: (r["doc_id"] or -1, r["blob"], str(r["spans"]))
    assert sorted(map(key, again.collect())) == sorted(map(key, found.collect()))
    _, other_rules = secrets.scan_versions(docs, ledger=new, rule_version="next")
    assert other_rules.count() == new.count()
    more = docs.limit(1).withColumn("text", docs["text"]).unionByName(spark.createDataFrame([(99, "token=abcdefghij", "en", "a", 1, "x")], docs.schema))
    assert secrets.scan_versions(more, ledger=new)[1].count() == 1


def test_a_ledger_with_repeated_rows_counts_once(spark, docs):
    found, new = secrets.scan_versions(docs)
    again, fresh = secrets.scan_versions(docs, ledger=new.unionByName(new).unionByName(new))
    key = lambda r: (r["doc_id"] or -1, r["blob"], str(r["spans"]))
    assert fresh.count() == 0 and sorted(map(key, again.collect())) == sorted(map(key, found.collect()))


def hostile(n):
    """Long texts of what begins a match, again and again."""
    parts = ["eyJ", "://:", "://" + ":" * 50, "a@", "1.", "+1(", "password ", "token=", "-----BEGIN ", "AKIA", "0", "account: ", "ghp_", "%.", "'\""]
    return [(i, (p * (n // len(p) + 1))[:n]) for i, p in enumerate(parts)] + [(100, "://" + ":" * n), (101, "eyJ" + "a" * n), (102, "secret=abcdefgh1 " * (n // 17))]


def test_hostile_texts_take_time_by_their_length(spark):
    import time

    finder = pii.PiiFinder()
    for _, text in hostile(1_000_000):
        began = time.perf_counter()
        finder.find(text)
        assert time.perf_counter() - began < 30
    rows = spark.createDataFrame(hostile(1_000_000), "doc_id long, text string").repartition(8)
    began = time.perf_counter()
    out = {r["doc_id"]: r for r in secrets.secret_report(secrets.scan_versions(rows)[0]).collect()}
    assert time.perf_counter() - began < 60
    assert out[102]["n_assign"] == 1_000_000 // 17 and out[102]["spans"].startswith("assign:0:16,assign:17:33,")


def test_token_begins_a_run(spark):
    jwt = "eyJabcdefgh.eyJabcdefgh.abcdefgh"
    rows = spark.createDataFrame([(1, jwt), (2, "x" + jwt), (3, f"a,{jwt} {jwt}"), (4, "." + jwt)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_report(secrets.scan_versions(rows)[0]).collect()}
    assert spans == {1: "jwt:0:32", 2: "", 3: "jwt:2:34,jwt:35:67", 4: "jwt:1:33"}


def test_secrets_run_no_python(docs):
    plan = secrets.secret_report(secrets.scan_versions(docs)[0])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pii_agrees_with_regular_expressions(docs, rows):
    same(pii.pii_report(pii.find_pii(docs, ["doc_id"])).collect(), rows, pii.BASE_KINDS)


def test_pii_on_made_up_texts(spark):
    import random

    rng = random.Random(5)
    parts = ["1", "23", ".", "@", "a", "b-c", "+", " ", "-", "(", ")", "255", "4111111111111111", "%", "_", "é", "\n", "account: 12345678", "://"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), None, None, 0, "x") for i in range(3000)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    same(pii.pii_report(pii.find_pii(made, ["doc_id"])).collect(), rows, pii.BASE_KINDS)


def test_added_kinds_of_personal_data():
    finder = pii.PiiFinder()
    kinds = lambda t: [pii.KINDS[k] for _, k, _ in finder.find(t)]
    assert "account" in kinds("IBAN: DE89 3704 0044 0532 0130 00 thanks")
    assert "account" not in kinds("IBAN: DE88370400440532013000")
    assert kinds("see https://user:pw@host.example/x") == ["url", "email"]
    assert kinds("see https://host.example/x?a=1 and account settings") == []


def test_redaction_keeps_rows_and_other_columns(docs, rows):
    out = pii.redact(docs, length_col="n_chars")
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    text = next(r["text"] for r in got if r["doc_id"] == 13)
    assert "<EMAIL>" in text and "<PHONE>" in text and "<IP>" in text and "<CARD>" in text and "10.0.0.256" in text
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    assert next(r for r in got if r["doc_id"] == 0)["text"] is None


def test_empty_tables(no_docs):
    assert secrets.secret_report(secrets.scan_versions(no_docs)[0]).count() == 0
    assert pii.pii_report(pii.find_pii(no_docs, ["doc_id"])).count() == 0
    assert pii.redact(no_docs).count() == 0
