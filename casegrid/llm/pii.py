"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, scheme separators and identifier cues. From each
anchor a small local parser expands to the boundaries of the address, number or account and validates it.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Kinds in the order in which spans that start together are listed; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "account", "url"]
BASE_KINDS = KINDS[:4]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CUES = ["account", "acct", "iban", "passport", "ssn", "kontonummer", "compte", "cuenta"]
_AFTER_CUE = re.compile(r"(?:[ ]?(?:no|nr|number|num|id))?[ ]?[.:#=]{0,2}[ ]?([A-Z]{0,2}[0-9](?:[ -]?[A-Z0-9]){4,33})(?![A-Za-z0-9])")
#: User data, with or without a password, before a host. No part can hold what ends the one before, so it never goes back.
_AUTHORITY = re.compile(r"[^\s/?#@]+@[A-Za-z0-9.-]+(?::[0-9]+)?")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", "@")
    found.add_word("+", "+")
    found.add_word("://", ":")
    for digit in "0123456789":
        found.add_word(digit, "d")
    for cue in _CUES:
        for spelt in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(spelt, "a")
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(account: str) -> bool:
    moved = account[4:] + account[:4]
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


class PiiFinder:
    """Spans (start, kind's place in KINDS, end) of one text, by start and then kind."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        spans: list[tuple[int, int, int]] = []
        email_to = ip_to = card_to = phone_to = account_to = url_to = 0
        for at, kind in self.anchors.iter(text):
            if kind == "d":
                if at >= ip_to and (at == 0 or text[at - 1] not in "0123456789") and (m := _IP.match(text, at)):
                    ip_to = m.end()
                    if all(map(_small, m[0].split("."))):
                        spans.append((at, 1, ip_to))
                if at >= card_to and (m := _CARD.match(text, at)):
                    card_to = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append((at, 2, card_to))
            elif kind == "@":
                start = at
                while start > email_to and text[start - 1] in _LOCAL:
                    start -= 1
                if at >= email_to and start < at and (m := _DOMAIN.match(text, at + 1)):
                    email_to = m.end()
                    spans.append((start, 0, email_to))
            elif kind == "+":
                if at >= phone_to and (m := _PHONE.match(text, at)):
                    phone_to = m.end()
                    if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                        spans.append((at, 3, phone_to))
            elif kind == "a":
                if at >= account_to and (m := _AFTER_CUE.match(text, at + 1)):
                    account = m[1].replace(" ", "").replace("-", "")
                    if sum(c in "0123456789" for c in account) >= 5 and (account[:2].isdigit() or not account[:2].isalpha() or _iban(account)):
                        account_to = m.end(1)
                        spans.append((m.start(1), 4, account_to))
            elif at >= url_to and (m := _AUTHORITY.match(text, at + 1)):
                start = at - 2
                while start > url_to and (text[start - 1].isascii() and text[start - 1].isalnum()):
                    start -= 1
                url_to = m.end()
                spans.append((start, 5, url_to))
        spans.sort()
        return spans


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The key columns and spans array<struct<kind,start,end>> of each row, in code points with an exclusive end.

    Base kinds are leftmost non-overlapping matches of their patterns of which invalid ones are dropped. Added kinds are
    account (what follows an identifier cue; with a leading country code it must be a valid IBAN) and url (an address with
    user data before its host). A null or empty text has no span; rows are independent of each other, so repeated rows,
    ties and null keys change nothing; columns other than keys and text aren't read. An empty table gives none.
    """

    def make():
        finder = PiiFinder()
        return lambda texts: ([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in finder.find(t)] for t in texts],)

    return map_texts(docs, make, keys, text_col, [("spans", _SPANS)], "spans array<struct<kind:string,start:int,end:int>>")


def redact_text(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind's mark."""
    if not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with every span of its texts replaced by a mark such as <EMAIL>; other columns and their order stay.

    length_col, if the table has it, becomes the new length. Null texts stay null.
    """
    others = [c for c in docs.columns if c != text_col]

    def make():
        finder = PiiFinder()
        return lambda texts: ([redact_text(t, finder.find(t)) for t in texts],)

    out = map_texts(docs, make, others, text_col, [("redacted_", pa.string())], "redacted_ string")
    columns = {c: F.col(f"`{c}`") for c in others} | {text_col: F.col("redacted_").alias(text_col)}
    if length_col in columns and length_col != text_col:
        kind = docs.schema[length_col].dataType
        columns[length_col] = F.when(F.col("redacted_").isNull(), F.col(length_col)).otherwise(F.length("redacted_").cast(kind)).alias(length_col)
    return out.select(*[columns[c] for c in docs.columns])


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of find_pii's spans."""
    spans = F.col("spans")
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(key, *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(spans).alias("spans"))
