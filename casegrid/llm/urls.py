"""URL filters: host and path rules, and logistic regression on hashed character n-grams where no rule fits."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: Fixed values: (verdict, host, path). A rule fits its host and all subdomains where the path starts with its path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The small labelled URL table that the model learns from: words of site names to keep and to block. Names are pairs of
#: words, on hosts and paths that go round the same lists for both, so that nothing but the words tells them apart.
GOOD_WORDS = """city library garden tools river museum bridge village lake school wood statistics soup medicine software teacher
math weather poetry train map court symphony travel bird book harbour mountain saint theatre northern farm painter hospital reading
astronomy seaside atlas bakery rowing tennis chess heritage forest stone winter song language physics geology history choir parish
archive station law energy design science film opera wildlife""".split()
BAD_WORDS = """casino viagra pills adult xxx porn free spins loans payday replica poker betting bet click ads weight-loss torrent warez
crypto malware seo lottery winner login slots jackpot discount singles tracker win spam farm keygen crack dating prize bonus cheap
popup meds nude hacked""".split()
_PLACES = ["", "www.", "m.", "blog."]
_ENDINGS = ["com", "example.com", "org", "example.org", "net", "example.net", "info"]
_PATHS = ["/en/412", "/de/11/", "/fr/8815.html", "/es/97", "/", "/archive/1987", "/en/7/", "", "/thread/9912"]


def site_names(words: list[str]) -> list[str]:
    """Three names of each word, with the words at some distances from it."""
    return [f"{w}{'-' if (i + step) % 3 else ''}{words[(i + step) % len(words)]}" for step in (1, 5, 11) for i, w in enumerate(words)]


def labelled_urls(names: list[str]) -> list[str]:
    """An URL for each name."""
    return [f"http{'s' * (n % 2)}://{_PLACES[n % 4]}{name}.{_ENDINGS[n % 7]}{_PATHS[n % 9]}" for n, name in enumerate(names)]


GOOD_URLS, BAD_URLS = labelled_urls(site_names(GOOD_WORDS)), labelled_urls(site_names(BAD_WORDS))
BITS, GRAMS = 15, (3, 4, 5)
#: Probability of being unwanted from which an URL without a rule is blocked.
BLOCK_FROM = 0.5


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty where there is no '://'."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return (host if not any("A" <= c <= "Z" for c in host) else "".join(c.lower() if c.isascii() else c for c in host)), path


def fit_rule(host: str, path: str, rules: list[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    best = max((r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    return best and (best[1] + best[2], best[0])


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the hashed n-grams of the host and of the path."""
    found = set()
    for kind, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            for i in range(len(part) - n + 1):
                found.add(zlib.crc32((kind + part[i : i + n]).encode("utf-8", "replace")) & ((1 << BITS) - 1))
    return np.fromiter(found, np.int64, len(found))


@functools.lru_cache(maxsize=4)
def train(good: tuple[str, ...] = tuple(GOOD_URLS), bad: tuple[str, ...] = tuple(BAD_URLS), rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-regularised logistic regression by gradient descent from zero: the same for the same table.
    Every example counts as a unit vector, so long URLs weigh no more than short ones."""
    rows = [features(*split_url(u)) for u in (*good, *bad)]
    wanted = np.array([0.0] * len(good) + [1.0] * len(bad))
    held = np.unique(np.concatenate(rows)) if rows else np.empty(0, np.int64)
    x = np.zeros((len(rows), len(held)))
    for i, r in enumerate(rows):
        x[i, np.searchsorted(held, r)] = 1 / np.sqrt(max(1, len(r)))
    v, b = np.zeros(len(held)), 0.0
    for _ in range(rounds):
        gap = 1 / (1 + np.exp(-(x @ v + b))) - wanted
        v -= rate * (x.T @ gap / len(rows) * 10 + decay * v)
        b -= rate * gap.mean()
    w = np.zeros(1 << BITS)
    w[held] = v
    return w, b


def unwanted(host: str, path: str, model: tuple[np.ndarray, float]) -> float:
    """The model's probability that the URL is unwanted; 0.5 shifted by the bias alone for an URL without host and path."""
    w, b = model
    f = features(host, path)
    return float(1 / (1 + np.exp(-(w[f].sum() / np.sqrt(max(1, len(f))) + b))))


def judge_urls(pages: DataFrame, key: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, labelled: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """key, host, path, rule, verdict and score (the model's probability; null where a rule decides) of each row.

    A null URL, or one without '://', has empty host and path and gets the model's verdict on them. Repeated rows are
    judged each; other columns aren't read. An empty table gives none. The model has 2**BITS weights whatever the input,
    and is trained from the small table before tasks start.
    """
    rules = RULES if rules is None else rules
    model = train(*map(tuple, labelled)) if labelled else train()

    def one(url: str | None) -> tuple:
        host, path = split_url(url)
        if fit := fit_rule(host, path, rules):
            return host, path, fit[0], fit[1], None
        p = unwanted(host, path, model)
        return host, path, None, "block" if p >= BLOCK_FROM else "allow", p

    fields = [("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64())]
    make = lambda: lambda urls: list(zip(*map(one, urls), strict=True)) if urls else [[]] * 5
    return map_texts(pages, make, [key], url_col, fields, "host string, path string, rule string, verdict string, score double")
