"""Secret scans: patterns, and a guess-cost dynamic programme on values in credential context.

The base finds assignments, access keys and long hex runs. The method looks at
every value that stands in a credential context (wider than the base's: more
names, more characters) and computes the least number of guesses that make it
up: a minimum-cost segmentation into common words, dates, repeats, keyboard
walks and brute-force spans. Values that cost enough guesses are secrets;
placeholders ("changeme", "aaaaaaaa", "qwerty123") are cheap and left alone.

Python on Arrow batches: offsets are code points of whole texts, and the
programme is sequential per value. Rows stay where they are: no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
CONTEXT = re.compile(r"(?:pass(?:word|wd|phrase)|pwd|secret|token|api_?key|credentials?|private_?key|access_?key|auth(?:orization)?)[\"']?\x20*(?::|=|\x20is\x20)\x20*(?:bearer\x20+)?[\"']?([^\s\"'<>,;]{6,})", re.A | re.I)
NEAR = re.compile(r"pass|pwd|secret|token|api|cred|key|auth", re.A | re.I)

#: Words that credential values are often made of, by rank of use.
WORDS = ("password", "admin", "welcome", "login", "user", "test", "root", "secret", "changeme", "default", "example", "letmein", "master", "dragon", "monkey", "football", "baseball", "sunshine", "princess", "shadow", "superman", "batman", "trustno", "hello", "freedom", "whatever", "qazwsx", "michael", "jordan", "summer", "winter", "spring", "autumn", "token", "key", "api", "your", "here", "none", "null", "true", "false", "placeholder", "redacted", "sample", "demo", "guest", "system", "server", "public", "private", "company", "love", "iloveyou", "money", "pass", "word", "temp", "abc", "my", "the", "is", "this", "not", "set", "value", "string", "insert", "replace", "todo", "xxx")
#: Rows of a keyboard, for walks along them.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SWAPS = str.maketrans("@430$1!5+", "aaeosiist")
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {b + a for row in ROWS for a, b in zip(row, row[1:], strict=False)}
DATES = tuple(map(re.compile, (r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", r"(?:19|20)\d\d")))
#: Guesses, as powers of ten, from which a value counts as a secret.
LEAST = 10.0


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def _copies(code: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """For each end, ranges (first, last) of starts from which the value repeats what stands a unit of two or more before, for a unit at least."""
    n, out = len(code), {}
    first = np.full(n + 1, n + 1)  # a start that a shorter unit reaches from this end is not listed again
    for unit in range(2, n // 2 + 1):
        same = code[unit:] == code[:-unit]
        edges = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
        for k in np.flatnonzero(np.diff(edges) > unit):
            start, end = int(edges[k]) + 1 + unit, int(edges[k + 1]) + unit
            ends = np.arange(start + unit, end + 1)
            ends = ends[first[ends] > start]
            first[ends] = start
            for i in ends.tolist():
                out.setdefault(i, []).append((start, i - unit))
    return out


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes.

    cost[i] is the least over all last spans that end at i, so the result is
    the least over all segmentations. A word costs its rank (twice for
    capitals, twice for swapped characters), a date 365.25 x 120 (a year alone
    120), three or more equal characters their alphabet times their count, a
    keyboard walk of four or more 47 starts and two turns a step, a repeat (of
    two characters or more, once or more) the number of characters repeated,
    brute force its alphabet per character (hex digits 16 in values of hex
    digits only). Each span but brute force further adds a factor for the order
    of spans. Square in the length for the repeats, over bytes in numpy. An
    empty value costs 0.
    """
    n = len(value)
    plain = value.lower().translate(SWAPS)
    lower = value.lower()
    if len(lower) != n:  # a letter whose lower case is longer
        plain, lower = value.translate(SWAPS), value
    hexed = bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))
    cost, place = np.zeros(n + 1), np.arange(n + 1)
    logs = np.log10(np.maximum(place, 1))
    dates: dict[int, list[tuple[int, float]]] = {}
    for start in range(n):
        for date in DATES:
            if m := date.match(value, start):
                dates.setdefault(m.end(), []).append((start, math.log10(120 if m.end() - start == 4 else 365.25 * 120)))
    copies = _copies(np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32))
    walk = run = 0  # where the longest walk and run of equal characters that end at i start
    for i in range(1, n + 1):
        c = value[i - 1]
        best = cost[i - 1] + (math.log10(16) if hexed else _alphabet(c))
        for k in range(2, min(LONGEST, i) + 1):
            if r := RANK.get(plain[i - k : i]):
                twice = (lower[i - k : i] != value[i - k : i]) + (plain[i - k : i] != lower[i - k : i])
                best = min(best, cost[i - k] + math.log10(r + 1) + 0.3 * twice + 0.3)
        for start, x in dates.get(i, ()):
            best = min(best, cost[start] + x + 0.3)
        if i > 1:
            if lower[i - 2 : i] not in NEXT:
                walk = i - 1
            if i - walk >= 4:
                best = min(best, math.log10(47) + (cost[walk : i - 3] + 0.3 * (i - place[walk : i - 3])).min())
            if value[i - 1] != value[i - 2]:
                run = i - 1
            if i - run >= 3:
                best = min(best, _alphabet(c) + 0.3 + (cost[run : i - 2] + logs[i - place[run : i - 2]]).min())
        for start, last in copies.get(i, ()):
            best = min(best, 0.3 + (cost[start : last + 1] + logs[i - place[start : last + 1]]).min())
        cost[i] = best
    return float(cost[n])


def spans_of(text: str, least: float = LEAST) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans of a text, (start, kind's place, end, kind) order."""
    base: list[tuple[int, int, str]] = []
    added: list[tuple[int, int, str]] = []
    if NEAR.search(text):
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        added += [(m.start(1), m.end(1), "guess") for m in CONTEXT.finditer(text) if guess_cost(m[1].rstrip(".:!?)]}")) >= least]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return base, added


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


SCHEMA = "doc_id {id}, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans) of every row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind; ``guess`` spans cover values in credential context whose cheapest
    guess path takes 10 ** ``least`` guesses or more. Null and empty texts
    have no span (the hash is that of an empty string); repeated rows are
    scanned each; extra columns are ignored; an empty table gives no rows.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    schema = SCHEMA.format(id=d.schema["doc_id"].dataType.simpleString())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans")}
            for text in batch.column(1):
                base, added = spans_of(text.as_py() or "", least)
                for k in KINDS[:3]:
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["n_guess"].append(len(added))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(base + added))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], ["doc_id", *out])

    return d.mapInArrow(scan, schema)
