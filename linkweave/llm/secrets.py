"""Find credentials in texts.

One Aho-Corasick pass over the lower-cased text finds the places where a rule
could begin; a regular expression anchored at that place decides; kinds with an
embedded checksum are then verified.  Long runs of hexadecimal digits have no
keyword; a search for such runs takes the automaton's part for them.

Kinds, in the order used for ties: ``assign``, ``access`` and ``hex`` have no
checksum.  ``github`` ends in a base-62 CRC-32 of its random part, ``card`` has
a Luhn digit, ``iban`` is 1 modulo 97, ``jwt`` starts with a JSON header that
names its algorithm, ``pem`` is a private key's opening line.

Defined cases: a null text is empty; an empty text or one without secrets has
counts of 0 and empty lists; every input row gives one row, repeated rows
included; the id may be null; further input columns, whatever their names, are
ignored; an empty table gives no rows.  Whole texts are read, one at a time; a
card or account number counts if it begins within ``NEAR`` characters of its
keyword or of another such number.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import table

KINDS = ("assign", "access", "hex", "github", "card", "iban", "jwt", "pem")
BASE = 3

# The forms of the kinds.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])*", re.ASCII)
CARD_LENGTHS = tuple(range(19, 12, -1))
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])*")
IBAN_LENGTHS = {"AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29}
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "card": "card",
    "visa": "card",
    "iban": "iban",
    "eyj": "jwt",
    "-----begin": "pem",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Characters after a card or account keyword, or after a number found so, in which a number may begin.
NEAR = 24
#: Characters that one card or account number may take, separators included.
SPAN = 72


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed([int(x) for x in digits])):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base62_crc(text: str) -> str:
    n, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def jwt_ok(text: str) -> bool:
    head = text.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error, RecursionError):
        return False


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in zip(text, map(str.lower, text), strict=True))


def _numbers(kind: str, text: str, at: int) -> Iterator[tuple[int, int]]:
    """Checked numbers that begin soon after a keyword's end, or after the number before.

    At each place where a number may begin every admissible length is tried, the
    longest first: of a country's accounts its own, else all.
    """
    form, end = (CARD if kind == "card" else IBAN), at + NEAR
    while (m := form.search(text, at, min(len(text), end + SPAN))) and m.start() <= end:
        places = [i for i in range(*m.span()) if text[i].isalnum()]
        own = IBAN_LENGTHS.get(text[m.start() : m.start() + 2])
        lengths = CARD_LENGTHS if kind == "card" else (own,) if own else tuple(range(34, 14, -1))
        at = m.start() + 1
        for n in lengths:
            if n <= len(places):
                stop = places[n - 1] + 1
                found = "".join(text[i] for i in places[:n])
                if not text[stop : stop + 1].isalnum() and (luhn(found) if kind == "card" else iban_ok(found)):
                    yield m.start(), stop
                    at, end = stop, stop + NEAR
                    break


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret, sorted; kind counts from 0."""
    out: set[tuple[int, int, int]] = set()
    ends = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - n, n, kind) for end, (n, kind) in _automaton().iter(_lower(text)))
    for start, n, kind in hits:
        k = KINDS.index(kind)
        if start < ends[kind] and kind not in ("card", "iban"):
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                ends[kind] = m.end()
                if m.end(1) - m.start(1) >= 8:
                    out.add((start, k, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                ends[kind] = m.end()
                if m.end() - start >= 16:
                    out.add((start, k, m.end()))
        elif kind == "github":
            if (m := GITHUB.match(text, start)) and base62_crc(m[1]) == m[2]:
                ends[kind] = m.end()
                out.add((start, k, m.end()))
        elif kind == "jwt":
            if (m := JWT.match(text, start)) and jwt_ok(m.group()):
                ends[kind] = m.end()
                out.add((start, k, m.end()))
        elif kind == "pem":
            if m := PEM.match(text, start):
                ends[kind] = m.end()
                out.add((start, k, m.end()))
        else:
            out.update((a, k, b) for a, b in _numbers(kind, text, start + n))
    out.update((m.start(), 2, m.end()) for m in HEX.finditer(text))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    join = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for value in batch.column(1):
            spans = spans_of(value.as_py() or "")
            kinds = [k for _, k, _ in spans]
            base = join([x for x in spans if x[1] < BASE])
            row = (*(kinds.count(k) for k in range(BASE)), hashlib.sha256(base.encode()).hexdigest(), join(spans), len(spans))
            for col, x in zip(cols, row, strict=True):
                col.append(x)
        kinds_of = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds_of, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
