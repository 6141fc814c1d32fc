"""Scanning texts for secrets.

An Aho-Corasick automaton over the keywords finds in one pass where a pattern can start;
the patterns are matched anchored at those places and nowhere else. Runs of hexadecimal
digits have no keyword and are found by their own scan. Kinds with an embedded checksum
are only reported if it holds.

Base kinds (leftmost, non-overlapping within a kind, failing matches dropped):

* ``assign``: a keyword, an assignment sign and a value of 12 characters or more,
* ``access``: ``AKIA`` and capitals or digits, 18 characters or more,
* ``hex``: 16 or more of ``0-9a-f``.

Added by the method:

* ``forge``: ``gh?_`` tokens whose last six characters are the CRC-32 of the thirty
  before them in base 62,
* ``jwt``: three dot-joined base64url parts, the first of which decodes to a JSON object
  with ``alg``,
* ``pem``: the opening line of a private key.

Positions are code points, the end exclusive. Defined cases: null and empty texts have no
spans; spans that start at one place are ordered by kind as listed; repeated rows are scanned one by one; an
empty table gives an empty result. Texts of any length are scanned whole. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.base import LOWER, UPPER, read

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
FORGE = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
KINDS = ("assign", "access", "hex", "forge", "jwt", "pem")
BASE, JWT_KIND = 3, KINDS.index("jwt")
RUN = re.compile(r"[A-Za-z0-9_-]*")
#: Keywords in lower case, with the kind whose pattern can start there.
KEYWORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1, "eyj": 4, "-----begin": 5} | {f"gh{c}_": 3 for c in "pousr"}
PATTERNS = {0: ASSIGN, 1: ACCESS, 3: FORGE, 4: JWT, 5: PEM}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def base62(n: int, width: int) -> str:
    out = ""
    for _ in range(width):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def forge_holds(token: str) -> bool:
    body = token.partition("_")[2]
    return base62(zlib.crc32(body[:30].encode()), 6) == body[30:]


def jwt_holds(token: str) -> bool:
    head = token.partition(".")[0]
    try:
        told = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):  # no JSON, or nested too deeply to be a header
        return False
    return isinstance(told, dict) and "alg" in told


def holds(kind: int, m: re.Match) -> bool:
    if kind == 0:
        return len(m[1]) >= 12
    if kind == 1:
        return m.end() - m.start() >= 18
    return {3: forge_holds, 4: jwt_holds}.get(kind, bool)(m[0])


def spans_of(text: str, a: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """``start, kind, end`` in order."""
    low = text.lower()
    if len(low) != len(text):  # some letters grow in lower case, which would move the positions
        low = text.translate(FOLD)
    starts = sorted({(kind, end + 1 - n) for end, (kind, n) in a.iter(low)})
    found, last, free = [], -1, 0
    for kind, at in starts:
        if kind != last:
            last, free = kind, 0
        if at < free:
            continue
        if m := PATTERNS[kind].match(text, at):
            free = m.end()
            if holds(kind, m):
                found.append((at, kind, free))
        elif kind == JWT_KIND:  # what follows the run decides, for later starts in it too
            free = RUN.match(text, at).end()
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a = automaton()
    say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    for b in batches:
        rows = []
        for text in b["body"]:
            spans = spans_of(text, a) if isinstance(text, str) else []
            kinds = [k for _, k, _ in spans]
            told = say(x for x in spans if x[1] < BASE)
            rows.append((*(kinds.count(k) for k in range(BASE)), hashlib.sha256(told.encode()).hexdigest(), say(spans), sum(k >= BASE for k in kinds)))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])
        out.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
        yield out


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added``."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("body")).mapInPandas(scan, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"))
