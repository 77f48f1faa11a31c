"""Secret scans: an Aho-Corasick keyword prefilter, anchored patterns only at its hits, then
checks of embedded checksums.

Three base kinds are always reported: ``assign`` (keyword assignments), ``access`` (AKIA ids)
and ``hex`` (long hexadecimal runs, which have no keyword and are found by their run). Tokens
with an embedded check add kinds of their own.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.shared import map_arrow, whole

#: Order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)")
#: The run that a JWT begins with. All starts in one run end at the same dot, so they match or fail together.
JWT_RUN = re.compile(r"eyJ[A-Za-z0-9_-]++")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Lower-case keyword to kind.
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
    "eyj": "jwt",
}

_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (kind, len(word)))
        a.make_automaton()
        _automaton = a
    return _automaton


def crc_base62(body: str) -> str:
    """The six base-62 digits of the CRC-32 of ``body``."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def jwt_header(part: str) -> bool:
    try:
        got = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and "alg" in got


#: Kind to (pattern, acceptance of a match). A match that is not accepted still consumes its text.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 16),
    "github": (GITHUB, lambda m: crc_base62(m[1]) == m[2]),
    "npm": (NPM, lambda m: crc_base62(m[1]) == m[2]),
    "jwt": (JWT, lambda m: jwt_header(m[1])),
}


def ascii_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind."""
    out = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    last: dict[str, int] = {}
    for end, (kind, size) in automaton().iter(ascii_lower(text)):
        start = end - size + 1
        if start < last.get(kind, 0):
            continue
        pattern, accept = RULES[kind]
        m = pattern.match(text, start)
        if m:
            last[kind] = m.end()
            if accept(m):
                out.append((kind, m.start(), m.end()))
        elif kind == "jwt" and (run := JWT_RUN.match(text, start)):
            last[kind] = run.end()
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs(doc_id, text, ...)``.

    A null text counts as empty: no spans, an empty span string, and the digest of the empty
    string. Repeated rows and null doc_ids each give a row. An empty table gives an empty
    result. Other columns are ignored. Whole texts of any length are scanned, in linear time.
    """

    def run(batch):
        found = [find_spans(t) for t in batch.column("text").to_pylist()]
        text_of = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        base = [[s for s in spans if s[0] in KINDS[:3]] for spans in found]
        count = lambda kind: pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                count("assign"),
                count("access"),
                count("hex"),
                pa.array([hashlib.sha256(text_of(s).encode()).hexdigest() for s in base], pa.string()),
                pa.array([text_of(s) for s in found], pa.string()),
            ],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    return map_arrow(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text")),
        run,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    )
