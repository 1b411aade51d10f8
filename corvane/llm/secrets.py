"""Secret scans: Aho-Corasick prefilter, anchored expressions near the hits, checksums last.

One automaton holds every literal that a secret can begin with. Expressions run only where it hits, anchored at the
hit, so a text without hits costs one pass of the automaton. Runs of hex digits have no literal to begin with; one
character-class expression finds them. Kinds that carry a checksum are kept only if it holds.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corvane.llm.common import map_batches

# The three base kinds, in this order, their expressions and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
BASE_KINDS = ("assign", "access", "hex")

# Kinds beyond the base, with the literals that open them.
GITHUB = re.compile(r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT_HEAD, JWT_LEAST = "eyJ", 11
JWT_RUN, JWT_REST = re.compile(r"[A-Za-z0-9_-]*"), re.compile(r"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----")
MORE_KINDS = ("github", "npm", "jwt", "pem")
KINDS = BASE_KINDS + MORE_KINDS

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

OPENERS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
EXPRESSIONS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "pem": PEM}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in OPENERS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _crc_holds(token: str) -> bool:
    """The last six characters are the base-62 CRC-32 of the random part between the prefix and them."""
    value = 0
    for c in token[-6:]:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(token[4:-6].encode())


def _jwt_holds(token: str) -> bool:
    """The header decodes to JSON that names an algorithm."""
    head = token.partition(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= ASSIGN_LEAST
    if kind == "access":
        return len(m[0]) >= ACCESS_LEAST
    if kind in ("github", "npm"):
        return _crc_holds(m[0])
    return True


def _jwts(text: str, starts: list[int]) -> list[tuple[int, int, str]]:
    """Tokens that begin at hits. All hits in one run of characters share the run's end and what follows it, so a run is read once."""
    out, at, end, rest = [], 0, 0, None
    for start in starts:
        if start < at or not text.startswith(JWT_HEAD, start):
            continue
        if start >= end:
            end = JWT_RUN.match(text, start).end()
            rest = JWT_REST.match(text, end)
        if rest and end - start >= JWT_LEAST:
            at = rest.end()
            if _jwt_holds(text[start:at]):
                out.append((start, at, "jwt"))
    return out


def _folded(text: str) -> str:
    """Lower case, each character in its place (one capital letter's lower case is two characters)."""
    low = text.lower()
    return low if len(low) == len(text) else text.replace("İ", "I").lower()


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret by start, then kind as listed. Within a kind they are leftmost and don't overlap."""
    if not text:
        return []
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in _automaton().iter(_folded(text)):
        hits.setdefault(kind, []).append(end - n + 1)
    if "jwt" in hits:
        spans += _jwts(text, sorted(hits.pop("jwt")))
    for kind, starts in hits.items():
        at, expression = 0, EXPRESSIONS[kind]
        for start in sorted(starts):
            # A match that fails its check still takes up its characters.
            if start >= at and (m := expression.match(text, start)):
                at = m.end()
                if _valid(kind, m):
                    spans.append((start, at, kind))
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str | None, spans: list[tuple[int, int, str]] | None = None) -> str | None:
    """text with every secret replaced by [kind]; of overlapping ones the first to begin names the place. Null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in scan(text) if spans is None else spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_more of every row, null and empty texts with no span.

    Rows are scanned one by one in the map stage, without a shuffle; repeated rows give repeated results.
    """

    def run(ids: list, texts: list) -> list:
        found = [scan(t) for t in texts]
        base = [[s for s in spans if s[2] in BASE_KINDS] for spans in found]
        counts = [[sum(s[2] == kind for s in spans) for spans in base] for kind in BASE_KINDS]
        return [ids, *counts, [hashlib.sha256(joined(s).encode()).hexdigest() for s in base], [joined(s) for s in found], [len(f) - len(b) for f, b in zip(found, base, strict=True)]]

    longs = [StructField(f"n_{kind}", LongType()) for kind in BASE_KINDS]
    schema = StructType([docs.schema[id], *longs, StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_more", LongType())])
    return map_batches(docs.select(id, text), run, schema)


def redact_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with secrets replaced in text, and n_chars that of the new text where it changed; all rows and columns stay."""
    names = docs.columns
    at = names.index(text)

    def run(*columns: list) -> list:
        columns = list(columns)
        old = columns[at]
        columns[at] = [redact(t) for t in old]
        if n_chars in names:
            k = names.index(n_chars)
            columns[k] = [n if a == b else len(b) for n, a, b in zip(columns[k], old, columns[at], strict=True)]
        return columns

    return map_batches(docs, run, docs.schema)
