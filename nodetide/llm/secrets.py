"""Secrets in texts: an Aho-Corasick keyword prefilter, anchored patterns at its hits, then checks of embedded checksums.

One pass of the automaton over a lower-cased text finds every keyword; a pattern is tried only where its keyword stands.
Matches of one kind do not overlap, the leftmost wins, as a scan of the whole text by the pattern would give. Runs of hex
digits have no keyword and are found by one search for runs that are long enough. Provider tokens carry a checksum of
their own (six base-62 digits of a CRC-32); tokens that fail it are no secrets. JSON web tokens need a readable header.
"""

from __future__ import annotations

import base64
import bisect
import functools
import json
import re
import zlib

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import prepare

# Kinds in the order of the report, keywords, patterns.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "private_key")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "private_key": ("-----begin",),
}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT_START, JWT_RUN, JWT_REST = "eyJ", re.compile(r"[A-Za-z0-9_-]*"), re.compile(r"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
PRIVATE_KEY_END = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

SPAN = "kind string, start long, end long"


def checksum(payload: str) -> str:
    """Six base-62 digits of the payload's CRC-32."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def _checked(body: str) -> bool:
    return checksum(body[:-6]) == body[-6:]


def _header(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


class _Ends:
    """What hits of one text share, so that no stretch of it is scanned once for each hit: runs of token characters and what
    follows them, and the closing lines of key blocks."""

    def __init__(self, text: str):
        self.text, self.run, self.rest = text, (0, 0), None

    def token(self, at: int) -> tuple[int, int | None]:
        """End of the run of token characters at `at`, and end of the further two parts of a web token behind it."""
        if not self.run[0] <= at < self.run[1]:
            end = JWT_RUN.match(self.text, at).end()
            rest = JWT_REST.match(self.text, end)
            self.run, self.rest = (at, end), rest.end() if rest else None
        return self.run[1], self.rest

    @functools.cached_property
    def closings(self) -> tuple[list[int], list[int]]:
        found = [m.span() for m in PRIVATE_KEY_END.finditer(self.text)]
        return [a for a, _ in found], [b for _, b in found]

    def key_block(self, at: int) -> int | None:
        """End of a private key block that starts here, its last line included; of the first line if it is not closed."""
        first = PRIVATE_KEY.match(self.text, at)
        if not first:
            return None
        starts, ends = self.closings
        i = bisect.bisect_left(starts, first.end())
        if i == len(starts):
            return first.end()
        other = self.text.find("-----BEGIN", first.end(), starts[i])
        return ends[i] if other < 0 else first.end()


#: For each kind with keywords: from (text, position, ends) to (end of the match or None, whether it counts).
def _try_assign(text, at, ends):
    m = ASSIGN.match(text, at)
    return (m.end(), len(m[2]) >= LEAST_ASSIGN) if m else (None, False)


def _try_access(text, at, ends):
    m = ACCESS.match(text, at)
    return (m.end(), m.end() - at >= LEAST_ACCESS) if m else (None, False)


def _try_github(text, at, ends):
    m = GITHUB.match(text, at)
    return (m.end(), _checked(m[1])) if m else (None, False)


def _try_npm(text, at, ends):
    m = NPM.match(text, at)
    return (m.end(), _checked(m[1])) if m else (None, False)


def _try_jwt(text, at, ends):
    if not text.startswith(JWT_START, at):
        return None, False
    run, end = ends.token(at)
    if end is None or run == at + len(JWT_START):
        return None, False
    return end, _header(text[at:run])


def _try_key(text, at, ends):
    end = ends.key_block(at)
    return end, end is not None


TRY = {"assign": _try_assign, "access": _try_access, "github": _try_github, "npm": _try_npm, "jwt": _try_jwt, "private_key": _try_key}


@functools.cache
def _automaton():
    machine = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a whole text by start, then kind; code points, end exclusive."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # one letter grows when it is lower-cased
        low = text.replace("İ", "i").lower()
    spans = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    hits = sorted((end - size + 1, kind) for end, (kind, size) in _automaton().iter(low))
    after: dict[str, int] = {}
    ends = _Ends(text)
    for at, kind in hits:
        if at >= after.get(kind, 0):
            end, counts = TRY[kind](text, at, ends)
            if end is not None:
                after[kind] = end
                if counts:
                    spans.append((kind, at, end))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_spans(text_col: str = "text") -> Column:
    """Array of structs kind, start, end."""

    @F.pandas_udf(f"array<struct<{SPAN.replace(' string', ': string').replace(' long', ': long')}>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in texts], dtype=object)

    return find(F.col(text_col))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its id and `spans`, an array of structs kind, start, end (by start, then kind).

    Null and empty texts have no spans; repeated rows are scanned alike; further columns are ignored; an empty table gives
    an empty result. Time is linear in a text's length, whatever it holds. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col), secret_spans(text_col).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a SHA-256 of their spans, and all spans as text."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        id_col, *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(of(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
