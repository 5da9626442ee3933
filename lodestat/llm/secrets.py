"""Secret scan: fixed patterns, and windows of high Shannon entropy in candidate strings.

The entropy of a sliding window is kept by incremental counts: moving on by one character changes two counts, so a candidate of n
characters costs n steps whatever the window. Thresholds are set per character class; allow-listed strings are suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame

from lodestat.llm.common import each_text

# Patterns of known secrets, in the order in which kinds are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
#: Bits per character that a window must exceed, by class; a window of 20 has at most 4.32. Random windows reach all but "name".
LIMITS = {"hex": 3.3, "key": 3.6, "code": 3.85, "letters": 3.8, "word": 3.75, "name": 4.3}
# Strings that look random but are not secret, and such parts of longer strings.
ALLOWED = (
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.IGNORECASE | re.ASCII),
    re.compile(r"[0-9_=+/-]+\Z"),
    re.compile(r"(?:[A-Za-z]?[a-z]+[/_-])+[A-Za-z]?[a-z]+\Z"),
)
ALLOWED_PART = re.compile(r"ABCDEFGHIJKLMNOPQRSTUVWXYZ|abcdefghijklmnopqrstuvwxyz|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|EXAMPLE|example")
# Words and numbers ("step2", "3d") between separators, and words with inner capitals.
NAME_PART = r"(?:[A-Za-z]?[a-z]+[0-9]*|[A-Z]+[0-9]*|[0-9]+|[0-9]{1,2}[a-z]+)"
NAME = re.compile(rf"[/_=+-]*{NAME_PART}(?:[/_=+-]+{NAME_PART})+[/_=+-]*\Z|[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)+\Z")
#: -(c / W) log2(c / W) for each count c of a window.
PART = [0.0] + [-(c / WINDOW) * math.log2(c / WINDOW) for c in range(1, WINDOW + 1)]


def kind_of(candidate: str) -> str:
    """Character class: hex digits with a digit; names; key (one case and digits) or code (mixed); word (one case) or letters (mixed)."""
    has_digit = any(c.isdigit() for c in candidate)
    if has_digit and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate):
        return "hex"
    body = candidate[1:]
    if NAME.match(candidate) and not (has_digit and body.lower() != body):
        return "name"
    one_case = body.lower() == body or body.upper() == body
    if has_digit:
        return "key" if one_case else "code"
    return "word" if one_case else "letters"


def unlisted(candidate: str) -> list[tuple[int, str]]:
    """Offsets and texts of the parts that no allow-list match covers."""
    if any(p.match(candidate) for p in ALLOWED):
        return []
    out, at = [], 0
    for m in ALLOWED_PART.finditer(candidate):
        out.append((at, candidate[at : m.start()]))
        at = m.end()
    out.append((at, candidate[at:]))
    return [(i, part) for i, part in out if len(part) >= WINDOW and not (at and any(p.match(part) for p in ALLOWED))]


def entropy_spans(candidate: str, limit: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal runs covered by windows whose entropy exceeds ``limit``."""
    part = PART if window == WINDOW else [0.0] + [-(c / window) * math.log2(c / window) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, new in enumerate(candidate):
        if i >= window:
            old = candidate[i - window]
            c = counts[old]
            total += part[c - 1] - part[c]
            counts[old] = c - 1
        c = counts.get(new, 0)
        total += part[c + 1] - part[c]
        counts[new] = c + 1
        if i >= window - 1 and total > limit + 1e-9:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans as (start, end, kind), in code points, end exclusive."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    added = []
    for m in CANDIDATE.finditer(text):
        for i, part in unlisted(m[0]):
            for a, b in entropy_spans(part, LIMITS[kind_of(part)]):
                added.append((m.start() + i + a, m.start() + i + b, "entropy"))
    # an added span that a base span already covers says nothing new
    kept, at = [], 0
    reach = 0
    for a, b, kind in added:
        while at < len(base) and base[at][0] <= a:
            reach = max(reach, base[at][1])
            at += 1
        if reach < b:
            kept.append((a, b, kind))
    return base, kept


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def digest_row(base: list, added: list, kinds: tuple[str, ...]) -> tuple:
    every = sorted(base + added, key=lambda s: (s[0], kinds.index(s[2])))
    counts = [sum(s[2] == k for s in base) for k in kinds]
    return counts, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(every)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts per fixed kind (``n_assign, n_access, n_hex``), ``n_entropy`` added spans, ``base_sha256`` and ``spans`` per row.

    ``spans`` lists ``kind:start:end`` of all spans in code points; ``base_sha256`` digests those of the fixed patterns. Missing and
    empty texts have no spans; repeated rows give repeated rows; other columns are ignored; texts of any length are scanned whole.
    """

    def row(value: str) -> tuple:
        base, added = scan(value)
        counts, digest, every = digest_row(base, added, KINDS)
        return counts[0], counts[1], counts[2], len(added), digest, every

    return each_text(docs, [key], row, "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string", text)
