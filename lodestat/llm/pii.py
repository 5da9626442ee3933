"""Personal data, also disguised, with spans in the source text.

Fixed patterns find what is written plainly. Then a transducer rewrites the text: look-alike characters, spelled digits and disguised
"at" and "dot" become what they stand for, and every rewritten stretch remembers its place. The same patterns run over the rewritten
text, and what they find there is mapped back to source characters. Texts without a disguise skip the second step.
"""

from __future__ import annotations

import bisect
import re
import sys
import unicodedata

from pyspark.sql import DataFrame

from lodestat.llm.common import each_text
from lodestat.llm.secrets import digest_row

# The kinds in the order in which they are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
MAIL_HERE = re.compile(rf"[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
MAIL_NEXT = re.compile(rf"(?<![{LOCAL}])[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Letters of other scripts that look like Latin ones, pairwise in order.
LOOKALIKES = dict(zip("авеіјкмнорсѕтухАВЕІЈКМНОРСЅТУХαοινρκτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abeijkmhopcstyxABEIJKMHOPCSTYXaoivpktABEZHIKMNOPTYX", strict=True))
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def _glyphs() -> dict[int, str]:
    """One character for one: full-width forms, digits of all scripts, look-alike letters, variants of at, dot, plus and dash."""
    table = {0xFF01 + i: chr(0x21 + i) for i in range(94)}
    for code in range(0x80, sys.maxunicode + 1):
        digit = unicodedata.decimal(chr(code), None)
        if digit is not None:
            table[code] = str(digit)
    table |= {ord(k): v for k, v in LOOKALIKES.items()}
    table |= {ord(c): "@" for c in "﹫"} | {ord(c): "." for c in "․。｡﹒"} | {ord(c): "-" for c in "‐‑‒–﹣"} | {0xA0: " ", 0x202F: " ", 0x2009: " "}
    return table


GLYPHS = _glyphs()
INVISIBLE = "​‌‍⁠﻿­"
NOT_LATIN = re.compile("[\xa0\xad\u0250-\U0010ffff]")
GLYPH_SEEN = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(GLYPHS)) + INVISIBLE + "]")
WORD = "|".join(DIGIT_WORDS)
DIGIT_RUN = rf"(?<![A-Za-z])(?:{WORD})(?:[\x20-]{{1,3}}(?:{WORD}))+(?![A-Za-z])"
OPEN, SHUT = r"[(\[{<]\x20?", r"\x20?[)\]}>]"
RULES = re.compile(
    rf"(?P<at>\x20?{OPEN}(?:at|@){SHUT}\x20?|&#64;|(?<=[A-Za-z0-9])\x20at\x20(?=[A-Za-z0-9-]+(?:\x20dot\x20|\x20?{OPEN}(?:dot|\.){SHUT}|\.)[A-Za-z0-9]))"
    rf"|(?P<dot>\x20?{OPEN}(?:dot|\.){SHUT}\x20?|&#46;|(?<=[A-Za-z0-9])\x20dot\x20(?=[A-Za-z0-9]))"
    rf"|(?P<plus>(?<![A-Za-z])plus\x20(?=(?:{WORD}|[0-9])))"
    rf"|(?P<digits>{DIGIT_RUN})"
    rf"|(?P<none>[{INVISIBLE}])",
    re.IGNORECASE | re.ASCII,
)
MARKED = re.compile(r"[(\[{<]\x20?(?:at|dot|[@.])\x20?[)\]}>]|&#(?:64|46);", re.IGNORECASE | re.ASCII)
SPELLED = re.compile(DIGIT_RUN, re.IGNORECASE | re.ASCII)
# In lower case, and no narrower than the rules for a plain "at" before a plain dot and for "plus".
AT_HOST = re.compile(r"\x20at\x20[a-z0-9-]+\.[a-z0-9]")
PLUS = re.compile(rf"plus\x20(?:{WORD}|[0-9])")
DIGIT = {w: str(i) for i, w in enumerate(DIGIT_WORDS)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches in linear time: a run of local characters is tried once, or where the last match ended inside it."""
    out, at = [], 0
    while True:
        m = (MAIL_HERE.match(text, at) if out else None) or MAIL_NEXT.search(text, at)
        if not m:
            return out
        out.append(m.span())
        at = m.end()


def find(text: str) -> list[tuple[int, int, str]]:
    """Plainly written identifiers as (start, end, kind), leftmost and non-overlapping per kind, failing ones dropped."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def rewrite(text: str) -> tuple[str, list[int], list[tuple[int, int, bool]]]:
    """Rewritten text, where its pieces start, and for each piece its source start, source end and whether it was rewritten."""
    plain = text.translate(GLYPHS)
    parts, starts, places, at, size = [], [], [], 0, 0

    def put(piece: str, a: int, b: int, changed: bool) -> None:
        nonlocal size
        if piece:
            parts.append(piece)
            starts.append(size)
            places.append((a, b, changed))
            size += len(piece)

    for m in RULES.finditer(plain):
        put(plain[at : m.start()], at, m.start(), False)
        kind = m.lastgroup
        if kind == "digits":
            for w in re.finditer("[A-Za-z]+", m[0]):
                put(DIGIT[w[0].lower()], m.start() + w.start(), m.start() + w.end(), True)
        else:
            put({"at": "@", "dot": ".", "plus": "+", "none": ""}[kind], m.start(), m.end(), True)
        at = m.end()
    put(plain[at:], at, len(plain), False)
    return "".join(parts), starts, places


def disguised(text: str) -> bool:
    """Whether a rule or a glyph may apply. It is true wherever one does: each part is as wide as its rule, or wider."""
    if not text.isascii() and NOT_LATIN.search(text) and GLYPH_SEEN.search(text):
        return True
    low = text.lower()
    spelled = any(f"{w} " in low or f"{w}-" in low for w in DIGIT_WORDS) and SPELLED.search(text)
    plain = " at " in low and AT_HOST.search(low) or "plus " in low and PLUS.search(low)
    return bool(spelled or " dot " in low or plain or MARKED.search(text))


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Plain spans and added spans of disguised identifiers, in source code points."""
    base = find(text)
    if not disguised(text):
        return base, []
    clean, starts, places = rewrite(text)
    taken = {k: ([s[0] for s in base if s[2] == k], [s[1] for s in base if s[2] == k]) for k in KINDS}
    added = []
    for a, b, kind in find(clean):
        i, j = bisect.bisect_right(starts, a) - 1, bisect.bisect_right(starts, b - 1) - 1
        first, last = places[i], places[j]
        start = first[0] if first[2] else first[0] + a - starts[i]
        end = last[1] if last[2] else last[0] + b - starts[j]
        at = bisect.bisect_left(taken[kind][0], end)  # plain spans of a kind don't overlap, so only the last one before ``end`` can
        if at == 0 or taken[kind][1][at - 1] <= start:
            added.append((start, end, kind))
    return base, added


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts of plain spans (``n_email, n_ip, n_card, n_phone``), ``n_added`` disguised ones, ``base_sha256`` and ``spans``.

    ``spans`` lists ``kind:start:end`` of plain and disguised spans in code points of the source; ``base_sha256`` digests the plain
    ones. Missing and empty texts have no spans; repeated rows give repeated rows; other columns are ignored; texts are scanned whole.
    """

    def row(value: str) -> tuple:
        base, added = scan(value)
        counts, digest, every = digest_row(base, added, KINDS)
        return *counts, len(added), digest, every

    fields = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
    return each_text(docs, [key], row, fields, text)
