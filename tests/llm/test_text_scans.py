"""Token counts, personal data, secrets: row by row against plainer versions."""

import hashlib
import random
import re

import pytest

from lodestat.llm import pii, secrets, tokens
from lodestat.llm.queries import tokenizer


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))


def test_tokens_of_random_texts(model, monkeypatch):
    machine = tokens.Transducer(tokenizer("piece_bpe_32k.model"))
    rnd = random.Random(1)
    alphabet = "aaaabbeethr ,.\n\t  ▁éßü漢字иx0123'<s>"
    for chunk in (7, 1 << 16):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        for _ in range(400):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))
            assert machine.tokens(text) == len(model.encode(text)), text


def test_tokens_when_tables_overflow(model, texts, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_STATES", 50)
    monkeypatch.setattr(tokens, "MAX_SEGMENTS", 20)
    machine = tokens.Transducer(tokenizer("piece_bpe_32k.model"))
    for text in texts:
        assert machine.tokens((text or "")[:20_000]) == len(model.encode((text or "")[:20_000]))


def test_token_rows(edge_docs, no_docs, model, texts):
    found = tokens.count_tokens(edge_docs, tokenizer("piece_bpe_32k.model"))
    rows = found.collect()
    assert len(rows) == len(texts) + 2
    by_id = {r["doc_id"]: r for r in rows}
    for i, text in enumerate(texts):
        n = len(model.encode(text or ""))
        r = by_id[i * 3]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 4096)
    assert tokens.count_tokens(no_docs, tokenizer("piece_bpe_32k.model")).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_personal(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_personal_plain_spans_match_plain_patterns():
    rnd = random.Random(2)
    parts = ["a", "b.c", "@", "@x.yz", ".", "1.2.3.4", "255.1.1.256", "4111 1111 1111 1111", "+1 (555) 123-4567", " ", "-", "_", "é", "+", "77", "@q"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        assert pii.find(text) == plain_personal(text), text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to john (at) example (dot) com now", [("email", "john (at) example (dot) com")]),
        ("jane at example dot com", [("email", "jane at example dot com")]),
        ("bob[at]mail[dot]org!", [("email", "bob[at]mail[dot]org")]),
        ("jоhn@еxample.com", [("email", "jоhn@еxample.com")]),
        ("ｊohn＠example.com", [("email", "ｊohn＠example.com")]),
        ("plus four four two zero seven nine four six zero nine five eight", [("phone", "plus four four two zero seven nine four six zero nine five eight")]),
        ("four one one one one one one one one one one one one one one one", [("card", "four one one one one one one one one one one one one one one one")]),
        ("1 dot 2 dot 3 dot 4", [("ip", "1 dot 2 dot 3 dot 4")]),
        ("we met at noon and had one two drinks, dot dot", []),
        ("plain a@b.cd stays", []),
        ("", []),
    ],
)
def test_disguised_spans_map_to_the_source(text, want):
    base, added = pii.scan(text)
    assert base == plain_personal(text)
    assert [(k, text[a:b]) for a, b, k in added] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("jane at example.com", [("email", "jane at example.com")]),
        ("call plus 49 30 1234567 today", [("phone", "plus 49 30 1234567")]),
        ("call \u212aplus 49 30 1234567", [("phone", "plus 49 30 1234567")]),
        ("Jane AT Example.Com", [("email", "Jane AT Example.Com")]),
        ("we met at noon. plus 3 more", []),
    ],
)
def test_a_plain_at_or_plus_needs_no_other_disguise(text, want):
    assert [(k, text[a:b]) for a, b, k in pii.scan(text)[1]] == want


def test_personal_gate_never_changes_spans(monkeypatch):
    rnd = random.Random(6)
    parts = ["jane", "a.b", " at ", " AT ", "example", "x-y", ".", ".com", " dot ", "[at]", "( dot )", "{.}", "&#64;", "&#46;", "plus ", "Plus ", "+", "49 30 1234567"]
    parts += ["four", "One ", "-", " ", "  ", "1.2.3", "@", "\u0430", "\u212a", "\u0130", "\u017f", "\u200b", "\xad", "\xa0", "\uff10", "\u00e9", ",", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(20_000)]
    gated = [pii.scan(t) for t in texts]
    monkeypatch.setattr(pii, "disguised", lambda _: True)
    for text, spans in zip(texts, gated):
        assert pii.scan(text) == spans, text


def test_personal_rows(edge_docs, no_docs, texts):
    rows = pii.find_personal(edge_docs).collect()
    assert len(rows) == len(texts) + 2
    empty = next(r for r in rows if r["doc_id"] == 0)
    assert (empty["n_email"], empty["spans"], empty["base_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())
    assert pii.find_personal(no_docs).count() == 0


def plain_secrets(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_secret_base_spans():
    rnd = random.Random(3)
    parts = ["token", "API_KEY", "paſsword", "password", "=", ":", " ", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "short", "longervalue12345", "K"]
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 10)))
        assert secrets.scan(text)[0] == plain_secrets(text), text


def test_entropy_windows_match_recounting():
    import math
    from collections import Counter

    rnd = random.Random(4)
    for _ in range(60):
        s = "".join(rnd.choice("abcdefghijABCDEFG0123456789"[: rnd.randint(2, 27)]) for _ in range(rnd.randint(20, 60)))
        limit = rnd.uniform(2, 4.2)
        covered = set()
        for i in range(len(s) - secrets.WINDOW + 1):
            n = Counter(s[i : i + secrets.WINDOW]).values()
            if -sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in n) > limit + 1e-9:
                covered |= set(range(i, i + secrets.WINDOW))
        assert {k for a, b in secrets.entropy_spans(s, limit) for k in range(a, b)} == covered


def test_entropy_adds_and_allow_list_suppresses():
    assert [s[2] for s in secrets.scan("see wJalrXUtnFEMI9K7MDENGbPxRfiCYzz83mQ now")[1]] == ["entropy"]
    for clean in ("123e4567-E89b-12d3-a456-426614174000", "some/path/to/a/module_name/and/more", "1234567890123456789012345", "inanouthtioningandmoreprose"):
        assert secrets.scan(clean)[1] == [], clean


@pytest.mark.parametrize(
    ("alphabet", "of_32", "of_20"),
    [
        ("abcdefghijklmnopqrstuvwxyz0123456789", 0.97, 0.85),
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 0.97, 0.85),
        ("abcdefghijklmnopqrstuvwxyz234567", 0.96, 0.78),
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.96, 0.78),
        ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.96, 0.78),
        ("abcdefghijklmnopqrstuvwxyz", 0.7, 0.3),
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.7, 0.3),
    ],
)
def test_random_strings_of_each_class_are_found(alphabet, of_32, of_20):
    rnd = random.Random(7)
    for n, least in ((32, of_32), (20, of_20)):
        drawn = ["".join(rnd.choice(alphabet) for _ in range(n)) for _ in range(500)]
        assert sum(bool(secrets.scan(f"see {s} now")[1]) for s in drawn) >= least * len(drawn)


def test_names_and_long_words_are_not_secrets():
    names = ["internationalization", "Donaudampfschifffahrtsgesellschaft", "getElementByIdAndClassName", "MAX_NUMBER_OF_RETRIES_PER", "posts/2021/05/how-to-bake-bread"]
    names += ["/usr/local/lib/python3/site-packages", "python/visualization/2d/scatter", "customer_analysis/step1_basic"]
    for clean in names:
        assert secrets.scan(clean)[1] == [], clean


def test_allow_list_suppresses_only_what_it_covers():
    token = "q7x2m9k4v8b1n6c3z5l0p"
    for text in (f"example/{token}", f"{token}_example", f"abcdefghijklmnopqrstuvwxyz{token}EXAMPLE"):
        (a, b, kind), = secrets.scan(text)[1]
        assert kind == "entropy" and token in text[a:b] and "example" not in text[a:b].lower() and b - a <= len(token) + 1, text
    for clean in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"):
        assert secrets.scan(clean)[1] == [], clean


def test_secret_rows(edge_docs, no_docs, texts):
    assert secrets.find_secrets(edge_docs).count() == len(texts) + 2
    assert secrets.find_secrets(no_docs).count() == 0
