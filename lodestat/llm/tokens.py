"""Token counts by a compiled finite-state transducer.

A merge tokenizer (pieces with ranks) is turned into a deterministic transducer over characters, compiled lazily. Its state holds the
longest suffix that can still grow into a piece and, for every such suffix, the last token before it and how many tokens fewer the
text had there; a transition says how the number of tokens changes. That is enough because a token sequence is the tokenizer's own
if and only if each pair of neighbours is: tokenizing the two alone gives the two.

Where two neighbouring characters never stand together in a piece the transducer is back in its start state. A chunk of text is
therefore a small map (text before the first reset, tokens between, text after the last reset); maps compose associatively, so the
chunks of a long text are counted apart and put together by a prefix scan of logarithmic depth.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame

from lodestat.llm.common import each_text

CHUNK = 1 << 16
#: States and segments kept by a worker; beyond, its tables start anew (results stay the same).
MAX_STATES, MAX_SEGMENTS = 250_000, 300_000
START = ("", (("", 0),))


class Segments(dict):
    """Tokens by segment, worked out when first asked for."""

    def __init__(self, run):
        super().__init__()
        self.work_out = run

    def __missing__(self, segment: str) -> int:
        if len(self) >= MAX_SEGMENTS:
            self.clear()
        n = self[segment] = self.work_out(segment)
        return n


class Transducer:
    """Counts tokens of a piece model (BPE with byte fallback) at ``path``."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        plain = [i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.rank = {self.model.id_to_piece(i): (-self.model.get_score(i), i) for i in plain}
        self.prefixes = {p[:k] for p in self.rank for k in range(1, len(p))}
        inner = {c for p in self.rank if len(p) > 1 for c in p}
        self.inner = inner
        self.joins = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        mark = "▁"
        if any(mark in p.lstrip(mark) for p in self.rank):
            self.split = None
        else:
            alone = "".join(c for c in "\n\t\r" if c not in inner)
            body = re.escape(mark + alone)
            self.split = re.compile(f"{mark}*[^{body}]+|{mark}+" + (f"|[{re.escape(alone)}]" if alone else "")).findall
        self.segments = Segments(self.run)
        self.shapes: dict[tuple, tuple] = {}
        self.order = {p: k for k, p in enumerate(sorted(self.rank, key=self.rank.get))}
        self.never = len(self.order)
        self.merges: dict[str, tuple | None] = {}
        self.regular = True
        for piece in self.order:
            self.last_merge(piece)
        self.nodes: dict[tuple, dict] = {}
        self.reset()

    # ---- the test of neighbours
    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose joining made the piece; None for a single character."""
        found = self.merges.get(piece, 0)
        if found == 0:
            parts = list(piece)
            while len(parts) > 2:
                ranks = [(self.order.get(a + b, self.never), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                rank, i = min(ranks)
                if rank == self.never:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) > 2 or any(len(p) > 1 and self.order[p] > self.order[piece] for p in parts[: len(piece)] if len(piece) > 1):
                self.regular = False  # merges not in the order of ranks: neighbours are then tested by the library
            found = self.merges[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return found

    def fits(self, left: str, right: str) -> bool:
        """Whether tokenizing the two alone gives the two.

        The merges of both are undone, the later one first; at no point may joining across the border have ranked before what was undone.
        """
        if not self.regular:
            want = [left, right]
            return self.model.encode("\n" + left + right, out_type=str)[-2:] == want
        order, limit = self.order, self.never
        while True:
            if order.get(left + right, self.never) < limit:
                return False
            l, r = order[left] if len(left) > 1 else -1, order[right] if len(right) > 1 else -1
            if l > r:
                limit, left = l, self.last_merge(left)[1]
            elif r >= 0:
                limit, right = r + 1, self.last_merge(right)[0]
            else:
                return True

    # ---- the transducer
    def shape(self, suffix: str, char: str) -> tuple:
        """What a step needs besides the history: pieces that may end here, by place in the history; the places that stay; next suffix."""
        found = self.shapes.get((suffix, char))
        if found is None:
            grown = suffix + char
            live = [k for k in range(len(suffix), -1, -1) if k == 0 or suffix[-k:] in self.prefixes]
            pieces = [(i, grown[len(suffix) - k :]) for i, k in enumerate(live) if k == 0 or grown[len(suffix) - k :] in self.rank]
            stay = [i for i, k in enumerate(live) if grown[-k - 1 :] in self.prefixes]
            longest = live[stay[0]] + 1 if stay else 0
            found = self.shapes[suffix, char] = (pieces, stay, grown[-longest:] if longest else "")
        return found

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """Next state and the change of the number of tokens. The state has one (last token, tokens less) per live suffix, longest first."""
        suffix, past = state
        pieces, stay, grown = self.shape(suffix, char)
        for i, token in pieces:
            if not past[i][0] or self.fits(past[i][0], token):
                break
        change = 1 - past[i][1]
        return (grown, (*[(past[i][0], past[i][1] + change) for i in stay], (token, 0))), change

    def node(self, state: tuple) -> dict:
        """The transitions compiled so far of a state: character to (transitions of the next state, change)."""
        found = self.nodes.get(state)
        if found is None:
            if len(self.nodes) >= MAX_STATES:
                self.reset()
            found = self.nodes[state] = {"": state}
        return found

    def reset(self) -> None:
        self.nodes = {}
        self.start = self.nodes[START] = {"": START}

    def run(self, segment: str) -> int:
        """Tokens of a segment; a character outside the model counts its bytes and resets."""
        node, total = self.start, 0
        for char in segment:
            try:
                node, change = node[char]
            except KeyError:
                if char in self.rank:
                    target, change = self.step(node[""], char)
                    edge = (self.node(target), change)
                else:
                    edge = (self.start, len(char.encode("utf-8", "surrogatepass")))
                node[char] = edge
                node, change = edge
            total += change
        return total

    # ---- chunks
    def cut(self, text: str) -> list[str]:
        """Segments between resets."""
        if self.split:
            return self.split(text)
        out, start = [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in self.joins:
                out.append(text[start:i])
                start = i
        return [*out, text[start:]] if text else []

    def count(self, segments: list[str]) -> int:
        return sum(map(self.segments.__getitem__, segments))

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, tokens, tail): tokens is None if the chunk has no reset, and head is then the whole chunk."""
        segments = self.cut(chunk)
        if len(segments) < 2:
            return chunk, None, ""
        return segments[0], self.count(segments[1:-1]), segments[-1]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None and b[1] is None:
            return self.chunk_map(a[0] + b[0])
        if a[1] is None:
            head, n, _ = self.chunk_map(a[0] + b[0])
            more = 0 if n is None else n + self.count([self.cut(a[0] + b[0])[-1]])
            return head, b[1] + more, b[2]
        if b[1] is None:
            joined = self.cut(a[2] + b[0])
            return a[0], a[1] + self.count(joined[:-1]), joined[-1] if joined else ""
        return a[0], a[1] + self.count(self.cut(a[2] + b[0])) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix scan: in each of log2(n) rounds every map takes in the one ``gap`` before it."""
        gap = 1
        while gap < len(maps):
            maps = maps[:gap] + [self.compose(maps[i - gap], maps[i]) for i in range(gap, len(maps))]
            gap *= 2
        return maps

    def tokens(self, text: str) -> int:
        """Tokens of a whole text."""
        body = self.model.normalize(text)
        if len(body) <= CHUNK:
            return self.count(self.cut(body))
        maps = [self.chunk_map(body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
        head, n, tail = self.scan(maps)[-1]
        return self.count(self.cut(head)) + (n or 0) + self.count(self.cut(tail))


@functools.lru_cache(2)
def transducer(path: str) -> Transducer:
    """One compiled transducer per worker and model."""
    return Transducer(path)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` per row, as the model's own library counts without begin, end or added tokens.

    Missing and empty texts have 0 bytes and 0 tokens. Texts are counted whole at any length. Repeated rows give repeated rows; other
    columns are ignored; an empty table gives no rows.
    """

    def row(value: str) -> tuple:
        n = transducer(model).tokens(value)
        return len(value.encode("utf-8", "surrogatepass")), n, n > limit

    return each_text(docs, [key], row, "n_bytes long, n_tokens long, over_limit boolean", text)
