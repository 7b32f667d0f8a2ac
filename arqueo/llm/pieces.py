"""Oversized texts in pieces under a limit of tokens, cut at natural boundaries and with overlap."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arqueo.llm.tokens import FOLDER, RANKS, shared_encoding

#: Boundaries by strength, as patterns of UTF-8 bytes; a cut stands behind the match.
BOUNDARIES = [
    (5, re.compile(rb"\n[ \t\r]*\n\s*")),
    (4, re.compile(rb"\n\s*")),
    (3, re.compile(rb"(?:[.!?;]|\xe2\x80\xa6|\xe3\x80\x82)[\"')\]]*\s+")),
    (2, re.compile(rb"[,:]\s+")),
    (1, re.compile(rb"\s+")),
]


class _Text:
    """A text in UTF-8 with its tokens' ends and its boundaries."""

    def __init__(self, text: str, enc) -> None:
        self.raw = text.encode("utf-8", "replace")
        self.enc = enc
        tokens = enc.encode_ordinary(text)
        self.ends = np.cumsum([len(x) for x in enc.decode_tokens_bytes(tokens)]) if tokens else np.zeros(0, np.int64)
        self._cuts: tuple[np.ndarray, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.ends)

    def tokens(self, a: int, b: int) -> int:
        """Of the bytes from a to b, by the tokens of the whole text; one more for a token that a cut may have split."""
        return int(np.searchsorted(self.ends, b, "left") - np.searchsorted(self.ends, a, "right")) + 1

    def own_tokens(self, a: int, b: int) -> int:
        return len(self.enc.encode_ordinary(self.raw[a:b].decode("utf-8")))

    def whole(self, at: int) -> int:
        """The start of the character that a place lies in."""
        while at > 0 and at < len(self.raw) and self.raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def characters(self) -> np.ndarray:
        """How many characters begin before each byte."""
        return np.concatenate(([0], np.cumsum(np.frombuffer(self.raw, np.uint8) & 0xC0 != 0x80)))

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of all boundaries and their strengths."""
        if self._cuts is None:
            best: dict[int, int] = {}
            for strength, pattern in BOUNDARIES:
                for m in pattern.finditer(self.raw):
                    best.setdefault(m.end(), strength)
            places = np.array(sorted(best), np.int64)
            self._cuts = places, np.array([best[p] for p in places.tolist()], np.int64)
        return self._cuts

    def middle(self, a: int, b: int) -> int:
        """Where to cut a to b: the strongest boundary in its middle half, the nearest to the middle of these; if there is none,
        the nearest boundary anywhere; without boundary, the character nearest to the middle."""
        lo, hi = np.searchsorted(self.ends, a, "right"), np.searchsorted(self.ends, b, "left")
        mid = int(self.ends[(lo + hi) // 2]) if hi > lo else (a + b) // 2
        places, strengths = self.cuts()
        for x, y in ((a + (b - a) // 4, b - (b - a) // 4), (a + 1, b - 1)):
            i, j = np.searchsorted(places, x, "left"), np.searchsorted(places, y, "right")
            if i < j:
                near = np.abs(places[i:j] - mid)
                return int(places[i:j][np.lexsort((near, -strengths[i:j]))[0]])
        cut = min(max(mid, a + 1), b - 1)
        while cut > a + 1 and self.raw[cut] & 0xC0 == 0x80:
            cut -= 1
        while cut < b and self.raw[cut] & 0xC0 == 0x80:
            cut += 1
        return cut


def bisected(t: _Text, limit: int) -> list[tuple[int, int]]:
    """The text in stretches of at most ``limit`` tokens: halves that exceed it are cut again."""
    out, todo = [], [(0, len(t.raw))]
    while todo:
        a, b = todo.pop()
        if t.tokens(a, b) <= limit and t.own_tokens(a, b) <= limit or b - a < 2:
            out.append((a, b))
            continue
        c = t.middle(a, b)
        if not a < c < b:
            out.append((a, b))
            continue
        todo += [(c, b), (a, c)]
    return out


def overlap_start(t: _Text, a: int, overlap: int) -> int:
    """Where the last ``overlap`` tokens of the text before a begin, counted as that stretch is encoded by itself.

    Tokens may merge otherwise at its ends. Then the places between the tokens around are tried, too, character by character; if none gives
    just so many tokens, the next longer stretch is taken. All of the text, if it has fewer tokens.
    """
    k = int(np.searchsorted(t.ends, a, "right")) - overlap
    place = lambda k: t.whole(int(t.ends[k - 1])) if k > 0 else 0
    while k > 0 and t.own_tokens(place(k), a) < overlap:
        k -= 1
    while k < len(t.ends) and place(k + 1) < a and t.own_tokens(place(k + 1), a) >= overlap:
        k += 1
    start = place(k)
    if k > 0 and t.own_tokens(start, a) > overlap:
        for at in range(start + 1, place(k + 1)):
            if t.raw[at] & 0xC0 != 0x80 and t.own_tokens(at, a) == overlap:
                return at
    return start


def overlapped(t: _Text, parts: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Each part with the last ``overlap`` tokens of the text before it: start of the piece, start of the part, end.

    If the piece would exceed the limit because tokens merge otherwise at the seam, the part is cut once more.
    """
    out, todo = [], list(reversed(parts))
    while todo:
        a, b = todo.pop()
        start = overlap_start(t, a, overlap) if a else 0
        if t.own_tokens(start, b) > limit and b - a > 1 and a < (c := t.middle(a, b)) < b:
            todo += [(c, b), (a, c)]
            continue
        out.append((start, a, b))
    return out


SCHEMA = "piece int, n_pieces int, start_char int, new_char int, end_char int, n_tokens int, text string"


def pieces(df: DataFrame, doc_id: str, text: str, limit: int = 2048, overlap: int = 128, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """The texts of more than ``limit`` tokens in pieces of at most that many; shorter texts, null and empty ones give no rows.

    Recursive bisection: a stretch of more than limit - overlap tokens is cut at the strongest boundary near its middle (blank
    line, line, sentence, clause, word) and its halves likewise; a stretch without any boundary is cut between characters. Then each
    piece but the first begins with the last ``overlap`` tokens of the text before it. Dropping each piece's first new_char -
    start_char characters and joining the rest gives back the text. No text of at most ``limit`` UTF-8 bytes can exceed it, since a
    token has a byte or more; those aren't encoded. Arrow batches, no shuffle; a text is held by one task.

    Result: doc_id, piece (from 0), n_pieces, start_char, new_char (where the text that no earlier piece has begins), end_char,
    n_tokens, text.
    """
    kind, get = df.schema[doc_id].dataType.simpleString(), shared_encoding(df.sparkSession, folder, ranks)
    x = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & (F.octet_length("text") > limit))

    def run(batches):
        import pandas as pd

        enc = get()
        for batch in batches:
            rows = []
            for i, s in zip(batch["doc_id"], batch["text"], strict=True):
                t = _Text(s, enc)
                if len(t) <= limit:
                    continue
                parts = overlapped(t, bisected(t, limit - overlap), limit, overlap)
                char = t.characters()
                for n, (start, new, end) in enumerate(parts):
                    body = t.raw[start:end].decode("utf-8")
                    rows.append((i, n, len(parts), int(char[start]), int(char[new]), int(char[end]), len(enc.encode_ordinary(body)), body))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "n_pieces", "start_char", "new_char", "end_char", "n_tokens", "text"])

    return x.mapInPandas(run, f"doc_id {kind}, {SCHEMA}")
