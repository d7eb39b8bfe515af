"""Token counts by finite-state transducers whose transitions are annotated with emitted-token counts.

Two deterministic transducers are composed.

* The *splitter* reads character classes and emits 1 where a pre-token starts.  The text is cut into chunks
  of equal length; all chunks run in lock step from every state, which gives one state map per chunk.  The
  maps compose associatively, so a parallel prefix scan gives each chunk's true start state.
* The *merger* reads the bytes of a pre-token.  Its state is the set of live hypotheses (trie node of a token
  being read, the token before it, tokens emitted so far relative to the shortest reading); a transition is
  annotated with the change of the number of emitted tokens.  It is determinised on first use and kept as flat
  tables; all pre-tokens of a batch run in lock step.

Nulls and empty texts count 0 tokens; equal texts get equal counts.  Strings of special tokens inside a text
count one token each, as is the tokenizers library's default.  Memory is bounded by ``max_states``: beyond it the
tables are built anew, which changes no count.  Repeated rows are repeated; other columns are not looked at.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.byte_pairs import BytePairs, byte_pairs
from tessera.llm.docmap import map_documents, utf8_list

# Symbols that the splitter reads.
LETTER, NUMBER, OTHER, APO2, APO3, SPACE_LAST, SPACE_MID, WHITE_LAST, WHITE_MID, INSIDE, RESET = range(11)
# Its states: the next character starts a token; in a run; a space that the next run takes; in white space; 1 or 2 letters of a contraction left.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, LEFT_1, LEFT_2 = range(8)
N_STATES, N_SYMBOLS = 8, 11
#: The code points of \s in Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted starts, by state * N_SYMBOLS + symbol."""
    starts = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APO2: LEFT_1, APO3: LEFT_2, SPACE_LAST: AFTER_SPACE, SPACE_MID: IN_WHITE, WHITE_LAST: FRESH, WHITE_MID: IN_WHITE}
    stays = {
        IN_LETTERS: {LETTER: IN_LETTERS},
        IN_NUMBERS: {NUMBER: IN_NUMBERS},
        IN_OTHERS: dict.fromkeys((OTHER, APO2, APO3), IN_OTHERS),
        AFTER_SPACE: {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APO2: IN_OTHERS, APO3: IN_OTHERS},
        IN_WHITE: {SPACE_MID: IN_WHITE, WHITE_MID: IN_WHITE},
        LEFT_1: dict.fromkeys(range(INSIDE), FRESH),
        LEFT_2: dict.fromkeys(range(INSIDE), LEFT_1),
    }
    nxt, emit = np.zeros((N_STATES, N_SYMBOLS), np.uint8), np.zeros((N_STATES, N_SYMBOLS), np.uint8)
    for s in range(N_STATES):
        for x in range(INSIDE):
            stay = stays.get(s, {}).get(x)
            nxt[s, x], emit[s, x] = (starts[x], 1) if stay is None else (stay, 0)
        nxt[s, INSIDE], nxt[s, RESET] = s, FRESH
    return nxt.ravel(), emit.ravel()


NEXT, EMIT = _splitter()


def _classes() -> np.ndarray:
    """The class of each code point: LETTER, NUMBER, OTHER, SPACE_LAST (any space U+0020) or WHITE_LAST."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[WHITE_SPACE] = WHITE_LAST
    out[0x20] = SPACE_LAST
    return out


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(_classes())
    return _CLASSES[0]


def symbols(data: np.ndarray) -> np.ndarray:
    """The splitter's symbol of each byte of UTF-8 ``data``, in which byte 0xFF ends a text."""
    table = classes()
    sym = np.full(len(data), INSIDE, np.uint8)
    ascii_ = data < 0x80
    sym[ascii_] = table[:128][data[ascii_]]
    lead = np.flatnonzero((data >= 0xC0) & (data < 0xFF))
    if len(lead):
        b0 = data[lead].astype(np.uint32)
        pad = np.concatenate([data, np.zeros(4, np.uint8)])
        b1, b2, b3 = (pad[lead + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        point = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
        sym[lead] = table[np.minimum(point, sys.maxunicode)]
    sym[data == 0xFF] = RESET
    white = np.flatnonzero((sym == SPACE_LAST) | (sym == WHITE_LAST))
    if len(white):
        # The next character's symbol; a lead byte says how many bytes to skip.
        step = np.ones(len(white), np.int64)
        b = data[white]
        step[b >= 0xC0], step[b >= 0xE0] = 2, 3
        after = np.append(sym, np.uint8(RESET))[np.minimum(white + step, len(sym))]
        mid = (after == SPACE_LAST) | (after == WHITE_LAST) | (after == RESET)
        sym[white[mid]] += 1
    apo = np.flatnonzero(data == 0x27)
    if len(apo):
        pad = np.concatenate([data, np.full(2, 0xFF, np.uint8)])
        one, two = pad[apo + 1].astype(np.int64), pad[apo + 2].astype(np.int64)
        pair = one << 8 | two
        sym[apo[np.isin(one, list(b"stmd"))]] = APO2
        sym[apo[np.isin(pair, [int.from_bytes(w, "big") for w in (b"re", b"ve", b"ll")])]] = APO3
    return sym


def starts(sym: np.ndarray, chunk: int = 64) -> np.ndarray:
    """Positions at which pre-tokens start: chunk state maps, their prefix scan, then one run with known states."""
    n = len(sym)
    rows = -(-n // chunk) or 1
    grid = np.full(rows * chunk, INSIDE, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], rows, 1)
    for x in grid:
        maps = NEXT[maps * np.uint8(N_SYMBOLS) + x]
    scanned = scan_maps(maps.T)
    state = np.concatenate([[np.uint8(FRESH)], scanned[:-1, FRESH]])
    found = np.empty((chunk, rows), np.uint8)
    for k, x in enumerate(grid):
        at = state * np.uint8(N_SYMBOLS) + x
        found[k], state = EMIT[at], NEXT[at]
    return np.flatnonzero(found.T.ravel()[:n])


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), in log2 steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], 1)
        step *= 2
    return out


class Merger:
    """The merge transducer of a vocabulary, determinised as far as texts have needed."""

    def __init__(self, pairs: BytePairs, max_states: int):
        self.pairs, self.max_states = pairs, max_states
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.width, self.seen = 64, np.full(256, -1, np.int32)
        self.bytes_seen = 0
        self.next = np.full((1024, self.width), -1, np.int32)
        self.emit = np.zeros((1024, self.width), np.int8)

    def column(self, data: np.ndarray) -> np.ndarray:
        """The table column of each byte; new byte values get new columns."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)[:256] * (self.seen < 0)):
            if self.bytes_seen == self.width:
                more = self.width
                self.next = np.hstack([self.next, np.full((len(self.next), more), -1, np.int32)])
                self.emit = np.hstack([self.emit, np.zeros((len(self.emit), more), np.int8)])
                self.width += more
            self.seen[b] = self.bytes_seen
            self.bytes_seen += 1
        self.byte_of = np.flatnonzero(self.seen >= 0)[np.argsort(self.seen[self.seen >= 0])]
        return self.seen[data]

    def learn(self, state: int, col: int) -> None:
        byte, pairs = int(self.byte_of[col]), self.pairs
        moved, best = [], None
        for node, before, count in self.states[state]:
            to = pairs.child.get(node * 256 + byte)
            if to is None:
                continue
            moved.append((to, before, count))
            token = pairs.token_at.get(to)
            if best is None and token is not None and (before < 0 or pairs.fits(before, token)):
                best = (token, count + 1)
        token, total = best
        key = tuple(sorted({(n, b, c - total) for n, b, c in moved} | {(0, token, 0)}))
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to >= len(self.next):
                self.next = np.vstack([self.next, np.full_like(self.next, -1)])
                self.emit = np.vstack([self.emit, np.zeros_like(self.emit)])
        self.next[state, col], self.emit[state, col] = to, total

    def count(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[begin : begin + length]."""
        if len(self.states) > self.max_states:
            self.reset()
        order = np.argsort(-length, kind="stable")
        begin, sizes = begin[order], -length[order]
        col, total = self.column(data), np.zeros(len(order), np.int32)
        state = np.zeros(len(order), np.int32)
        for step in range(int(-sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(sizes, -step, "left"))  # those longer than step
            s, c = state[:live], col[begin[:live] + step]
            at = s.astype(np.int64) * self.width + c
            to = self.next.ravel()[at]
            if to.min(initial=0) < 0:
                for key in np.unique(at[to < 0]).tolist():
                    self.learn(*divmod(key, self.width))
                to = self.next.ravel()[at]
            total[:live] += self.emit.ravel()[at]
            state[:live] = to
        out = np.empty(len(order), np.int32)
        out[order] = total
        return out


class TokenCounter:
    """Counts of batches of UTF-8 texts."""

    def __init__(self, path: str, max_states: int = 250_000):
        self.pairs = byte_pairs(path)
        self.merger = Merger(self.pairs, max_states)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        special = np.zeros(len(texts), np.int64)
        ends = b"\xff"
        for mark in self.pairs.specials:
            for k, text in enumerate(texts):
                if mark in text:
                    special[k] += text.count(mark)
                    texts = [*texts[:k], text.replace(mark, ends), *texts[k + 1 :]]
        joined = ends.join(texts) + ends
        data = np.frombuffer(joined, np.uint8)
        begin = starts(symbols(data))
        # A pre-token ends where the next one starts or its text ends.
        marks = np.flatnonzero(data == 0xFF)
        stop = np.append(begin[1:], len(data))
        stop = np.minimum(stop, marks[np.searchsorted(marks, begin)]) if len(begin) else stop[:0]
        n = self.merger.count(data, begin, (stop - begin).astype(np.int32)) if len(begin) else np.zeros(0, np.int32)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        owner = np.searchsorted(np.cumsum(sizes), begin, "right")
        return special + np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)[: len(texts)]


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, piece_bytes: int = 1 << 22) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text; one row for each input row, repeated ids included.

    ``path``: a byte-level BPE file of the tokenizers library, at the same place on every machine.
    ``piece_bytes``: texts are counted in groups of about so many bytes, which bounds the working memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = utf8_list(batch.column(1))
            sizes, n, k = [len(t) for t in texts], [], 0
            while k < len(texts):
                j, total = k, 0
                while j < len(texts) and (j == k or total + sizes[j] <= piece_bytes):
                    total += sizes[j]
                    j += 1
                n.append(count.counts(texts[k:j]))
                k = j
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_documents(docs, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
