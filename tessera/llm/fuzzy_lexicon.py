"""Levenshtein automata of all terms at once: the lexicon's trie times the edit automaton, determinised.

A state is the set of (trie node, edits so far) that the characters read can be in.  Terms of at least
``min_fuzzy`` characters allow one edit (a wrong, missing, extra or swapped character), shorter ones none.
Whole terms accept at a word's end; stems accept any word that begins with them.
"""

from __future__ import annotations

import sys

import numpy as np

OUTSIDE, FOREIGN = 0, 1  # character classes: ends a word; a word character that no term has
_LETTERS: list[np.ndarray] = []


def word_points() -> np.ndarray:
    """Whether each code point, up to the last that is one, is a word character: letters, digits, and * @ $."""
    if not _LETTERS:
        points = np.array([c for c in range(sys.maxunicode + 1) if chr(c).isalnum() or chr(c) in "*@$"])
        _LETTERS.append(np.zeros(points[-1] + 2, bool))
        _LETTERS[0][points] = True
    return _LETTERS[0]


def _fold(c: str) -> str:
    """Lower case; a sigma at a word's end is a sigma."""
    return c.lower().replace("ς", "σ")


class FuzzyLexicon:
    """terms: (term in lower case, whether it is a stem)."""

    def __init__(self, terms: list[tuple[str, bool]], min_fuzzy: int = 5):
        self.terms, self.min_fuzzy = list(dict.fromkeys(terms)), min_fuzzy
        self.letters = {c: k for k, c in enumerate(sorted({c for t, _ in self.terms for c in _fold(t)}), FOREIGN + 1)}
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.fuzzy_below = [False]
        for k, (term, _) in enumerate(self.terms):
            node = 0
            for c in _fold(term):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.fuzzy_below.append(False)
                node = self.child[node][c]
            self.ends[node].append(k)
        for node in range(len(self.child) - 1, -1, -1):
            long_enough = any(len(self.terms[k][0]) >= min_fuzzy for k in self.ends[node])
            self.fuzzy_below[node] = long_enough or any(self.fuzzy_below[n] for n in self.child[node].values())
        self._determinise()
        self.classes = self._classes()

    def _close(self, states: set) -> frozenset:
        """With missing characters, and stems that are through."""
        out, todo = set(states), list(states)
        while todo:
            s = todo.pop()
            if s[0] != "at":
                continue
            _, node, edits = s
            new = [("hit", k, edits) for k in self.ends[node] if self.terms[k][1] and (not edits or len(self.terms[k][0]) >= self.min_fuzzy)]
            if not edits and self.fuzzy_below[node]:
                new += [("at", n, 1) for n in self.child[node].values() if self.fuzzy_below[n]]
            for x in new:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        exact = {s[1] for s in out if s[0] != "hit" and s[-1] == 0}
        return frozenset(s for s in out if not (s[0] == "at" and s[2] and s[1] in exact))

    def _step(self, states: frozenset, c: str) -> frozenset:
        out = set()
        for s in states:
            if s[0] == "hit":
                out.add(s)
            elif s[0] == "swap":
                if c == s[2]:
                    out.add(("at", s[1], 1))
            else:
                _, node, edits = s
                if (n := self.child[node].get(c)) is not None:
                    out.add(("at", n, edits))
                if not edits and self.fuzzy_below[node]:
                    out.add(("at", node, 1))
                    for x, n in self.child[node].items():
                        if self.fuzzy_below[n]:
                            out.add(("at", n, 1))
                            if c != x and (m := self.child[n].get(c)) is not None and self.fuzzy_below[m]:
                                out.add(("swap", m, x))
        return self._close(out)

    def _accepts(self, states: frozenset) -> tuple[int, int] | None:
        """(edits, term) of the best hit at a word's end."""
        hits = [(s[2], s[1]) for s in states if s[0] == "hit"]
        hits += [(s[2], k) for s in states if s[0] == "at" for k in self.ends[s[1]] if not s[2] or len(self.terms[k][0]) >= self.min_fuzzy]
        return min(hits, default=None)

    def _determinise(self) -> None:
        width = FOREIGN + 1 + len(self.letters)
        first = self._close({("at", 0, 0)})
        number, order, rows = {frozenset(): 0, first: 1}, [frozenset(), first], []
        for states in order:  # grows while it is walked
            row = [0] * width
            for c, col in [("", FOREIGN), *self.letters.items()]:
                to = self._step(states, c) if states else frozenset()
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row[col] = number[to]
            rows.append(row)
        self.next = np.array(rows, np.int32)
        best = [self._accepts(s) for s in order]
        self.edits = np.array([-1 if b is None else b[0] for b in best], np.int8)
        self.term = np.array([-1 if b is None else b[1] for b in best], np.int32)
        #: All that can follow accepts alike, so reading can stop.
        self.settled = np.array([bool(s) and all(x[0] == "hit" for x in s) for s in order])

    def _classes(self) -> np.ndarray:
        """Of the code points up to the last word character; the last entry stands for all beyond it."""
        word = word_points()
        out = np.full(len(word), OUTSIDE, np.uint8 if len(self.letters) < 250 else np.uint16)
        out[word] = FOREIGN
        # All code points whose lower case is a term's letter: few letters have more than two.
        for c in np.flatnonzero(word).tolist():
            if (k := self.letters.get(_fold(chr(c)))) is not None:
                out[c] = k
        return out

    def find(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(position, term, edits) of the words of ``points`` (code points) that match; all words in lock step."""
        if len(self.terms) == 0 or not len(points):
            return []
        cls = np.append(self.classes[np.minimum(points, len(self.classes) - 1)], self.classes.dtype.type(OUTSIDE))
        word = cls[:-1] != OUTSIDE
        start = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        width, table = self.next.shape[1], self.next.ravel()
        at, state, found = start.copy(), np.ones(len(start), np.int32), []
        while len(start):
            c = cls[at]
            ended = (c == OUTSIDE) | self.settled[state]
            if ended.any():
                hit = ended & (self.edits[state] >= 0)
                found += zip(start[hit].tolist(), self.term[state[hit]].tolist(), self.edits[state[hit]].tolist(), strict=True)
                live = ~ended
                start, at, state, c = start[live], at[live], state[live], c[live]
            state = table[state * width + c]
            live = state > 0
            start, at, state = start[live], at[live] + 1, state[live]
        return sorted(found)
