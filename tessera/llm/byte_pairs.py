"""Byte-level BPE vocabulary: tokens as bytes, ranks, and the re-merge test for neighbours."""

from __future__ import annotations

import json
from functools import lru_cache


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its published rule.

    Bytes that are printable in Latin-1 stand for themselves, the others follow from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Tokens, merge ranks and a trie of one byte-level BPE vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, stand_in = spec["model"], byte_alphabet()
        to_bytes = lambda s: bytes(stand_in[c] for c in s)
        self.id_of = {to_bytes(s): i for s, i in model["vocab"].items() if all(c in stand_in for c in s)}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # (left, right) -> (rank, merged)
        self.split: dict[int, tuple[int, int, int]] = {}  # merged -> (rank, left, right)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.id_of[to_bytes(a)], self.id_of[to_bytes(b)]
            merged = self.id_of[self.bytes_of[left] + self.bytes_of[right]]
            self.merge.setdefault((left, right), (rank, merged))
            self.split.setdefault(merged, (rank, left, right))
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at: dict[int, int] = {}
        nodes = 1
        for word, i in self.id_of.items():
            if self.encode(word) != [i]:
                continue  # merges never produce it
            node = 0
            for byte in word:
                key = node * 256 + byte
                if (nxt := self.child.get(key)) is None:
                    nxt = self.child[key] = nodes
                    nodes += 1
                node = nxt
            self.token_at[node] = i
        self._fits: dict[int, bool] = {}

    def encode(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first: the definition, used for single tokens and as the test's yardstick."""
        parts = [self.id_of[bytes((b,))] for b in word]
        while len(parts) > 1:
            best = min(((self.merge[p][0], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merge), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [self.merge[parts[k], parts[k + 1]][1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of ``left`` + ``right`` leaves just these two tokens.

        Undo the later of the two tokens' last merges again and again; a merge across the seam
        that comes before the merge undone last would have been made instead.
        """
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._remerge(left, right)
        return known

    def _remerge(self, a: int, b: int) -> bool:
        limit, undone_left = len(self.merge) + 1, True
        while True:
            across = self.merge.get((a, b))
            # A tie with a merge undone on the left can't be: one rank is one pair; on the right the seam comes first.
            if across is not None and (across[0] < limit or (across[0] == limit and not undone_left)):
                return False
            ra, rb = self.split.get(a, (-1,))[0], self.split.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, undone_left, a = ra, True, self.split[a][2]
            else:
                limit, undone_left, b = rb, False, self.split[b][1]


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)
