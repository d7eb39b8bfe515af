"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A text is encoded left to right.  At each position an Aho-Corasick automaton has the longest piece that starts
there; a piece is taken if its left neighbour and it are compatible, that is, if merging their characters again
leaves just these two; else the next shorter piece is tried, and if none fits, the last piece is given up.  A
bitfield holds the positions from which no way led on, so each is left at most once.

The model's pieces never cross from another character to a word mark, so a text splits into units of word marks
and what follows, which are encoded one by one; a bounded cache keeps units that were met before.  Characters
that the model lacks fall back to their UTF-8 bytes.

Null and empty texts have the begin and end ids only.  Equal texts get equal ids, repeated rows are repeated, texts of
any length are encoded whole, and other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.docmap import map_documents

MARK = "▁"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceModel:
    """Pieces of a merge-type model with identity normalization."""

    def __init__(self, path: str, max_units: int = 300_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        n = range(model.get_piece_size())
        self.text_of = [model.id_to_piece(i) for i in n]
        self.byte_id = {int(self.text_of[i][3:-1], 16): i for i in n if model.is_byte(i)}
        self.plain = {self.text_of[i]: i for i in n if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        #: Merges are made by score, so a piece's rank is its place in that order.
        order = sorted(self.plain.values(), key=lambda i: -model.get_score(i))
        self.rank = {i: r for r, i in enumerate(order)}
        self.split: dict[int, tuple[int, int]] = {}
        self.reachable = set()
        for piece, i in self.plain.items():
            ids, last = self.merge(piece)
            if ids == [i]:
                self.reachable.add(i)
                if last:
                    self.split[i] = last
        self.find = ahocorasick.Automaton()
        for piece, i in self.plain.items():
            if i in self.reachable:
                self.find.add_word(piece, (i, len(piece)))
        self.find.make_automaton()
        #: The next shorter piece that starts where a piece starts.
        self.shorter = {i: self._shorter(p) for p, i in self.plain.items()}
        self._fits: dict[tuple[int, int], bool] = {}
        self.units = Units(self.encode_unit, max_units)
        self.size = [len(t) for t in self.text_of]
        self.bytes_of = [bytes((int(t[3:-1], 16),)) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else t.replace(MARK, " ").encode() for i, t in enumerate(self.text_of)]

    def _shorter(self, piece: str) -> int | None:
        for n in range(len(piece) - 1, 0, -1):
            if (i := self.plain.get(piece[:n])) is not None and i in self.reachable:
                return i
        return None

    def merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """The definition: best rank first, leftmost first.  Ids, and the two parts of the last merge."""
        parts, last = [self.plain[c] for c in text], None
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                to = self.plain.get(self.text_of[parts[k]] + self.text_of[parts[k + 1]])
                if to is not None and (best is None or self.rank[to] < best[0]):
                    best = (self.rank[to], k, to)
            if best is None:
                break
            last = (parts[best[1]], parts[best[1] + 1])
            parts[best[1] : best[1] + 2] = [best[2]]
        return parts, last

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the characters of both again leaves just these two."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self._remerge(left, right)
        return known

    def _remerge(self, a: int, b: int) -> bool:
        """Undo the later of the two last merges; no merge across the seam may come before the one undone last."""
        limit, on_left = len(self.rank) + 1, True
        while True:
            across = self.plain.get(self.text_of[a] + self.text_of[b])
            if across is not None:
                r = self.rank[across]
                if r < limit or (r == limit and not on_left):
                    return False
            ra = self.rank[a] if a in self.split else -1
            rb = self.rank[b] if b in self.split else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, on_left, a = ra, True, self.split[a][1]
            elif rb > ra:
                limit, on_left, b = rb, False, self.split[b][0]
            else:  # the same piece on both sides: the right one was made later
                limit, on_left, b = rb, False, self.split[b][0]

    def _known(self, text: str) -> list[int]:
        """Ids of characters that are all pieces."""
        if not (n := len(text)):
            return []
        if (whole := self.plain.get(text)) in self.reachable:
            return [whole]
        size_of, shorter, seams = self.size, self.shorter, self._fits
        longest = {end - size: i for end, (i, size) in self.find.iter(text)}  # ends rise, so the longest comes last
        failed, ids, ends, at = 0, [], [], 0
        piece, before = longest[-1], None
        while True:
            while piece is not None:
                stop = at + size_of[piece]
                if not failed >> stop & 1:
                    if before is None:
                        break
                    ok = seams.get((before, piece))
                    if ok or (ok is None and self.fits(before, piece)):
                        break
                piece = shorter[piece]
            if piece is not None:
                ids.append(piece)
                if stop == n:
                    return ids
                ends.append(at)
                at, before, piece = stop, piece, longest[stop - 1]
            else:
                failed |= 1 << at
                piece = shorter[ids.pop()]
                at = ends.pop()
                before = ids[-1] if ids else None

    def encode_unit(self, unit: str) -> list[int]:
        if self.plain.keys() >= set(unit):
            return self._known(unit)
        out, begin = [], 0
        for k, c in enumerate(unit):
            if c not in self.plain:
                out += self._known(unit[begin:k])
                out += [self.byte_id[b] for b in c.encode()]
                begin = k + 1
        return out + self._known(unit[begin:])

    def decode(self, ids: Iterable[int]) -> bytes:
        """UTF-8 of the decoded text; the space that encoding put before it goes."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).removeprefix(b" ")

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids, without begin and end."""
        if not text:
            return b""
        return b"".join(map(self.units.of, _UNITS.findall(MARK + text.replace(" ", MARK))))


class Units(dict):
    """Ids of units; two generations of at most ``most`` units each, of which the older one is given up in the end."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}
        self.of = self.__getitem__

    def __missing__(self, unit: str) -> bytes:
        if len(unit) > 64:  # so that the cache is bounded in bytes
            return array("I", self.encode(unit)).tobytes()
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(unit)
        if ids is None:
            ids = array("I", self.encode(unit)).tobytes()
        self[unit] = ids
        return ids


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every text, begin and end ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        first, last = (np.array([i], "<u4").tobytes() for i in (model.begin, model.end))
        for batch in batches:
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = first + model.encode(text or "") + last
                decoded = model.decode(array("I", ids))
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return map_documents(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
