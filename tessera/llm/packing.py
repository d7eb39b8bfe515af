"""Vector bin packing of tokenized examples into fixed-length training sequences.

Items are pieces of examples with three sizes: tokens, segments (1 each) and loss-bearing tokens.  Bins are
sequences with a limit on each.  A bin takes, of the waiting pieces that fit, the one with the largest dot
product of its sizes (as shares of the limits) and the bin's free shares; ties go to the piece that came first.
Where none fits, a piece is cut to what is left.  A sequence that another limit ends before it is full is cut back to a
power of two, as is what a partition cannot fill at its end; so there is no padding, however short the examples are.

Packing is local to a scan partition and streams through it: no shuffle, memory bounded by ``window`` pieces.
Pieces of one document are cut at multiples of the sequence length first.  Rows repeat as often as the input's
rows do; null and empty texts are one piece, the closing id.  Results are the same whenever a task is run again.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.byte_pairs import byte_alphabet
from tessera.llm.docmap import map_documents

#: Letters, digits and white space on which re and regex agree.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ɏ]")
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")


class Words(dict):
    """Ids of pre-tokens; two generations of at most ``most`` each, of which the older one is given up in the end."""

    def __init__(self, encode: Callable[[bytes], list[int]], most: int):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.encode(word.encode())).tobytes()
        if len(word) > 64:  # so that the cache is bounded in bytes
            return ids
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordIds:
    """Ids of whole texts, as the tokenizers library gives them for a byte-level BPE file without normalization.

    Pre-tokens are looked up in a bounded cache; the file's vocabulary, whose ids are the ranks of its merges, encodes
    those that are not there.  Texts that may hold special strings go to the library itself.
    """

    def __init__(self, path: str, most_words: int = 120_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in, special = byte_alphabet(), {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(stand_in[c] for c in s): i for s, i in spec["model"]["vocab"].items() if i not in special}
        pieces = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = regex.compile(public_tokenizers.PATTERN)
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.of = Words(pieces._core_bpe.encode_single_piece, most_words).__getitem__

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids; special strings as the library handles them."""
        if any(mark in text for mark in self.marks):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.of, self.exact.findall(text) if _PLAIN.search(text) else _FAST.findall(text)))


class Packer:
    """Places pieces (key, start, tokens, loss tokens) and yields closed sequences as lists of pieces."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, window: int = 128):
        self.limits = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.window = window
        self.waiting: list[tuple] = []  # (key, start, tokens, tokens that bear loss: the last ones)

    def add(self, pieces: list[tuple]) -> Iterator[list[tuple]]:
        for piece in pieces:
            if piece[2] == self.limits[0] and piece[3] <= self.limits[2]:
                yield [piece]
            else:
                self.waiting.append(piece)
        while len(self.waiting) > self.window:
            yield self._fill(int(self.limits[0]))

    def finish(self) -> Iterator[list[tuple]]:
        while self.waiting:
            total = sum(p[2] for p in self.waiting)
            yield self._fill(min(int(self.limits[0]), 1 << (total.bit_length() - 1)))

    def _fill(self, capacity: int) -> list[tuple]:
        """One sequence of ``capacity`` tokens, or fewer where another limit is reached."""
        limits = np.array([capacity, self.limits[1], self.limits[2]])
        free, chosen = limits.copy(), []
        sizes = np.array([(p[2], 1, p[3]) for p in self.waiting], np.float64)
        taken = np.zeros(len(sizes), bool)
        back: list[tuple] = []
        while free[0] >= 1 and free[1] >= 1 and not taken.all():
            fit = ~taken & (sizes <= free).all(1)
            if fit.any():
                k = int(np.argmax(np.where(fit, (sizes / limits) @ (free / limits), -1.0)))
                taken[k] = True
                free -= sizes[k]
                chosen.append(self.waiting[k])
                continue
            # Cut the first piece that is left: its head fills what is free.
            k = int(np.argmin(taken))
            tokens, loss = self.waiting[k][2:]
            n = int(min(tokens, free[0], tokens - loss + free[2]))
            if n < 1:
                break
            head, tail = _cut(self.waiting[k], n)
            chosen.append(head)
            back += [tail] if tail[2] else []
            taken[k] = True
            free -= (n, 1, head[3])
        total = sum(p[2] for p in chosen)
        over = total - (1 << (total.bit_length() - 1)) if total < self.limits[0] else 0
        while over:
            last = chosen.pop()
            if last[2] > over:
                last, tail = _cut(last, last[2] - over)
                chosen.append(last)
                back.append(tail)
                break
            over -= last[2]
            back.append(last)
        self.waiting = back + [p for p, gone in zip(self.waiting, taken, strict=True) if not gone]
        return chosen


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    """The first ``n`` tokens and the rest; tokens that bear loss are a piece's last ones."""
    key, start, tokens, loss = piece
    head = max(0, n - (tokens - loss))
    return (key, start, n, head), (key, start + n, tokens - n, loss - head)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    max_tokens: int = 1024,
    max_segments: int = 64,
    max_loss: int | None = None,
    end_id: int = 0,
    loss_start: Callable[[int, int], int] | None = None,
    window: int = 128,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    ``max_segments`` and ``max_loss`` (default: ``max_tokens``) are the other two limits of a sequence.
    ``loss_start``: of a doc_id and its number of tokens, the token from which on they bear loss, as those of an answer
    after its prompt; all do by default.
    A sequence_id holds the partition in its upper bits, so ids are unique without any exchange.
    """
    most_loss = max_tokens if max_loss is None else max_loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 36
        words, packer, number = word_ids(tokenizer_path), Packer(max_tokens, max_segments, most_loss, window), 0
        kept: dict[int, list] = {}  # document number -> [doc_id, ids, tokens not placed yet, all tokens]
        end = np.array([end_id], "<u4").tobytes()
        at = 0

        def rows(sequences: Iterator[list[tuple]]) -> Iterator[tuple]:
            nonlocal number
            for pieces in sequences:
                offset = 0
                for key, start, n, _ in pieces:
                    doc = kept[key]
                    yield doc[0], start, n, zlib.crc32(memoryview(doc[1])[4 * start : 4 * (start + n)]), doc[3], part + number, offset
                    offset += n
                    doc[2] -= n
                    if not doc[2]:
                        del kept[key]
                number += 1

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, names=names)
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.encode(text or "") + end
                n = len(ids) // 4
                kept[at] = [doc_id, ids, n, n]
                first = 0 if loss_start is None else loss_start(doc_id, n)
                out.extend(rows(packer.add([(at, s, m := min(max_tokens, n - s), min(m, max(0, s + m - first))) for s in range(0, n, max_tokens)])))
                at += 1
            yield batch_of(out)
        yield batch_of(list(rows(packer.finish())))

    return map_documents(docs, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]
