"""Word co-occurrence counts: for each word, how many other words it shares a line with.

Words are dealt into blocks by a checksum.  Each pair of blocks is a cell: it gets, of every line, the words of its two
blocks, and counts for each word of one the different words of the other.  Pairs of words are only ever made inside a
cell, a few million at once; what is shuffled are the lines' words, once for each cell they belong to.

Inside a cell, words that only one of its lines has make pairs that no other line has: they are counted, not made.  The
other words' partners are marked in an array, or where they are few next to it, sorted as numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessera.functions.parsing import words
from tessera.operators.serving import NotFoundError

#: Words of lines, repeats included, for each block; a cell holds two blocks.  Words that a task deals at once.  Pairs that are made at once.
BLOCK, DEAL, CHUNK = 24_000_000, 4_000_000, 1 << 20
#: So many pairs of a word, and a 64th of the codes they may have, are marked, fewer are sorted.
MARKED = 1000
_SIDES = "{0}_words binary, {0}_codes binary, {0}_lengths binary"


def _squeezed(data: bytes | np.ndarray) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _pack(numbers: np.ndarray) -> bytes:
    """The size of a number, then all lowest bytes, all second bytes and so on, compressed."""
    most = int(numbers.max()) if len(numbers) else 0
    size = max(1, -(-most.bit_length() // 8))
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:size]
    return bytes([size]) + _squeezed(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_unsqueezed(packed[1:]), np.uint8).reshape(packed[0], -1)
    out = planes[0].astype(np.int32)
    for k in range(1, packed[0]):
        out |= planes[k].astype(np.int32) << (8 * k)
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.ListArray]:
    """Lines of about ``DEAL`` words together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0))
        size += len(held[-1].flatten())
        if size >= DEAL:
            yield pa.concat_arrays(held)
            held, size = [], 0
    if size:
        yield pa.concat_arrays(held)


def _dealt(batches: Iterator[pa.RecordBatch], blocks: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each cell of two blocks and some lines one row: of the lines with words in both blocks these words, as codes, frequent ones first."""
    for lists in _gathered(batches):
        coded = lists.flatten().dictionary_encode()
        codes, vocabulary = coded.indices.to_numpy(), coded.dictionary
        line = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        block = np.fromiter(map(crc32, vocabulary.cast(pa.binary()).to_pylist()), np.uint32, len(vocabulary)) % blocks
        of, sides = block.astype(np.uint16)[codes], []
        for b in range(blocks):
            at = np.flatnonzero(of == b)
            sides.append((codes[at], line[at], np.bincount(line[at], minlength=len(lists))))
        for i in range(blocks):
            for j in range(i, blocks):
                kept = sides[i][2] > 1 if i == j else (sides[i][2] > 0) & (sides[j][2] > 0)
                if not kept.any():
                    continue
                row = [i * blocks - i * (i - 1) // 2 + j - i]
                for own_codes, own_line, lengths in (sides[i], sides[j])[: 1 + (i < j)]:
                    own = own_codes[kept[own_line]]
                    often = np.bincount(own, minlength=len(vocabulary))
                    used = np.flatnonzero(often)
                    used = used[np.argsort(-often[used], kind="stable")]
                    number = np.zeros(len(vocabulary), np.int32)
                    number[used] = np.arange(len(used))
                    # Words have no spaces.
                    mine = vocabulary.take(pa.array(used))
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine), " ")[0].as_py()
                    row += [_squeezed(joined.encode()), _pack(number[own]), _pack(lengths[kept])]
                row += [None] * (len(schema) - len(row))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)


def _side(table: pa.Table, name: str) -> tuple[pa.Array, _Side]:
    """The different words, and where they are."""
    parts = [pc.split_pattern(pa.array([_unsqueezed(x.as_py()).decode()]), " ").flatten() for x in table.column(f"{name}_words")]
    starts = np.cumsum([0, *map(len, parts)])
    coded = pa.concat_arrays(parts).dictionary_encode()
    del parts
    number = coded.indices.to_numpy()
    lengths = np.concatenate([_unpack(x.as_py()) for x in table.column(f"{name}_lengths")])
    codes, k = np.empty(lengths.sum(), np.int32), 0
    for s, x in zip(starts, table.column(f"{name}_codes"), strict=False):
        own = number[s:][_unpack(x.as_py())]
        codes[k : k + len(own)] = own
        k += len(own)
    words_ = coded.dictionary
    del coded, number
    pa.default_memory_pool().release_unused()
    return words_, _Side.of(codes, lengths, len(words_))


def _partners(starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """``codes`` of runs, one run after another."""
    ends = np.cumsum(lengths, dtype=np.int32)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return codes[at]


@dataclass
class _Side:
    """One block's words in a cell: those that one line has, with their lines; the others, numbered anew, with how many a line has."""

    n: int
    lengths: np.ndarray
    place: np.ndarray
    once: np.ndarray
    once_line: np.ndarray
    codes: np.ndarray
    many: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, lengths: np.ndarray, n: int) -> _Side:
        often = _tallied(codes, n)
        kept = (often > 1)[codes]
        at = np.flatnonzero(~kept)
        once, once_line = codes[at], _lines_at(at, lengths)
        number = np.cumsum(often > 1, dtype=np.int32) - 1
        singles = np.bincount(once_line, minlength=len(lengths))
        return cls(n, lengths, np.flatnonzero(often > 1), once, once_line, number[codes[kept]], (lengths - singles).astype(np.int32))

    def singles(self) -> np.ndarray:
        return self.lengths - self.many


def _tallied(codes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k in range(0, len(codes), CHUNK):
        out += np.bincount(codes[k : k + CHUNK], minlength=n)
    return out


def _lines_at(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lines of rising places in the codes of lines."""
    return np.searchsorted(np.cumsum(lengths, dtype=np.int64), at, "right").astype(np.int32)


def _added(codes: np.ndarray, lengths: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each code the sum of the values of its lines."""
    out, ends = np.zeros(n, np.int64), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    for at in _cuts(lengths):
        out += np.bincount(codes[ends[at.start] : ends[at.stop]], np.repeat(values[at], lengths[at]), n).astype(np.int64)
    return out


def partner_counts(a: np.ndarray, a_lengths: np.ndarray, n_a: int, b: np.ndarray, b_lengths: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """For each code of ``a`` how many different codes of ``b`` lie in a line with it, and the other way round.

    A line has ``lengths`` codes, none twice; a cell has at most 2 ** 31 words, so lines and codes are 32 bits.
    """
    return _met(_Side.of(a, a_lengths, n_a), _Side.of(b, b_lengths, n_b))


def _met(a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray]:
    counts_a, counts_b = np.zeros(a.n, np.int64), np.zeros(b.n, np.int64)
    # Words of one line: each pair with them is there once.
    counts_a[a.once] = b.lengths[a.once_line]
    counts_b[b.once] = a.lengths[b.once_line]
    n_a, n_b = len(a.place), len(b.place)
    found_a, found_b = _added(a.codes, a.many, b.singles(), n_a), _added(b.codes, b.many, a.singles(), n_b)
    # The others, some words of ``a`` after some.
    starts = np.cumsum(b.many, dtype=np.int32) - b.many
    for some in _cuts(_tallied(a.codes, n_a)) if len(b.codes) else ():
        at = np.flatnonzero((a.codes >= some.start) & (a.codes < some.stop))
        own, line = a.codes[at] - some.start, _lines_at(at, a.many)
        order = np.argsort(own, kind="stable")
        found, partners = _found(own[order], line[order], some.stop - some.start, starts, b.many, b.codes, n_b)
        found_a[some] += found
        found_b += partners
    counts_a[a.place] = found_a
    counts_b[b.place] = found_b
    return counts_a, counts_b


def _found(own: np.ndarray, line: np.ndarray, n: int, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """For ``n`` words, whose lines come sorted by word, how many different ``other`` codes these have; for each of those, of how many words."""
    made = lengths[line]
    bounds = np.searchsorted(own, np.arange(n + 1))
    totals = np.diff(np.concatenate([[0], np.cumsum(made, dtype=np.int64)])[bounds])
    found, found_other = np.zeros(n, np.int64), np.zeros(n_other, np.int64)
    dense = totals >= max(MARKED, n_other // 64)
    marks, tally, tallied = np.zeros(n_other, bool), np.zeros(n_other, np.uint8), 0
    for w in np.flatnonzero(dense):
        lo, hi = bounds[w], bounds[w + 1]
        marks[:] = False
        for at in _cuts(made[lo:hi]):
            lines = line[lo + at.start : lo + at.stop]
            marks[_partners(starts[lines], lengths[lines], other)] = True
        found[w] = np.count_nonzero(marks)
        tally += marks.view(np.uint8)
        tallied += 1
        if tallied == 255:
            found_other += tally
            tally[:], tallied = 0, 0
    found_other += tally
    few = ~dense[own]
    line, own, made = line[few], own[few], made[few]
    # Whole words together.
    whole = np.flatnonzero(np.diff(own, prepend=-1))
    for at in _cuts(np.add.reduceat(made, whole)) if len(whole) else ():
        lo, hi = whole[at.start], whole[at.stop] if at.stop < len(whole) else len(line)
        lines, base = line[lo:hi], int(own[lo])
        keys = np.repeat((own[lo:hi] - base).astype(np.int64) * n_other, made[lo:hi]) + _partners(starts[lines], lengths[lines], other)
        keys.sort()
        keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
        each = keys // n_other
        n_each = np.bincount(each)
        found[base : base + len(n_each)] += n_each
        found_other += np.bincount(keys - each * n_other, minlength=n_other)
    return found, found_other


def _cuts(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of ``sizes`` of about CHUNK in sum, or of one."""
    ends, k = np.cumsum(sizes, dtype=np.int64), 0
    while k < len(sizes):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CHUNK, "right")))
        yield slice(k, stop)
        k = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n of the cell that a task has; a cell of one block has nulls in place of another's words."""
    if not (held := [x for x in batches if x.num_rows]):
        return
    table = pa.Table.from_batches(held)
    vocabulary, a = _side(table, "a")
    if table.column("b_words").null_count:
        # Each word also meets itself.
        n = _met(a, a)[0] - 1
    else:
        other, b = _side(table, "b")
        vocabulary, n = pa.concat_arrays([vocabulary, other]), np.concatenate(_met(a, b))
    met = np.flatnonzero(n)
    for k in range(0, len(met), 1 << 16):
        yield pa.RecordBatch.from_arrays([vocabulary.take(pa.array(met[k : k + (1 << 16)])), pa.array(n[met[k : k + (1 << 16)]], pa.int64())], names=["word", "n"])
    pa.default_memory_pool().release_unused()


def cooccurrence(lines: DataFrame, column: str = "value") -> DataFrame:
    """word, count of distinct other words on the same line, over all lines."""
    spaced = F.length(column) - F.length(F.replace(F.col(column), F.lit(" "), F.lit(""))) + 1
    total = lines.agg(F.sum(spaced.cast("long"))).first()[0] or 0
    blocks = max(4, -(-total // BLOCK))
    line = lines.select(F.array_distinct(words(F.col(column))).alias("w")).where(F.size("w") > 1)
    schema = "cell int, " + ", ".join(_SIDES.format(x) for x in "ab")
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))])
    cells = line.mapInArrow(lambda batches: _dealt(batches, blocks, arrow), schema)
    # A task for each cell, without sorting.
    counted = cells.repartitionById(blocks * (blocks + 1) // 2, F.col("cell")).mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").cast("int").alias("count"))


def updated(model: DataFrame, lines: DataFrame, column: str = "value") -> DataFrame:
    """word, count of the words of a micro-batch: the model's count plus the batch's."""
    batch = cooccurrence(lines, column)
    old = model.select("word", F.col("count").alias("old"))
    return batch.join(old, "word", "left").select("word", (F.col("count") + F.coalesce("old", F.lit(0))).cast("int").alias("count"))


def lookup(model: DataFrame, word: str) -> DataFrame:
    """The row of one word; NotFoundError without one."""
    found = model.where(F.col("word") == word)
    if found.isEmpty():
        raise NotFoundError(word)
    return found
