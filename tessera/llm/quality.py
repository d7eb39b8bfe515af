"""Quality rules: exact base statistics, and a calibrated logistic regression on hashed word and character n-grams.

Features of a text are the shares of its hashed character n-grams (2 to 4 code points) and of its hashed words.  The regression is
fitted in one task by full-batch Adam on a bounded sample of labelled rows; Platt scaling on the part of the
sample that fitting left out makes its margins probabilities.  Scoring gathers weights over whole texts in Arrow
batches, and compares with fixed thresholds.

Null and empty texts have no words and fail the base rules.  Without labels of both classes only the base rules
judge.  Repeated rows are repeated; equal texts get equal rows.  Texts of any length are read whole; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.docmap import map_documents, utf8_list
from tessera.llm.toxicity import labelled_rows, learned

BITS = 16
SIZE = 1 << BITS
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"


@dataclass
class QualityModel:
    weights: np.ndarray  # of 2 * SIZE hashed features: n-grams, then words
    bias: float
    slope: float  # of the calibration
    offset: float


def points_of(text: bytes) -> np.ndarray:
    """The code points of UTF-8 text."""
    return np.frombuffer(text, np.uint8).astype(np.uint32) if text.isascii() else np.frombuffer(text.decode().encode("utf-32-le"), "<u4")


def gram_hashes(points: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams of 2, 3 and 4 characters that start at each one (0 is padding at the end)."""
    n = len(points)
    wide = np.concatenate([points, np.zeros(3, np.uint32)]).astype(np.uint32)
    # Odd multipliers, one for each place: the sum's upper bits depend on all characters.
    two = wide[:n] * np.uint32(2654435761) + wide[1 : n + 1] * np.uint32(2246822519)
    three = two + wide[2 : n + 2] * np.uint32(3266489917)
    four = three + wide[3 : n + 3] * np.uint32(668265263)
    return [((g ^ g >> np.uint32(15)) * np.uint32(2654435769 + 2 * k) >> np.uint32(32 - BITS)).astype(np.int32) for k, g in enumerate((two, three, four))]


def word_bucket(word: bytes) -> int:
    return SIZE + (zlib.crc32(word) & (SIZE - 1))


def margins(texts: list[bytes], model: QualityModel, block: int = 1 << 20) -> np.ndarray:
    """Margin of each text: mean weight of its n-grams plus mean weight of its words plus the bias."""
    out = np.full(len(texts), model.bias)
    k = 0
    known: dict[bytes, float] = {}
    words_of = model.weights
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (j == k or size + len(texts[j]) <= block):
            size += len(texts[j])
            j += 1
        group = texts[k:j]
        points = points_of(b"\0\0\0".join(group))  # so much that no n-gram reaches the next text
        lengths = [len(t) if t.isascii() else len(t.decode()) for t in group]
        sums = np.zeros(len(points))
        for g in gram_hashes(points):
            sums += model.weights[g]
        first = np.cumsum([0] + [n + 3 for n in lengths[:-1]])
        total = np.concatenate([[0.0], np.cumsum(sums)])
        for i, t in enumerate(group):
            if t:
                out[k + i] += (total[first[i] + lengths[i]] - total[first[i]]) / (3 * lengths[i])
                words = t.split()
                if words:
                    s = 0.0
                    for w, n in Counter(words).items():
                        v = known.get(w)
                        if v is None:
                            if len(known) > 200_000:
                                known.clear()
                            v = known[w] = float(words_of[word_bucket(w)])
                        s += n * v
                    out[k + i] += s / len(words)
        k = j
    return out


def _features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    points = points_of(text)
    grams, n = np.unique(np.concatenate(gram_hashes(points)), return_counts=True)
    words = text.split()
    buckets, m = np.unique(np.fromiter(map(word_bucket, words), np.int32, len(words)), return_counts=True)
    return np.concatenate([grams, buckets]), np.concatenate([n / (3 * max(1, len(points))), m / max(1, len(words))])


def fit(sample: list[tuple[str, int]], rounds: int = 120, rate: float = 8.0, decay: float = 1e-5) -> QualityModel | None:
    """Every fifth row is left out of fitting and calibrates.  None without rows of both classes."""
    rows = [(_features(t.encode()), y) for t, y in sample if t]
    if len({y for _, y in rows}) < 2:
        return None
    fitted = [r for k, r in enumerate(rows) if k % 5] or rows
    if len({y for _, y in fitted}) < 2:
        fitted = rows
    held = [r for k, r in enumerate(rows) if not k % 5]
    if len({y for _, y in held}) < 2:
        held = rows
    pack = lambda part: (np.concatenate([f for (f, _), _ in part]), np.concatenate([v for (_, v), _ in part]).astype(np.float32), np.array([len(f) for (f, _), _ in part]), np.array([y for _, y in part], np.float64))
    cols, vals, lens, y = pack(fitted)
    owner, begin = np.repeat(np.arange(len(lens)), lens), np.concatenate([[0], np.cumsum(lens)[:-1]])
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both classes weigh alike
    w, b = np.zeros(2 * SIZE), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.add.reduceat(w[cols] * vals, begin) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        gw, gb = np.bincount(cols, g[owner] * vals, 2 * SIZE) + decay * w / SIZE, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / np.sqrt(t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        b -= 0.05 * step * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    cols, vals, lens, y = pack(held)
    z = np.add.reduceat(w[cols] * vals, np.concatenate([[0], np.cumsum(lens)[:-1]])) + b
    slope, offset = platt(z, y)
    return QualityModel(w.astype(np.float32), float(b), slope, offset)


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic calibration, by damped Newton steps on smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(float(np.std(z)), 1e-9)
    x, a, c = z / scale, 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -40, 40)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(d * x).sum(), d.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        da, dc = np.linalg.solve(hess, grad)
        a, c = a - np.clip(da, -1, 1), c - np.clip(dc, -1, 1)
    return float(a / scale), float(c)


def base_statistics(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    white = len(text) - len(text.translate(None, WHITE))
    chars = len(text) - white if text.isascii() else len(text.decode()) - white
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen:
                dup += bool(line.split())
            else:
                seen.add(line)
    repeat = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            times, covered = Counter(windows), 0
            for k, x in enumerate(windows):
                if times[x] > 1:
                    repeat += k + 3 - max(covered, k)
                    covered = k + 3
    return chars, symbols, dup, repeat


def train(docs: DataFrame, labels: DataFrame, most_good: int = 2500, most_bad: int = 2500) -> QualityModel | None:
    """Learn from at most ``most_good`` and ``most_bad`` labelled rows that aren't held out."""
    return learned(labelled_rows(docs, labels, "quality", {1: most_good, 0: most_bad}), fit)


def judge(docs: DataFrame, model: QualityModel | None, threshold: float = 0.5, min_words: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_list(batch.column(1))
            counts, stats = [], []
            for t in texts:
                words = t.split()
                counts.append(len(words))
                stats.append(base_statistics(t, words))
            n, base = np.array(counts, np.int64), np.array(stats, np.int64).reshape(-1, 4)
            failed = (n < min_words) | (100 * base[:, 3] > 50 * n)
            if model is None:
                p = np.where(failed, 0.0, 1.0)
            else:
                p = 1 / (1 + np.exp(-np.clip(model.slope * margins(texts, model) + model.offset, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), *(pa.array(base[:, k]) for k in range(4)), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p, pa.float64())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"],
            )

    return map_documents(docs, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")
