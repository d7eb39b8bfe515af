"""Toxicity: a learned lexicon met by fuzzy automata, and context windows that tell quotation from abuse.

Learning, in one task, from a bounded sample of labelled documents: terms (words, or stems of words) are those
that toxic documents have far more often than clean ones.  A hit has a kind:
edited or not, quoted or not.  Each kind's chance of toxicity is counted on the sample, with priors.

Scoring, in Arrow batches over whole texts: the score of a text is the chance that at least one of its hits is
abuse; without hits it is the toxic share of the sample's documents without hits.

Null and empty texts have no hits.  Without any usable label all texts get score 0.  Repeated rows are repeated; texts
of any length are read whole; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.docmap import map_documents
from tessera.llm.fuzzy_lexicon import FuzzyLexicon

_WORD = re.compile(r"[^\W_]+")
STEMS = range(4, 11)  # lengths of stems
_QUOTES = "\"“”„«»‹›‘’'`"
#: Words that report what others say, in the four languages of the corpus.
_REPORTS = re.compile(r"\b(?:said|says|say|called|calls|calling|quote|quoted|wrote|writes|word|term|slur|insult|sagte|nannte|schrieb|zitat|wort|dit|écrit|appelé|mot|citation|dijo|llamó|escribió|palabra|cita)\b")


@dataclass
class ToxicModel:
    lexicon: FuzzyLexicon
    abuse: dict[tuple[int, bool], float]  # (edits, quoted) -> chance
    noisy: frozenset[int]  # terms whose edited forms are common words
    base: float

    def hits(self, text: str) -> list[tuple[int, int, bool]]:
        """(term, edits, quoted) of each hit in ``text``."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        return self.judged(text, self.lexicon.find(points))

    def judged(self, text: str, found: list[tuple[int, int, int]], shift: int = 0) -> list[tuple[int, int, bool]]:
        return [(t, e, quotation_score(text, p - shift, len(self.lexicon.terms[t][0])) >= 0.5) for p, t, e in found if not (e and t in self.noisy)]

    def score(self, hits: list[tuple[int, int, bool]]) -> float:
        clean = 1.0 - self.base
        for _, edits, quoted in hits:
            clean *= 1.0 - self.abuse[edits, quoted]
        return 1.0 - clean


def quotation_score(text: str, at: int, size: int, window: int = 60) -> float:
    """How far the word at ``at`` looks quoted, 0 to 1, from ``window`` characters on either side.

    Quotation marks right around it, or an open one before and one after it on its line, count 0.6; a reporting
    word in the window 0.4.
    """
    before, after = text[max(0, at - window) : at], text[at + size : at + size + window]
    line_before, line_after = before.rpartition("\n")[2], after.partition("\n")[0]
    score = 0.0
    near = line_before[-1:] in _QUOTES and line_before[-1:] != "" and any(q in line_after[:12] for q in _QUOTES)
    opened = sum(line_before.count(q) for q in '"“„«') % 2 == 1 and any(q in line_after for q in '"”“»')
    if near or opened:
        score += 0.6
    if _REPORTS.search(line_before.lower()) or _REPORTS.search(line_after.lower()):
        score += 0.4
    return score


def learn_terms(toxic: list[str], clean: list[str], ratio: float = 100.0, surprise: float = 25.0, share: float = 0.01) -> list[tuple[str, bool]]:
    """Words, and stems (beginnings of 4 to 10 characters), that mark toxic texts: (term, whether it is a stem).

    A form qualifies if toxic documents have it ``ratio`` times as often as clean ones, and so often that chance,
    over the many forms there are, does not explain it: ``surprise`` expected clean documents were it no mark, in at least 3 and ``share`` of the toxic ones.
    Toxic documents count by the different neighbours that a form has in them, so that copies count once.
    Of forms that begin alike the one that marks most documents is taken, words before stems, longer before shorter.
    """
    if not toxic or not clean:
        return []
    scale = len(clean) / len(toxic)
    least = max(3.0, share * len(toxic), surprise / scale)
    # Level by level, as a longer beginning is in no more documents than a shorter one; so few forms are ever counted.
    stems: set[str] = set()
    for n in STEMS:
        level: Counter = Counter()
        for t in toxic:
            level.update({w[:n] for w in _WORD.findall(t.lower()) if len(w) >= n and (n == STEMS[0] or w[: n - 1] in stems)})
        stems.update(f for f, k in level.items() if k >= least)

    def forms(word: str) -> list[tuple[str, bool]]:
        out = [(word[:n], True) for n in STEMS if n <= len(word) and word[:n] in stems]
        whole = 3 <= len(word) <= 24 and (len(word) < STEMS[0] or word[: STEMS[-1]] in stems)
        return [*out, (word, False)] if whole else out

    around: dict[tuple[str, bool], set[int]] = defaultdict(set)
    for t in toxic:
        words = ["", *_WORD.findall(t.lower()), ""]
        for before, word, after in {w: (b, w, a) for b, w, a in zip(words, words[1:], words[2:], strict=False)}.values():
            for f in forms(word):
                around[f].add(zlib.crc32(f"{before} {after}".encode()))
    seen = Counter({f: len(x) for f, x in around.items() if len(x) >= least})
    del around
    rivals: Counter = Counter()
    for t in clean:
        rivals.update({f for w in set(_WORD.findall(t.lower())) for f in forms(w) if f in seen})
    keep = {f for f in seen if seen[f] * scale >= ratio * rivals[f]}
    chosen: list[tuple[str, bool]] = []
    for term, stem in sorted(keep, key=lambda f: (20 * rivals[f] - seen[f], f[1], -len(f[0]), f[0])):
        implied = any(s and term.startswith(t) for t, s in chosen)
        below = sum(seen[t, s] for t, s in chosen if t.startswith(term))
        if not implied and (not stem or seen[term, stem] > 1.5 * below):
            chosen.append((term, stem))
    return chosen


def fit(sample: list[tuple[str, int]]) -> ToxicModel:
    """``sample``: (text, toxic 0 or 1)."""
    toxic, clean = [t for t, y in sample if y], [t for t, y in sample if not y]
    lexicon = FuzzyLexicon(learn_terms(toxic, clean))
    model = ToxicModel(lexicon, {}, frozenset(), 0.0)
    all_hits = [(model.hits(t), y) for t, y in sample]
    edited: tuple[Counter, Counter] = (Counter(), Counter())
    for hits, y in all_hits:
        edited[int(bool(y))].update({t for t, e, _ in hits if e})
    # Edited forms of a term are believed unless clean documents have them, for their number, more than a tenth as often.
    model.noisy = frozenset(t for t, n in edited[0].items() if n >= 2 and n * len(toxic) * 10 > edited[1][t] * len(clean))
    kinds = {(0, False): [9.0, 0.5], (1, False): [4.0, 1.0], (0, True): [2.0, 8.0], (1, True): [1.0, 9.0]}  # prior toxic, clean
    none = [0.5, 10.0]
    for hits, y in all_hits:
        own = {(e, q) for t, e, q in hits if not (e and t in model.noisy)}
        at = none if not own else kinds[min(own, key=lambda k: (k[1], k[0]))]
        at[0 if y else 1] += 1
    model.abuse = {k: a / (a + b) for k, (a, b) in kinds.items()}
    model.base = none[0] / sum(none) if sample else 0.0
    return model


def held_out(id_col: str = "doc_id"):
    """Whether a row's label may not be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def labelled_rows(docs: DataFrame, labels: DataFrame, target: str, most: dict[int, int], longest: int = 1 << 20, most_bytes: int = 1 << 26) -> DataFrame:
    """doc_id, text, y: up to ``most[y]`` labelled texts of each class y, chosen by the hash of their ids; none that are held out.

    Ids with both labels teach nothing, of an id's texts the smallest counts, texts of over ``longest`` bytes don't, and
    the sample, which one task holds, ends with ``most_bytes``.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
    single = usable.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")
    parts = None
    for y, n in most.items():
        part = single.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        parts = part if parts is None else parts.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= longest)
    # At most sum(most) ids: bounded, so they may be broadcast, and their texts counted up in one task.
    chosen = texts.join(F.broadcast(parts), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    return chosen.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("doc_id", "text", "y")


def learned(rows: DataFrame, fit: Callable[[list[tuple[str, int]]], Any]) -> Any:
    """What ``fit`` makes of the (text, y) of ``labelled_rows``, in order of doc_id.

    A task fits and only the model comes to the driver: no texts, and a lost executor's fit is done again elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(fit([row[1:] for row in sample]))], pa.binary())], names=["model"])

    made = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return cloudpickle.loads(bytes(made[0].model)) if made else fit([])


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 1000, most_clean: int = 4000) -> ToxicModel:
    """Learn from at most ``most_toxic`` and ``most_clean`` labelled documents that aren't held out."""
    return learned(labelled_rows(docs, labels, "toxic", {1: most_toxic, 0: most_clean}), fit)


def hits_of(texts: list[str], model: ToxicModel, block: int = 1 << 21) -> Iterator[list[tuple[int, int, bool]]]:
    """The hits of each text; texts are read in groups of about ``block`` characters."""
    k = 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (j == k or size < block):
            size += len(texts[j]) + 1
            j += 1
        group = texts[k:j]
        first = np.cumsum([0] + [len(t) + 1 for t in group])
        found = model.lexicon.find(np.frombuffer("\n".join(group).encode("utf-32-le"), "<u4"))
        own: list[list] = [[] for _ in group]
        for h, d in zip(found, np.searchsorted(first, [h[0] for h in found], "right") - 1, strict=True):
            own[d].append(h)
        yield from (model.judged(t, h, s) if h else [] for t, h, s in zip(group, own, first.tolist(), strict=False))
        k = j


def score_documents(docs: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, n_hits, n_quoted, n_edited, terms (those hit, sorted) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = list(hits_of([t or "" for t in batch.column(1).to_pylist()], model))
            scores = [model.score(h) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array([len(h) for h in hits], pa.int64()),
                    pa.array([sum(q for _, _, q in h) for h in hits], pa.int64()),
                    pa.array([sum(e for _, e, _ in h) for h in hits], pa.int64()),
                    pa.array([sorted({model.lexicon.terms[t][0] for t, _, _ in h}) for h in hits], pa.list_(pa.string())),
                ],
                names=["doc_id", "score", "predicted", "n_hits", "n_quoted", "n_edited", "terms"],
            )

    return map_documents(docs, run, "doc_id long, score double, predicted int, n_hits long, n_quoted long, n_edited long, terms array<string>")


def without_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """The documents that score below ``threshold``, rows and columns unchanged; no shuffle."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(h) for h in hits_of(texts.tolist(), model)], dtype="float64")

    return docs.where(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) < threshold)
