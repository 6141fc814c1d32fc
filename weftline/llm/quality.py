"""Quality classifier trained from weak labels.

Nine heuristic labellers vote good, bad or nothing on each document. The vote patterns of
all documents are counted (at most 3^9 of them) and expectation-maximisation estimates
each labeller's accuracy and the share of good documents from the counts. The posterior
of a document's pattern is its soft label. On a bounded sample of documents
(``sample_rows``, those with the least hash of id and text) a logistic regression on
hashed word-shape features learns these labels, and its score decides on every document.

Labellers (share of words unless said otherwise):

* ``marks``: carry one of ``#$%&*|<>{}^~=``,
* ``tails``: end with a mark that ends no clause,
* ``shout``: more capitals than small letters, in words of two letters or more,
* ``bang``: end with two exclamation marks,
* ``top``: are the most frequent word,
* ``echo``: equal the word before them,
* ``letters``: share of characters that are letters,
* ``variety``: distinct words to all words,
* ``flow``: words to each sentence-ending mark.

Defined cases: null, empty and blank texts are rejected with score 0; repeated rows are judged
one by one; an empty table gives an empty result; if there are no documents to learn from
the prior decides. Texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.base import drop, keep, read

LABELLERS = ("marks", "shout", "bang", "top", "echo", "variety", "letters", "flow", "tails")
#: Bad from, good up to (shares that speak against a text).
AGAINST = {"marks": (0.30, 0.05), "tails": (0.30, 0.05), "shout": (0.50, 0.15), "bang": (0.20, 0.02), "top": (0.25, 0.15), "echo": (0.20, 0.03)}
BAD, GOOD, NONE = 0, 1, 2
SAMPLE_ROWS, DIMS, THRESHOLD = 4000, 2048, 0.5
STEPS, RATE, DECAY = 600, 2.0, 1e-5
WORDS_KEPT = 400_000
MARKS = re.compile(r"[#$%&*|<>{}^~=]")
CLAUSE = ".,;:!?)]}\"'»”’…-"
EDGES = re.compile(r"^([\W\d_]{0,3}).*?([\W\d_]{0,3})$", re.DOTALL)


class Words(dict):
    """Word to one number: feature bucket, letters (21 bits on) and the flags marks, shout, bang, stop, tails (16 to 20); forgets all when full."""

    def __missing__(self, w: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        body = w if w[-1].isalpha() else w[:-1]
        if body.isalpha() and (body.islower() or body.istitle()):
            pre, case, post, letters, flags = "", "a" if body.islower() else "Aa", w[len(body) :], len(body), bool(MARKS.search(w[len(body) :]))
        else:
            up, low, letters = sum(map(str.isupper, w)), sum(map(str.islower, w)), sum(map(str.isalpha, w))
            pre, post = EDGES.match(w).groups()
            shout = up > low and up > 1
            case = "A" if shout else "Aa" if w[:1].isupper() else "a" if not up else "aA"
            flags = bool(MARKS.search(w)) + 2 * shout + 4 * w.endswith("!!")
        bucket = xxhash.xxh3_64_intdigest(f"{pre}|{case}|{min(len(w), 16) // 2}|{post}") % (DIMS - 64)
        tail = not w[-1].isalnum() and w[-1] not in CLAUSE
        self[w] = out = bucket | (flags + 8 * (w[-1] in ".!?") + 16 * tail) << 16 | letters << 21
        return out


def measure(text: str | None, known: Words) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """The labellers' shares, and the hashed features with their weights."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return {}, np.empty(0, np.int64), np.empty(0)
    rows = np.fromiter(map(known.__getitem__, words), np.int64, n)
    seen = Counter(words)
    share = lambda bit: float((rows >> bit & 1).mean())
    of = {
        "marks": share(16),
        "shout": share(17),
        "bang": share(18),
        "tails": share(20),
        "top": max(seen.values()) / n if n >= 20 else np.nan,
        "echo": sum(map(eq, words[1:], words)) / n if n >= 5 else np.nan,
        "letters": float((rows >> 21).sum()) / sum(map(len, words)),
        "variety": len(seen) / n if n >= 20 else np.nan,
        "flow": n / max(1, int((rows >> 19 & 1).sum())),
    }
    weight = np.bincount(rows & 0xFFFF)
    at = np.flatnonzero(weight)
    weight = weight[at] / np.sqrt(float((weight**2).sum()))
    extra = [DIMS - 64 + int(min(7, (0 if np.isnan(of[k]) else of[k]) * 8)) + 8 * i for i, k in enumerate(AGAINST)]
    extra += [DIMS - 24 + min(7, int(np.log2(n) / 2)), DIMS - 16 + min(7, int(np.log2(of["flow"]))), DIMS - 8 + int(min(7, of["letters"] * 8))]
    return of, np.r_[at, extra].astype(np.int64), np.r_[weight, np.full(len(extra), 0.5)]


def votes(of: dict[str, float]) -> list[int]:
    out = []
    for k in LABELLERS:
        v = of.get(k, np.nan)
        if np.isnan(v):
            out.append(NONE)
        elif k == "letters":
            out.append(BAD if v < 0.5 else GOOD if v > 0.65 else NONE)
        elif k == "variety":
            out.append(BAD if v < 0.12 else GOOD if v > 0.2 else NONE)
        elif k == "flow":
            out.append(GOOD if 2 <= v <= 40 else BAD if v > 120 else NONE)
        else:
            bad, good = AGAINST[k]
            out.append(BAD if v >= bad else GOOD if v <= good else NONE)
    return out


def pattern(v: list[int]) -> str:
    return "".join(map(str, v))


def estimate(counts: dict[str, int], rounds: int = 300) -> tuple[dict[str, float], float, dict[str, float]]:
    """Each labeller's accuracy, the share of good documents, and each pattern's probability of being good.

    Each labeller has its own chance of erring on good and on bad documents; no vote says nothing. The first guess takes a document
    for bad if any labeller says so.
    """
    if not counts:
        return dict.fromkeys(LABELLERS, 0.5), 0.5, {}
    table, n = np.array([[int(c) for c in p] for p in counts]), np.array(list(counts.values()), float)
    p = np.where((table == BAD).any(1), 0.1, 0.9)
    said = table[:, :, None] == np.arange(2)
    for _ in range(rounds):
        share = float(np.clip((p @ n + 1) / (n.sum() + 2), 0.01, 0.99))
        good, bad = ((said * (q * n)[:, None, None]).sum(0) + 0.5 for q in (p, 1 - p))
        good, bad = good / good.sum(1, keepdims=True), bad / bad.sum(1, keepdims=True)
        was, odds = p, np.log(share / (1 - share)) + (said * np.log(good / bad)).sum((1, 2))
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(p - was).max() < 1e-9:
            break
    right = (np.where(table == GOOD, p[:, None], 1 - p[:, None]) * (table != NONE) * n[:, None]).sum(0)
    acc = right / np.maximum(1, ((table != NONE) * n[:, None]).sum(0))
    return dict(zip(LABELLERS, acc.tolist(), strict=True)), share, dict(zip(counts, p.tolist(), strict=True))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], share: float) -> np.ndarray:
    """Weights of the linear scorer, the last one its constant; full-batch gradient steps with momentum."""
    w = np.zeros(DIMS + 1)
    w[-1] = np.log(share / (1 - share))
    if not rows:
        return w
    at = np.concatenate([r[0] for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    x, y = np.concatenate([r[1] for r in rows]), np.array([r[2] for r in rows])
    speed = np.zeros_like(w)
    for _ in range(STEPS):
        z = np.bincount(of, x * w[at], len(rows)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(rows)
        step = np.r_[np.bincount(at, x * g[of], DIMS), g.sum()] + DECAY * np.r_[w[:-1], 0]
        speed = 0.9 * speed - RATE * step
        w += speed
    return w


def score_of(w: np.ndarray, at: np.ndarray, x: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -50, 50))))


def _measured(edge: int) -> Callable:
    """Counts of vote patterns (``order`` null), and the features of the rows whose hash of id and text is below ``edge``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            counts, rows = Counter(), []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                of, at, x = measure(t, known)
                said = pattern(votes(of))
                counts[said] += 1
                order = xxhash.xxh3_64_intdigest(f"{doc}|{t or ''}".encode("utf-8", "surrogatepass")) >> 1
                if order < edge:
                    rows.append((said, 0, order, at.tolist(), x.tolist()))
            rows += [(said, n, None, None, None) for said, n in counts.items()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["votes", "n", "order", "at", "x"])

    return run


def _scores(w: np.ndarray, prior: float, label: dict[str, float], threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            says, label_p, score = [], [], []
            for t in b.column(1).to_pylist():
                of, at, x = measure(t, known)
                says.append(pattern(votes(of)))
                label_p.append(label.get(says[-1], prior))
                score.append(score_of(w, at, x) if len(at) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(says, pa.string()), pa.array(label_p, pa.float64()), pa.array(score, pa.float64()), pa.array([s >= threshold for s in score], pa.bool_())], ["doc_id", "votes", "label_prob", "score", "kept"])

    return run


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("body"))


def learned(rows: DataFrame, sample_rows: int) -> tuple[float, dict[str, float], np.ndarray]:
    """The share of good documents, each vote pattern's probability of being good, and the scorer's weights.

    One pass counts the patterns and takes the sample: of the documents whose hash of id and text is low enough for twice the sample, those with
    the least hash, as features.
    """
    below = min(1.0, 2 * sample_rows / max(1, rows.count()))
    seen = keep(rows.mapInArrow(_measured(int(below * (1 << 63))), "votes string, n long, order long, at array<int>, x array<double>"), "quality-votes")
    counted = seen.groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    _, share, label = estimate({r["votes"]: r["n"] for r in counted})
    sample = seen.where("at IS NOT NULL").orderBy("order", "votes").limit(sample_rows).collect()
    w = fit([(np.array(r["at"], np.int64), np.array(r["x"]), label[r["votes"]]) for r in sample if r["at"]], share)
    drop(seen)
    return share, label, w


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, votes, label_prob, score, kept``."""
    rows = rows_of(docs, id_col, text_col)
    share, label, w = learned(rows, sample_rows)
    return rows.mapInArrow(_scores(w, share, label, threshold), "doc_id long, votes string, label_prob double, score double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


def _kept(at: int, w: np.ndarray, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            keep = []
            for t in b.column(at).to_pylist():
                _, place, x = measure(t, known)
                keep.append(len(place) > 0 and score_of(w, place, x) >= threshold)
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with all their columns.

    Each row is judged by its own text as it passes: rows with null or repeated ids have a decision of their own, equal texts the same one; null, empty
    and blank texts go; nothing is shuffled.
    """
    _, _, w = learned(rows_of(docs, "doc_id", "text"), SAMPLE_ROWS)
    return docs.mapInArrow(_kept(docs.columns.index("text"), w, THRESHOLD), docs.schema)
