"""The language model learns from every block of every training document."""

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import lm_score


def blocks_of(raw):
    """Window and targets of each block of a text's subwords, one by one; -1 for none."""
    n, fed, want = lm_score.BLOCK, [-1] * lm_score.BLOCK + [lm_score.END, *raw], [*raw, lm_score.END]
    pad = lambda x, k: [*x, *[-1] * (k - len(x))]
    return [(pad(fed[i : i + 2 * n], 2 * n), pad(want[i : i + n], n)) for i in range(0, len(want), n)]


def test_every_block_is_learned_from(spark):
    words = "the quick brown fox jumps over lazy dogs near riverbanks"
    docs = [(0, None), (1, "one two"), (2, f"{words} " * 3), (3, "a b c d e f g"), (4, f"{words} " * 2000)]
    made = spark.createDataFrame(docs, "doc_id int, body string").repartition(3)
    got = made.select("body").mapInArrow(lm_score._count(lm_score.BPE, lm_score.SHARE), "kind byte, key long, n long, block binary").collect()
    encode, want, n = lm_score.encoder(), [], lm_score.BLOCK
    for _, t in docs:
        want += blocks_of([s for w in lm_score.words_of(t) for s in encode._encode_single_piece(b" " + w)])
    rows = [r for x in got if x.kind == 2 for r in lm_score.windows_of(x.block).tolist()]
    assert len(rows) == len(want) > 2000
    # what a window holds behind its last target is seen by no query that has a target
    cut = lambda w, t: tuple([*w[: n + sum(x >= 0 for x in t)], *t])
    assert sorted(cut(r[: 2 * n], r[2 * n :]) for r in rows) == sorted(cut(w, t) for w, t in want)
    counts = made.select("body").mapInArrow(lm_score._count(lm_score.BPE, 1), "kind byte, key long, n long, block binary").where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect()
    targets = np.concatenate([t for _, t in want])
    assert {r.key: r.n for r in counts} == dict(zip(*(x.tolist() for x in np.unique(targets[targets >= 0], return_counts=True)), strict=True))


def test_a_task_takes_each_window_once(monkeypatch):
    """Also those that don't fill a batch."""
    taken = []
    monkeypatch.setattr(lm_score.Adam, "take", lambda self, rows: (taken.extend(rows[:, 0].tolist()), setattr(self, "step", self.step + 1)))
    rows = np.repeat(np.arange(1000, dtype=np.int16)[:, None], 3 * lm_score.BLOCK, 1)
    _, n = lm_score.train(lm_score.fresh(np.ones(lm_score.N_IDS)), iter([rows[:300], rows[300:301], rows[301:]]), 1, lm_score.RATE, 1)
    assert n == 1000 and sorted(taken) == list(range(1000))
