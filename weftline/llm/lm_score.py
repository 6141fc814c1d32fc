"""Scoring texts with a small causal self-attention model and a unigram base.

All training documents (CRC-32 of the id as text, mod 5, not 1) are counted: word counts
for the base, subword counts for the model. Subwords come from a public byte-level BPE
vocabulary, each word encoded with a leading space and an end mark after the last.

The model knows the ``N_IDS - 2`` most frequent subwords, the end mark, and one id for all
others, whose share is dealt by their corpus counts. It is one causal attention block
with a relative position bias, a ReLU layer and a two-level softmax (32 classes of 32
ids, binned by frequency), its biases set from the corpus counts.

It is trained in numpy on every block of every training document. The first pass writes the documents' subwords, and
stretches of them are dealt to tasks of some ``TASK_BLOCKS`` blocks. In each of ``ROUNDS`` rounds every task takes the common weights through its
part of a third of the stretches with Adam, batch by batch as they stream by, and the weights are averaged by blocks, first in ``TREE`` groups.
Small corpora repeat their blocks until a task has made ``steps`` steps or ``PASSES`` passes in a round. A caller may ask for one block in ``share`` only.

A text is cut into blocks of ``BLOCK`` targets. The window of a block is the block and the one before
it, so windows overlap by half, each subword is scored once, and each sees ``BLOCK`` subwords
before it or more. Blocks of many documents go through one batched masked attention. ``score`` is the sum of the log10 probabilities
of a text's subwords and its end mark.

Both passes cut a text into words once and encode each word once in a task (``Words``).

Base: frequent words (``HEAD_WORDS`` at most) are looked up in the task, all others joined
with the counts by a 64-bit hash of the word.

Words are runs of anything but space and ASCII controls 9 to 13, with A-Z in lower case.
Defined cases: null, empty and blank texts consist of the end mark; a null id counts as
the empty text's checksum (0: training); repeated rows are scored one by one; without training
documents the counts are 0 and the model is untrained; an empty table gives an empty
result. Texts of any length are read whole. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.base import drop, keep, read

BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END, N_BPE = 50_256, 50_257
SIDE = 32
N_IDS = SIDE * SIDE
NONE = 0xFFFF
OTHER = N_IDS - 1
BLOCK, DIM, HIDDEN = 8, 16, 32
#: Blocks of a text that the model learns from: one in SHARE, all of them. STRETCH: blocks in a row of the table it reads.
SHARE, STRETCH, TASK_BLOCKS, ROUNDS, TREE, PASSES = 1, 1024, 400_000, 3, 8, 25
STEPS, BATCH, RATE = 300, 512, 1e-2
HEAD_WORDS, CACHED = 100_000, 400_000
END_WORD = 1  # its place among the word hashes
ROWS = 1024  # blocks in one pass
GROUP = 40_000  # words of texts that are taken together
READ = 256  # stretches that are mixed


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def encoder(path: str = BPE):
    """Cuts a text of words, each behind a space, into their subwords."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("words", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})


class Words(dict):
    """Word to its place in the arrays ``hash``, ``start`` and ``size``, the last two of its subwords in ``subs``. Each word is encoded once. Forgets all when full."""

    def __init__(self, encode) -> None:
        self.encode, self.new = encode, []
        self.opens = np.zeros(N_BPE, bool)  # the first subword of a word has the space
        self.opens[[i for i in range(encode.n_vocab) if encode.decode_single_token_bytes(i)[:1] == b" "]] = True
        self.clear()

    def __missing__(self, w: bytes) -> int:
        self[w] = i = len(self)
        self.new.append(w)
        return i

    def clear(self) -> None:
        super().clear()
        self.hash, self.start, self.size, self.subs, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint16), 0

    def places(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The words' places and the texts' numbers of words."""
        sizes = np.array(list(map(len, texts)), np.int64)
        places = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        if self.new:
            raw = self.encode.encode_to_numpy((b" " + b" ".join(self.new)).decode("utf-8", "surrogatepass"))
            first = np.flatnonzero(self.opens[raw])
            self.add(np.fromiter(map(hash_of, self.new), np.int64, len(self.new)), first + self.used, np.diff(np.r_[first, len(raw)]), raw)
            self.new = []
        return places, sizes

    def add(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, raw: np.ndarray) -> None:
        old, n = len(self) - len(hashes), len(self)
        if n > len(self.hash):
            self.hash, self.start, self.size = (np.resize(x, 2 * n) for x in (self.hash, self.start, self.size))
        self.hash[old:n], self.start[old:n], self.size[old:n] = hashes, start, size
        if self.used + len(raw) > len(self.subs):
            self.subs = np.resize(self.subs, 2 * (self.used + len(raw)))
        self.subs[self.used : self.used + len(raw)] = raw
        self.used += len(raw)

    def subwords(self, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' subwords on end, and how many each has."""
        n = self.size[places]
        raw = self.subs[np.repeat(self.start[places] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return raw, by_text(n, sizes).astype(np.int64)


def groups_of(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of a column's texts, one long text or many short ones at a time, and the first one's place."""
    texts, first, size = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        texts.append(words_of(t))
        size += len(texts[-1])
        if size > GROUP or i == len(column) - 1:
            yield first, texts
            texts, first, size = [], i + 1, 0


def stretches(raw: np.ndarray, sizes: np.ndarray, share: int) -> list[bytes]:
    """The texts' blocks as ``windows_of`` reads them, up to ``STRETCH`` in a row: an empty block, then end mark, subwords and end mark. If not all are asked for, single
    blocks, one at least of a text."""
    blocks = sizes // BLOCK + 1
    room = (blocks + 1) * BLOCK + 1
    start = np.cumsum(room) - room
    fed = np.full(room.sum(), NONE, np.uint16)
    fed[start + BLOCK] = END
    fed[np.repeat(start + BLOCK + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(raw))] = raw
    fed[start + BLOCK + 1 + sizes] = END
    most, step = (STRETCH, STRETCH) if share == 1 else (1, share)
    first = lambda i, n: 0 if share == 1 else i % min(share, n)
    return [fed[a + k * BLOCK : a + (min(n, k + most) + 1) * BLOCK + 1].tobytes() for i, (a, n) in enumerate(zip(start.tolist(), blocks.tolist(), strict=True)) for k in range(first(i, n), n, step)]


def windows_of(stretch: bytes) -> np.ndarray:
    """Each block's window of 2 BLOCK inputs, then its BLOCK targets; -1 for none. What is fed behind the last target is seen by no query that has one."""
    fed = np.frombuffer(stretch, np.uint16).astype(np.int32)
    fed[fed == NONE] = -1
    rows = np.lib.stride_tricks.sliding_window_view(fed, 2 * BLOCK + 1)[::BLOCK]
    return np.concatenate([rows[:, :-1], rows[:, BLOCK + 1 :]], 1)


def _count(path: str, share: int) -> Callable:
    """One pass over the training texts: words by hash (kind 0), subwords (1) and the texts' stretches of subwords to learn from (2, the key numbers them)."""

    def table(kind: int, keys: np.ndarray, n: np.ndarray, blocks: list[bytes] | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(blocks or [None] * len(keys), pa.binary())], ["kind", "key", "n", "block"])

    def counted(words: Words, n: np.ndarray, texts: int) -> Iterator[pa.RecordBatch]:
        n = n[: len(words)]
        yield table(0, np.r_[words.hash[: len(words)], END_WORD], np.r_[n, texts])
        subs = np.bincount(words.subs[: words.used], np.repeat(n, words.size[: len(words)]).astype(np.float64), N_BPE)
        subs[END] += texts
        yield table(1, np.flatnonzero(subs), subs[subs > 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, no, n, texts = Words(encoder(path)), TaskContext.get().partitionId() << 40, np.zeros(CACHED, np.int64), 0
        for b in batches:
            for _, own in groups_of(b.column(0)):
                places, sizes = words.places(own)
                if len(words) > len(n):
                    n = np.r_[n, np.zeros(len(words), np.int64)]
                n[: len(words)] += np.bincount(places, minlength=len(words))
                texts += len(own)
                blocks = stretches(*words.subwords(places, sizes), share)
                yield table(2, no + np.arange(len(blocks)), np.zeros(len(blocks)), blocks)
                no += len(blocks)
                if len(words) > CACHED:
                    yield from counted(words, n, texts)
                    words.clear()
                    n[:], texts = 0, 0
        if texts:
            yield from counted(words, n, texts)

    return run


class Ids:
    """Subword to model id, and the log10 share of those that have none of their own."""

    def __init__(self, counts: dict[int, int]) -> None:
        top = sorted((s for s in counts if s != END), key=lambda s: (-counts[s], s))[: N_IDS - 2]
        own = sorted([END, *top], key=lambda s: (-counts.get(s, 0), s))
        self.end = own.index(END)
        rest = {s: n for s, n in counts.items() if s not in set(own)}
        self.total = sum(rest.values()) + 0.5 * (N_BPE - len(own))
        self.n = np.zeros(N_IDS)
        self.n[: len(own)] = [counts.get(s, 0) for s in own]
        self.n[OTHER] = sum(rest.values())

        self.table = np.full(N_BPE, OTHER, np.int16)
        self.table[own] = np.arange(len(own))
        self.more = np.zeros(N_BPE)
        other = self.table == OTHER
        self.more[other] = np.log10((np.array([rest.get(int(i), 0) for i in np.flatnonzero(other)]) + 0.5) / self.total)

    def of(self, raw: np.ndarray) -> np.ndarray:
        """Model ids of subwords; -1 stays."""
        return np.where(raw < 0, np.int16(-1), self.table[np.maximum(raw, 0)])


def fresh(counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    r, d, n = np.random.default_rng(seed), DIM, (counts + 0.5).reshape(SIDE, SIDE)
    rand = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    return {
        "E": (r.standard_normal((N_IDS, d)) * 0.5).astype(np.float32), "R": np.zeros((BLOCK, 2 * BLOCK), np.float32),
        "Wq": rand(d, d), "Wk": rand(d, d), "Wv": rand(d, d), "Wo": rand(d, d) * 0.5,
        "W1": rand(d, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "W2": rand(HIDDEN, d) * 0.5,
        "U": rand(d, SIDE) * 0.1, "bu": np.log(n.sum(1)).astype(np.float32), "W": rand(SIDE, d, SIDE) * 0.1, "bl": np.log(n).astype(np.float32),
    }


#: Query j of a block stands at BLOCK + j in its window and sees nothing after itself.
FUTURE = np.where(np.arange(2 * BLOCK)[None, :] > BLOCK + np.arange(BLOCK)[:, None], np.float32(-1e9), np.float32(0))


#: Exponentials of logits up to this hold in single precision; larger ones are taken from their row's maximum.
SAFE = np.float32(60)


def exps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, in place and each row up to a factor, and the logarithms of the rows' sums."""
    shift = None
    if z.size and z.max() > SAFE:
        shift = z.max(-1)
        z -= shift[..., None]
    np.exp(z, out=z)
    total = np.log(z @ np.ones(z.shape[-1], z.dtype))
    return z, total if shift is None else total + shift


def softmax(z: np.ndarray) -> np.ndarray:
    if z.size and z.max() > SAFE:
        z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[-1], z.dtype))[..., None]
    return z


def log_probs(p: dict, g: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each target, in two levels; the rows go class by class."""
    order = np.argsort((y // SIDE).astype(np.int16), kind="stable")
    g, y = g.take(order, 0), y[order]
    of = y // SIDE
    z = g @ p["U"]
    z += p["bu"]
    line = np.arange(len(y)) * SIDE
    found = z.ravel().take(line + of)
    found -= exps(z)[1]
    cuts = np.searchsorted(of, np.arange(SIDE + 1))
    z = np.empty((len(y), SIDE), g.dtype)
    for c in range(SIDE):
        rows = slice(cuts[c], cuts[c + 1])
        np.matmul(g[rows], p["W"][c], out=z[rows])
        z[rows] += p["bl"][c]
    found += z.ravel().take(line + y % SIDE)
    found -= exps(z)[1]
    out = np.empty_like(found)
    out[order] = found
    return out


def summed(rows: np.ndarray) -> np.ndarray:
    """The rows' sum, as a product: that is faster."""
    return np.ones(len(rows), rows.dtype) @ rows


def by_id(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of each id."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    head = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    out = np.zeros((N_IDS, rows.shape[1]), rows.dtype)
    out[ids[head]] = np.add.reduceat(rows.take(order, 0), head, 0)
    return out


def gradients(p: dict, windows: np.ndarray, targets: np.ndarray, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss (0 if it is not asked for) and its gradients. windows: ids (b, 2 BLOCK), -1 for none; targets: ids (b, BLOCK), -1 for none.

    Queries, keys and values are looked up per id; what stands behind the attention is done for the real targets only, in the order of their classes.
    """
    e = p["E"]
    number = e.dtype.type
    held, scale = windows >= 0, number(1 / np.sqrt(DIM))
    w = np.where(held, windows, 0).astype(np.int16)
    new = np.ascontiguousarray(w[:, BLOCK:])
    k, v, q = (e @ p["Wk"]).take(w, 0), (e @ p["Wv"]).take(w, 0), (e @ p["Wq"] * scale).take(new, 0)
    a = q @ k.transpose(0, 2, 1)
    a += (p["R"] + FUTURE).astype(e.dtype)
    if not held.all():
        a += np.where(held, number(0), number(-1e9))[:, None, :]
    a = softmax(a)
    av = (a @ v).reshape(-1, DIM)
    y = targets.ravel()
    at = np.flatnonzero(y >= 0)
    at = at[np.argsort((y[at] // SIDE).astype(np.int16), kind="stable")]
    y = y[at].astype(np.int64)
    n, of, line, cuts = max(1, len(y)), y // SIDE, np.arange(len(y)) * SIDE, np.searchsorted(y // SIDE, np.arange(SIDE + 1))
    own = av.take(at, 0)
    h = e.take(new.ravel().take(at), 0) + own @ p["Wo"]
    m = h @ p["W1"]
    m += p["b1"]
    np.maximum(m, 0, out=m)
    g = h + m @ p["W2"]
    loss = -float(log_probs(p, g, y).sum()) / n if with_loss else 0.0
    d: dict[str, np.ndarray] = {"W": np.zeros_like(p["W"]), "bl": np.zeros_like(p["bl"])}
    z = softmax(g @ p["U"] + p["bu"])
    z.ravel()[line + of] -= 1
    z *= number(1 / n)
    d["U"], d["bu"], dg = g.T @ z, summed(z), z @ p["U"].T
    classes = [(c, slice(cuts[c], cuts[c + 1])) for c in range(SIDE) if cuts[c] < cuts[c + 1]]
    for c, rows in classes:
        np.matmul(g[rows], p["W"][c], out=z[rows])
        z[rows] += p["bl"][c]
    z = softmax(z)
    z.ravel()[line + y % SIDE] -= 1
    z *= number(1 / n)
    for c, rows in classes:
        d["W"][c], d["bl"][c] = g[rows].T @ z[rows], summed(z[rows])
        dg[rows] += z[rows] @ p["W"][c].T
    dm = dg @ p["W2"].T
    dm *= m > 0
    d["W2"], d["W1"], d["b1"] = m.T @ dg, h.T @ dm, summed(dm)
    dh = dg + dm @ p["W1"].T
    d["Wo"] = own.T @ dh
    dav, dx = np.zeros_like(av), np.zeros_like(av)
    dav[at], dx[at] = dh @ p["Wo"].T, dh
    ds = dav.reshape(-1, BLOCK, DIM) @ v.transpose(0, 2, 1)
    ds -= (dav * av).sum(1).reshape(-1, BLOCK, 1)
    ds *= a
    d["R"] = ds.sum(0)
    dk, dv, dq = ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dav.reshape(-1, BLOCK, DIM), ds @ k
    seen = by_id(w.ravel(), np.concatenate([dk, dv], 2).reshape(-1, 2 * DIM))
    asked = by_id(new.ravel(), np.concatenate([dq.reshape(-1, DIM), dx], 1))
    dk, dv, dq = seen[:, :DIM], seen[:, DIM:], asked[:, :DIM] * scale
    d["Wk"], d["Wv"], d["Wq"] = e.T @ dk, e.T @ dv, e.T @ dq
    d["E"] = asked[:, DIM:] + dk @ p["Wk"].T + dv @ p["Wv"].T + dq @ p["Wq"].T
    return loss, d


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float, total: int) -> None:
        self.p, self.rate, self.total, self.step = p, rate, max(1, total), 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def take(self, rows: np.ndarray) -> None:
        """One step on windows of 3 BLOCK numbers each: the window's inputs, then its targets."""
        _, d = gradients(self.p, rows[:, : 2 * BLOCK], rows[:, 2 * BLOCK :], False)
        self.step += 1
        rate = self.rate * min(1, self.step / 30) * max(0.1, 1 - self.step / (self.total + 1)) ** 0.5
        for k, v in d.items():
            self.first[k] += 0.1 * (v - self.first[k])
            self.second[k] += 0.01 * (v * v - self.second[k])
            self.p[k] -= (rate * self.first[k] / (1 - 0.9**self.step) / (np.sqrt(self.second[k] / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)


def train(p: dict[str, np.ndarray], batches: Iterator[np.ndarray], steps: int, rate: float, total: int, passes: int | None = None, seed: int = 7) -> tuple[dict[str, np.ndarray], int]:
    """The weights after the batches of windows have passed, and the number of windows. A bounded part of the windows is kept and repeated up to ``steps`` steps, or up to
    ``passes`` passes if that is less."""
    opt, r, rest, n = Adam(p, rate, max(total, steps)), np.random.default_rng(seed), np.empty((0, 3 * BLOCK), np.int16), 0
    first: list[np.ndarray] = []
    for rows in batches:
        n += len(rows)
        rest = np.concatenate([rest, rows[r.permutation(len(rows))]])
        for lo in range(0, len(rest) - BATCH + 1, BATCH):
            opt.take(rest[lo : lo + BATCH])
            if len(first) < steps:
                first.append(rest[lo : lo + BATCH].copy())
        rest = rest[len(rest) // BATCH * BATCH :]
    if len(rest):
        opt.take(rest)
    seen = np.concatenate([*first, rest])
    while len(seen) and opt.step < (steps if passes is None else min(steps, passes * n / BATCH)):
        opt.take(seen[r.integers(0, len(seen), BATCH)])
    return p, n


NAMES = ("E", "R", "Wq", "Wk", "Wv", "Wo", "W1", "b1", "W2", "U", "bu", "W", "bl")


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES]).astype(np.float64)


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([like[k].size for k in NAMES])[:-1]
    return {k: x.reshape(like[k].shape).astype(np.float32) for k, x in zip(NAMES, np.split(flat, cuts), strict=True)}


def _trained(p: dict[str, np.ndarray], ids: Ids, steps: int, rate: float, total: int) -> Callable:
    """The task's weights, times its number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(lo, READ) for b in batches for lo in range(0, b.num_rows, READ))
        windows = (ids.of(np.concatenate([windows_of(x) for x in b.column(0).to_pylist()])) for b in parts)
        own, n = train({k: v.copy() for k, v in p.items()}, windows, steps, rate, total, PASSES)
        if n:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part % TREE], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([(packed(own) * n).tobytes()], pa.binary())], ["grp", "part", "n", "w"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    total = np.sum([np.frombuffer(x.as_buffer(), np.float64) for x in table.column("w")], 0)
    return pa.table({"grp": pa.array([table.column("grp")[0].as_py()], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "w": pa.array([total.tobytes()], pa.binary())})


def averaged(blocks: DataFrame, ids: Ids, steps: int) -> dict[str, np.ndarray]:
    """Rounds of local training and weighted averages over the kept table ``key, block`` of stretches. They are dealt by number, so that equal ones spread."""
    p = fresh(ids.n)
    rows, n = blocks.agg(F.count("*"), F.sum(F.expr(f"(length(block) - 2) DIV {2 * BLOCK} - 1"))).first()
    if not rows:
        return p
    tasks = max(1, min(-(-n // (ROUNDS * TASK_BLOCKS)), 2048))
    steps = steps if n < ROUNDS * steps * BATCH else 0  # a corpus that fills the steps is not repeated, in however many parts
    for k in range(ROUNDS):
        mine = blocks.where(F.pmod(F.xxhash64("key"), F.lit(ROUNDS)) == k) if n >= ROUNDS * BATCH else blocks
        mine = mine.repartition(tasks, F.xxhash64("key", F.lit(k))).sortWithinPartitions(F.xxhash64("key"), "key").select("block")
        local = mine.mapInArrow(_trained(p, ids, steps, RATE / 2**k, n // (ROUNDS * tasks * BATCH)), "grp int, part int, n long, w binary")
        got = local.groupBy("grp").applyInArrow(_summed, "grp int, n long, w binary").collect()  # at most TREE rows
        if got:  # a few long texts may leave a round without any
            got.sort(key=lambda r: r["grp"])
            p = unpacked(np.sum([np.frombuffer(r["w"], np.float64) for r in got], 0) / sum(r["n"] for r in got), p)
    return p


def layout(ids: np.ndarray, sizes: np.ndarray, end: int, kind: type = np.int16) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of texts in rows of BLOCK, each text after one empty row; -1 for none. ``ids`` has the texts' subwords on end, ``sizes`` their numbers."""
    n = sizes + 1
    room = (-(-n // BLOCK) + 1) * BLOCK
    start = np.cumsum(room) - room + BLOCK
    x, y = np.full(room.sum(), -1, kind), np.full(room.sum(), -1, kind)
    at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))
    x[start], x[at + 1] = end, ids
    y[start + sizes], y[at] = end, ids
    return x.reshape(-1, BLOCK), y.reshape(-1, BLOCK)


def score_rows(p: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each target, in order; row 0 and the empty rows only give context.

    The same attention as in ``gradients``, with queries, keys and values looked up per id and the two halves of a window multiplied apart.
    """
    keys, values, queries, bias = p["E"] @ p["Wk"], p["E"] @ p["Wv"], (p["E"] @ p["Wq"]) / np.sqrt(DIM).astype(p["E"].dtype), p["R"] + FUTURE
    out = []
    for lo in range(1, len(x), ROWS):
        hi = min(len(x), lo + ROWS)
        ids = x[lo - 1 : hi]
        k, v, q = (table.take(i, 0, mode="clip") for table, i in ((keys, ids), (values, ids), (queries, ids[1:])))
        s = np.empty((len(q), BLOCK, 2 * BLOCK), q.dtype)
        np.matmul(q, k[:-1].transpose(0, 2, 1), out=s[:, :, :BLOCK])
        np.matmul(q, k[1:].transpose(0, 2, 1), out=s[:, :, BLOCK:])
        s += bias
        held = ids >= 0
        if not held.all():
            s += np.where(np.concatenate([held[:-1], held[1:]], 1), np.float32(0), np.float32(-1e9))[:, None, :]
        if s.max() > SAFE:
            s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        total = s.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, s.dtype)
        av = np.matmul(s[:, :, :BLOCK], v[:-1])
        av += np.matmul(s[:, :, BLOCK:], v[1:])
        t = y[lo:hi].astype(np.int64).ravel()
        real = np.flatnonzero(t >= 0)
        av = av.reshape(-1, DIM)[real]
        av /= total[real][:, None]
        h = av @ p["Wo"]
        h += p["E"].take(ids[1:].ravel()[real], 0, mode="clip")
        m = h @ p["W1"]
        m += p["b1"]
        np.maximum(m, 0, out=m)
        h += m @ p["W2"]
        out.append(log_probs(p, h, t[real]))
    return np.concatenate(out)


class Known(Words):
    """Words with their base term (nan for one that is looked up by the join), their subwords as model ids, and the log10 shares of those that have none of their own."""

    def __init__(self, encode, ids: Ids, keys: np.ndarray, terms: np.ndarray) -> None:
        self.ids, self.keys, self.terms = ids, keys, terms
        super().__init__(encode)

    def clear(self) -> None:
        super().clear()
        self.term, self.more, self.subs = np.empty(0), np.empty(0), np.empty(0, np.int16)

    def add(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, raw: np.ndarray) -> None:
        super().add(hashes, start, size, self.ids.table.take(raw))
        old, n = len(self) - len(hashes), len(self)
        if n > len(self.term):
            self.term, self.more = np.resize(self.term, 2 * n), np.resize(self.more, 2 * n)
        at = np.searchsorted(self.keys, hashes).clip(max=max(0, len(self.keys) - 1))
        self.term[old:n] = np.where(self.keys[at] == hashes, self.terms[at], np.nan) if len(self.keys) else np.nan
        self.more[old:n] = by_text(self.ids.more.take(raw), size)

    def trim(self) -> None:
        if len(self) > CACHED:
            self.clear()


def by_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the stretches of the given sizes."""
    out, full = np.zeros(len(sizes)), sizes > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full], dtype=np.float64)
    return out


def text_scores(p: dict, known: Known, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    own, n = known.subwords(places, sizes)
    x, y = layout(own, n, known.ids.end)
    return by_text(score_rows(p, x, y), n + 1) / np.log(10) + by_text(known.more[places], sizes)


def _score(path: str, ids: Ids, p: dict, head: dict[int, int], n: int, v: int) -> Callable:
    below = n + 0.5 * (v + 1)
    term = lambda c: float(np.log10((c + 0.5) / below))
    names = ["doc_id", "held_out", "place", "n_tokens", "had", "base", "rare", "often", "score"]

    end, keys = head.get(END_WORD, 0), np.array(sorted(head), np.int64)
    terms = np.log10((np.array([head[k] for k in keys.tolist()], np.float64) + 0.5) / below)

    def part(known: Known, b: pa.RecordBatch, texts: list[list[bytes]], count: int) -> pa.RecordBatch:
        places, sizes = known.places(texts)
        terms = known.term[places]
        rare = np.isnan(terms)
        base = term(end) + by_text(np.where(rare, 0.0, terms), sizes)
        had = int(end > 0) + by_text(~rare, sizes).astype(np.int64)
        # each text's rare words, once, with their number
        pair = np.stack([np.repeat(np.arange(len(texts)), sizes)[rare], known.hash[places[rare]]])
        by = np.lexsort(pair[::-1])
        pair = pair[:, by]
        head_of = np.flatnonzero(np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(0)]) if pair.shape[1] else np.empty(0, np.int64)
        often = np.diff(np.r_[head_of, pair.shape[1]])
        cuts = pa.array(np.searchsorted(pair[0, head_of], np.arange(len(texts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int64))) for x in (pair[1, head_of], often)]
        columns = [pa.array(count + np.arange(len(texts))), pa.array(sizes + 1), pa.array(had), pa.array(base), *lists, pa.array(text_scores(p, known, places, sizes))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = Known(encoder(path), ids, keys, terms), TaskContext.get().partitionId() << 40
        for b in batches:
            for first, texts in groups_of(b.column(2)):
                known.trim()
                yield part(known, b.slice(first, len(texts)), texts, count)
                count += len(texts)

    return run


def learned(rows: DataFrame, bpe: str, steps: int, share: int) -> tuple[DataFrame, int, int, Ids, dict[int, int], dict[str, np.ndarray]]:
    """From the training rows: the word counts, their sum and number, the model's ids, the frequent words, and the weights."""
    seen = keep(rows.select("body").mapInArrow(_count(bpe, share), "kind byte, key long, n long, block binary"), "lm-pass", "snappy")
    counts = keep(seen.where("kind < 2").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.where("kind = 0").select("key", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ids = Ids({r["key"]: r["n"] for r in counts.where("kind = 1").collect()})  # at most the BPE vocabulary
    head = {r["key"]: r["n"] for r in words.orderBy(F.desc("n"), "key").limit(HEAD_WORDS).collect()} | {r["key"]: r["n"] for r in words.where(F.col("key") == END_WORD).collect()}
    model = averaged(seen.where("kind = 2").select("key", "block"), ids, steps)
    drop(seen)
    return words, n, v, ids, head, model


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bpe: str = BPE, steps: int = STEPS, share: int = SHARE) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("body"))
    rows = rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))
    words, n, v, ids, head, model = learned(rows.where("NOT held_out"), bpe, steps, share)

    out = "doc_id long, held_out boolean, place long, n_tokens long, had long, base double, rare array<long>, often array<long>, score double"
    scored = keep(rows.select("doc_id", "held_out", "body").mapInArrow(_score(bpe, ids, model, head, n, v), out), "lm-scored")
    rare = scored.select("place", F.explode(F.arrays_zip("rare", "often")).alias("r")).select("place", F.col("r.rare").alias("key"), F.col("r.often").alias("m"))
    c = F.coalesce("n", F.lit(0))
    term = F.col("m") * F.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    sums = rare.join(words, "key", "left").groupBy("place").agg(F.sum(term).alias("more"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("seen"))
    done = scored.drop("rare", "often").join(sums, "place", "left")
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("had") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(read(spark, sf_dir, "documents"))
