"""Removing long repeated byte strings, across and within documents, by suffix arrays.

A byte goes if a string of ``width`` bytes that covers it also starts earlier (smaller id,
or same document and earlier start). Such strings are found in five steps:

1. Every string of ``width`` bytes has one anchor, the run of ``GRAM`` bytes in it with the least hash,
   the leftmost of equals. Equal strings have equal anchors at equal places, so they
   meet under their anchor's hash. An anchor stands for all strings it is chosen in; together they are
   its context.
2. Under each hash the contexts are sorted by digest (128 bits) and place. Of equal contexts all but
   the first are repeats as a whole. This is done for each batch of documents first, so that a passage that many documents
   hold, or one holds many times, leaves a batch once. Hashes with different contexts are noted in a
   bitmap of fixed size.
3. The contexts of noted hashes are gathered (a second pass over the texts), equal ones
   once, in tasks by hash, ``BLOCK`` bytes at a time. Ends of a context that hold no string whose rolling
   hash is found twice cannot match and are trimmed; contexts that have become equal count once. What is left
   is joined into one text, whose suffix array is built by Lyndon-prefix grouping.
4. In the array, equal strings are neighbours: compared byte by byte, all but the first in
   document order are repeats. A hash with more than ``BLOCK`` bytes of different contexts is cut
   into blocks; each block is sorted together with every other one.
5. The repeats' ranges are merged per document and cut out.

Defined cases: null and empty texts have nothing to remove; rows alike in id and text count
as one and are all returned; rows that share an id (null counts as the smallest) and differ in text are documents of
their own, told apart and ordered by a hash of the text (``sub``); an empty table gives an empty result. Texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.base import keep, read
from weftline.llm.suffix_array import suffix_array

WIDTH, GRAM = 100, 32
#: Bytes of contexts in one suffix array.
BLOCK = 1 << 20
#: A hash with up to so many blocks of contexts is trimmed as a whole.
WHOLE = 16
#: Bits of the map of noted hashes: 4 MB. A full map costs time, not results.
BITS = 25
#: Positions in one window search; longer texts are searched in overlapping parts.
PART = 1 << 20
NO_ID = -(1 << 63)
MUL, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes (a power of two)."""
    h = (b.astype(np.uint64) + np.uint64(1)) * MIX
    mul, m = MUL, 1
    while m < gram:
        h = h[:-m] * np.uint64(mul) + h[m:]
        mul, m = mul * mul % (1 << 64), 2 * m
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def anchors(b: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``hash, anchor, first, last``: each anchor, and the first and last start of the strings it is chosen in."""
    found = []
    for lo in range(0, max(1, len(b) - width + 1), PART - 2 * width):
        part = b[lo : lo + PART - width]
        if len(part) < width:
            break
        h = gram_hashes(part, gram)
        low = np.uint64(PART - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span, m = width - gram + 1, 1
        while 2 * m <= span:
            least = np.minimum(least[:-m], least[m:])
            m *= 2
        if m < span:
            least = np.minimum(least[: len(least) - (span - m)], least[span - m :])
        at = (least & low).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[cut[1:] - 1, len(at) - 1]
        found.append((h[at[cut]].view(np.int64), at[cut] + lo, cut + lo, last + lo))
        if lo + len(part) >= len(b):
            break
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def texts_of(column: pa.Array) -> Iterator[bytes]:
    for t in column:
        yield t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else b""


def batch_of(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "c", "c2", "doc", "sub", "first", "last"])


def combined(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Of equal contexts the first stays; the others' rows say that they are repeats, by a ``last`` below 0, and are dealt anywhere."""
    h, c, c2, doc, sub, first, last = columns
    by = np.lexsort((first, sub, doc, c2, c, h))
    h, c, c2, doc, sub, first, last = (x[by] for x in columns)
    same = np.r_[False, (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (c2[1:] == c2[:-1])]
    row = same & np.r_[False, (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (first[1:] == first[:-1])]  # a row alike in id and text
    h, c, c2, doc, sub, first, last, again = (x[~row] for x in (h, c, c2, doc, sub, first, last, same))
    last[again] = -1 - last[again]
    h[again] = (doc[again] ^ (sub[again] << 1)) * np.int64(0x5851F42D4C957F2D) + first[again]
    return [h, c, c2, doc, sub, first, last]


def _anchors(width: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for doc, sub, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                h, at, first, last = anchors(np.frombuffer(text, np.uint8), width, gram)
                if len(h):
                    view = memoryview(text)
                    digest = b"".join([xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(first.tolist(), (last + width).tolist(), strict=True)])
                    digest = np.frombuffer(digest, np.int64).reshape(-1, 2)
                    c = digest[:, 0] + ((at - first).astype(np.uint64) * MIX).view(np.int64)
                    out.append((h, c, digest[:, 1], np.full(len(h), doc), np.full(len(h), sub), first.astype(np.int32), last.astype(np.int32)))
                    held += len(h)
                if held > 500_000:
                    yield batch_of(combined([np.concatenate(x) for x in zip(*out, strict=True)]))
                    out, held = [], 0
            if out:
                yield batch_of(combined([np.concatenate(x) for x in zip(*out, strict=True)]))

    return run


def _same_context(width: int) -> Callable:
    """Over rows sorted by hash, digest and place: ranges of repeated contexts (h null), and hashes with several contexts (doc null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            columns = [b.column(i).to_numpy() for i in range(7)]
            known = columns[6] < 0
            kdoc, ksub, kfirst, klast = (columns[i][known].astype(np.int64) for i in range(3, 7))
            h, c, c2, doc, sub, first, last = (x[~known] for x in columns)
            if len(h):
                was = [np.r_[x[:1] if before is None else before[i], x[:-1]] for i, x in enumerate((h, c, c2, doc, sub, first))]
                new = np.zeros(len(h), bool)
                new[0] = before is None
                same_h, same_c = (h == was[0]) & ~new, (c == was[1]) & (c2 == was[2])
                row = (doc == was[3]) & (sub == was[4]) & (first == was[5])
                before = (h[-1], c[-1], c2[-1], doc[-1], sub[-1], first[-1])
                again, other = same_h & same_c & ~row, same_h & ~same_c
            else:
                again = other = np.zeros(0, bool)
            n, m = int(again.sum()) + len(kdoc), int(other.sum())
            if n or m:
                none = np.zeros(m, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[np.zeros(n, np.int64), h[other]], mask=np.r_[np.ones(n, bool), np.zeros(m, bool)]),
                        pa.array(np.r_[doc[again], kdoc, none]),
                        pa.array(np.r_[sub[again], ksub, none]),
                        pa.array(np.r_[first[again].astype(np.int64), kfirst, none]),
                        pa.array(np.r_[last[again].astype(np.int64) + width, -1 - klast + width, none]),
                    ],
                    ["h", "doc", "sub", "from", "to"],
                )

    return run


def _contexts(width: int, gram: int, bitmap: np.ndarray, bits: int) -> Callable:
    low = np.int64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            for doc, sub, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                h, at, first, last = anchors(np.frombuffer(text, np.uint8), width, gram)
                k = h & low
                for i in np.flatnonzero(bitmap[k >> 6] >> (k & 63) & 1):
                    context, place = text[first[i] : last[i] + width], (doc, sub, int(first[i]))
                    key = (int(h[i]), context)
                    if key not in out or place < out[key]:  # equal contexts are known to be repeats; the first one stands for them
                        out[key] = place
            if out:
                rows = [(h, *place, context) for (h, context), place in out.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)], ["h", "doc", "sub", "first", "context"])

    return run


def rolling(b: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` numbers, from runs of powers of two."""
    h, mul, m = b.astype(np.uint64) * MIX, MUL, 1
    out, done = None, 0
    while True:
        if width & m:
            out = h if out is None else out[: len(h) - done] * np.uint64(mul) + h[done:]
            done += m
        if 2 * m > width:
            return out
        h = h[:-m] * np.uint64(mul) + h[m:]
        mul, m = mul * mul % (1 << 64), 2 * m


#: A context: id, hash of the text, start, bytes.
Context = tuple[int, int, int, bytes]


def joined(contexts: list[Context], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts as one text (bytes + 2, each followed by 1, the whole by 0); each context's place; where strings of ``width`` bytes start."""
    sizes = np.array([len(x[3]) for x in contexts])
    at = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    text = np.frombuffer(b"\0".join(x[3] for x in contexts), np.uint8).astype(np.int64) + 2
    text = np.r_[text, 1, 0]
    text[at[1:] - 1] = 1
    n = sizes - width + 1
    starts = np.repeat(at - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    return text, at, starts


def trimmed(contexts: list[Context], width: int) -> list[Context]:
    """What may match: from the first to the last string of each context whose hash occurs twice."""
    text, at, starts = joined(contexts, width)
    _, back, times = np.unique(rolling(text, width)[starts], return_inverse=True, return_counts=True)
    starts = starts[times[back] > 1]
    of = np.searchsorted(at, starts, "right") - 1
    head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
    tail = np.r_[head[1:] - 1, len(of) - 1] if len(of) else of
    out = []
    for k, x, y in zip(of[head].tolist(), (starts[head] - at[of[head]]).tolist(), (starts[tail] - at[of[tail]]).tolist(), strict=True):
        doc, sub, start, body = contexts[k]
        out.append((doc, sub, start + x, body[x : y + width]))
    return out


def repeats(contexts: list[Context], width: int) -> list[tuple[int, int, int, int]]:
    """``doc, sub, from, to`` of each string of the contexts that another of them holds at an earlier place."""
    found, firsts = [], {}
    for *place, body in sorted(trimmed(contexts, width)):
        if body in firsts:
            if firsts[body] != place:
                found.append((*place, place[2] + len(body)))
        else:
            firsts[body] = place
    if len(firsts) < 2:
        return found
    text, at, starts = joined([(*place, body) for body, place in firsts.items()], width)
    places = np.array(list(firsts.values()), np.int64)
    whole = np.zeros(len(text), bool)
    whole[starts] = True
    order = np.array(suffix_array(text.tolist()))
    order = order[whole[order]]
    equal = np.zeros(len(order), bool)
    view = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), width)
    for lo in range(1, len(order), 50_000):
        hi = min(len(order), lo + 50_000)
        equal[lo:hi] = (view[order[lo:hi]] == view[order[lo - 1 : hi - 1]]).all(1)
    of = np.searchsorted(at, order, "right") - 1
    doc, sub, start = places[of, 0], places[of, 1], places[of, 2] + order - at[of]
    group = np.cumsum(~equal)
    by = np.lexsort((start, sub, doc, group))
    group, doc, sub, start = (x[by] for x in (group, doc, sub, start))
    head = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(len(group)), 0))
    later = (doc != doc[head]) | (sub != sub[head]) | (start != start[head])
    doc, sub, start = doc[later], sub[later], start[later]
    by = np.lexsort((start, sub, doc))
    doc, sub, start = doc[by], sub[by], start[by]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (start[1:] > start[:-1] + 1)]) if len(doc) else doc
    ends = np.r_[cut[1:] - 1, len(doc) - 1] if len(doc) else doc
    return found + list(zip(doc[cut].tolist(), sub[cut].tolist(), start[cut].tolist(), (start[ends] + width).tolist(), strict=True))


def _suffixes(width: int, block: int) -> Callable:
    """Over rows sorted by hash, context and place."""

    def ranges(found: list[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["doc", "sub", "from", "to"])

    def several(run: list[Context], held: int) -> Iterator[pa.RecordBatch]:
        """A hash whose contexts fill more than a block: what may match is cut out of the whole first, then every two blocks meet."""
        if held <= WHOLE * block:
            run = trimmed(run, width)
        parts, size = [[]], 0
        for x in run:
            if size > block // 2:
                parts.append([])
                size = 0
            parts[-1].append(x)
            size += len(x[3])
        if len(parts) == 1 and run:
            yield from ranges(repeats(run, width))
        for i in range(len(parts)):
            for j in range(i):
                yield from ranges(repeats(parts[j] + parts[i], width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size, now, held, mark = [], 0, [], 0, None
        for b in chain(batches, [None]):
            rows = [] if b is None else zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)
            for h, doc, sub, first, context in chain(rows, [(None, 0, 0, 0, b"")] if b is None else []):
                if h != mark:
                    if held > block:
                        yield from several(now, held)
                    elif len(now) > 1:
                        ready += now
                        size += held
                    if size > block or (h is None and ready):
                        yield from ranges(repeats(ready, width))
                        ready, size = [], 0
                    now, held, mark = [], 0, h
                if not now or now[-1][3] != context:
                    now.append((doc, sub, first, context))
                    held += len(context)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, froms, tos in zip(texts_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            kept, done, spans, end = [], 0, 0, -1
            for x, y in sorted(zip(froms or (), tos or (), strict=True)):
                if x > end:
                    kept.append(text[done:x])
                    spans += 1
                done = end = max(end, y)
            kept.append(text[done:])
            left = b"".join(kept)
            out.append((len(text), len(text) - len(left), spans, hashlib.sha256(left).hexdigest(), left))
        n, removed, spans, digest, left = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_ranges(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """``doc, sub, from, to``: byte ranges that repeat earlier text, in no order and overlapping. ``rows`` has ``doc, sub, body``."""
    found = rows.mapInArrow(_anchors(width, gram), "h long, c long, c2 long, doc long, sub long, first int, last int")
    found = found.repartition("h").sortWithinPartitions("h", "c", "c2", "doc", "sub", "first")
    same = keep(found.mapInArrow(_same_context(width), "h long, doc long, sub long, from long, to long"), "sa-same")
    word = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    marks = same.where("h IS NOT NULL").select(F.shiftright(word, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    for r in marks.groupBy("word").agg(F.bit_or("bit").alias("bit")).toLocalIterator():  # at most 2^(bits - 6) rows
        bitmap[r[0]] = r[1]
    near = rows.mapInArrow(_contexts(width, gram, bitmap, bits), "h long, doc long, sub long, first long, context binary")
    near = near.repartition("h").sortWithinPartitions("h", "context", "doc", "sub", "first")
    apart = near.mapInArrow(_suffixes(width, block), "doc long, sub long, from long, to long")
    return same.where("h IS NULL").select("doc", "sub", "from", "to").unionByName(apart)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes left)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("body"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("sub", F.xxhash64(F.coalesce("body", F.lit(""))))
    found = repeated_ranges(rows.select("doc", "sub", "body"), width, gram, block, bits)
    per_doc = found.groupBy("doc", "sub").agg(F.collect_list("from").alias("froms"), F.collect_list("to").alias("tos"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return rows.join(per_doc, ["doc", "sub"], "left").select("doc_id", "body", "froms", "tos").mapInArrow(_cut, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).drop("kept")
