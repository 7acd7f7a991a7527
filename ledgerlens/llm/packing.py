"""Sequence packing by patterns fitted with non-negative least squares.

A pattern is a multiset of at most ``PARTS`` lengths that fill a sequence exactly. Given the
histogram of piece lengths, repeat counts of all patterns are fitted so that the lengths they use
come as near to the histogram as they can; the counts are rounded down to what the histogram
holds, and the residual pieces are packed best-fit decreasing, also by counts. All of that works
on the histogram, whose size is the capacity, not the corpus. Then every piece gets its rank among
the pieces of its length, and a rank names one slot of one sequence of the plan. Full pieces are sequences of their
own, with negative numbers, and are not ranked or shuffled.

Lengths only decide; which piece of a length takes which slot follows a digest of the document.

A null text counts as empty: its only token is the end id. Very long texts are cut into full
sequences (the first piece may be shorter). Repeated rows and null ids are pieces like any others;
an empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.common import lean, numbered, stored, table
from ledgerlens.plans.registry import Query

CAPACITY, END = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Parts of a pattern, and steps of the fit.
PARTS, STEPS = 3, 400
#: Chunks whose ids a Python worker keeps, about 200 bytes each. The first ones met are the frequent ones; others are
#: encoded each time they come.
KNOWN = 800_000
#: Chunks encoded in one call: what the tokenizer returns for one takes a hundred times its ids.
ENCODED = 512
#: Pieces of a length that one window ranks, about; a length has as many windows as its count asks for.
RANKED = 4096

# Chunks of text that the tokenizer's own first cut never crosses: anything up to and with a run of
# letters, where an ASCII character that is no letter follows. Letters here are those of ASCII and the two
# Latin blocks after it; a run followed by any further character is joined with what comes next.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_CHUNK = re.compile(f"[^{_L}]*+[{_L}]++(?:[^\\x00-\\x7f{_L}][^{_L}]*+(?:[{_L}]++|\\Z))*+|[^{_L}]++\\Z")


class Encoder:
    """Token ids of a text, as little-endian bytes; chunks seen before are looked up."""

    def __init__(self, file: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._ids([text])[0]
        chunks = _CHUNK.findall(text)
        ids = list(map(self.known.get, chunks))
        if None in ids:
            new = list({c: None for c, i in zip(chunks, ids, strict=True) if i is None})
            made = {c: i for k in range(0, len(new), ENCODED) for c, i in zip(new[k:k + ENCODED], self._ids(new[k:k + ENCODED]), strict=True)}
            ids = [made[c] if i is None else i for c, i in zip(chunks, ids, strict=True)]
            if len(self.known) < KNOWN:
                self.known.update(made)
        return b"".join(ids)


def encoder(file: str) -> Encoder:
    """The worker's encoder; it outlives a task, and so does what it knows."""
    kept = sys.modules.setdefault("_ledgerlens_worker", types.ModuleType("_ledgerlens_worker")).__dict__
    if file not in kept:
        kept[file] = Encoder(file)
    return kept[file]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(file: str, capacity: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file)
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = encode(text or "") + tail
                for p, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append(i)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s:4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lean(_pieces(file, capacity, end)), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(capacity: int, have: np.ndarray) -> np.ndarray:
    """All ways to fill ``capacity`` with 1 to PARTS lengths that occur; rows descending, padded with 0."""
    found = [[capacity, 0, 0]] if have[capacity] else []
    for a in range(capacity - 1, (capacity - 1) // PARTS, -1):
        if not have[a]:
            continue
        rest = capacity - a
        if rest <= a and have[rest]:
            found.append([a, rest, 0])
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
        b = b[have[b] & have[rest - b]]
        found.extend(zip([a] * len(b), b.tolist(), (rest - b).tolist(), strict=True))
    return np.array(found, np.int64).reshape(-1, 3)


def fit(pattern: np.ndarray, histogram: np.ndarray, power: float = 1.0, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |W (A x - h)|: accelerated projected gradient, A as index triples.

    W weighs a length by its share of a sequence to the ``power``: a long piece left over costs
    a sequence, a short one fits anywhere.
    """
    size = len(histogram)
    flat = pattern.ravel()
    share = (np.arange(size) / (size - 1)) ** power
    weight = (pattern > 0).ravel() * share[flat]
    histogram = histogram * share
    use = lambda x: np.bincount(flat, np.repeat(x, pattern.shape[1]) * weight, size)
    back = lambda r: (r[flat] * weight).reshape(pattern.shape).sum(1)
    v = np.ones(len(pattern))
    for _ in range(30):  # largest eigenvalue by the power method
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    rate = 1 / (1.05 * norm)
    x = y = np.zeros(len(pattern))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * back(use(y) - histogram))
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / ahead * (new - x)
        x, t = new, ahead
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths of a sequence, repeats). Equal sequences are filled together."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for n in range(capacity, 0, -1):
        left = int(counts[n])
        for room in range(n, capacity):
            if not left:
                break
            for content in list(open_.get(room, ())):
                # whole groups of equal sequences take one more piece each
                took = min(left, open_[room][content])
                open_[room][content] -= took
                if not open_[room][content]:
                    del open_[room][content]
                below = open_.setdefault(room - n, {})
                below[(*content, n)] = below.get((*content, n), 0) + took
                left -= took
                if not left:
                    break
        # new sequences; what fits again goes on into them
        while left:
            each = min(capacity // n, left)
            many = left // each
            group = open_.setdefault(capacity - each * n, {})
            group[(n,) * each] = group.get((n,) * each, 0) + many
            left -= many * each
    return [(content, many) for g in open_.values() for content, many in g.items()]


def _rounded(pattern: np.ndarray, x: np.ndarray, histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns as often as fitted and as pieces last, the most frequent first; then the residual."""
    left = histogram.astype(np.int64).copy()
    out = []
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 1:
            break
        lengths = pattern[i][pattern[i] > 0]
        kinds, need = np.unique(lengths, return_counts=True)
        many = int(min(np.floor(x[i]), (left[kinds] // need).min()))
        if many:
            left[kinds] -= many * need
            out.append((tuple(int(n) for n in lengths), many))
    return out + best_fit(left, capacity)


#: Weights of the fit and shares of the fitted counts that are tried; the plan with the fewest sequences is taken.
POWERS, SHARES = (1.0, 0.5), (1.0, 0.75, 0.5)


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up ``histogram`` (count of each length, from 0 to capacity)."""
    pattern = patterns(capacity, histogram > 0)
    if not len(pattern):
        return best_fit(histogram, capacity)
    plans = [_rounded(pattern, x * share, histogram, capacity) for p in POWERS for x in [fit(pattern, histogram, p)] for share in SHARES]
    return min(plans, key=lambda made: sum(n for _, n in made))


def _slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of every slot group, by rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, many in made:
        offset = 0
        for n in lengths:
            rows.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + many
            offset += n
        sequence += many
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def _place(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = slots.value
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("_rank_in").to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for one in np.unique(n):
                at = np.flatnonzero(n == one)
                first, base, off = by[int(one)]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at] = base[k] + rank[at] - first[k]
                offset[at] = off[k]
            keep = [c for c in b.schema.names if c != "_rank_in"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])
    return run


def pack(cut_docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_docs`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset; read more than once."""
    counts = cut_docs.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["count"]
    slots = cut_docs.sparkSession.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    kept = cut_docs.columns
    # a full piece is a sequence of its own: it needs a number that no other has, and no rank
    number = (F.lit(-1) - F.monotonically_increasing_id()).cast("long")
    full = cut_docs.where(F.col("length") == capacity).select(*kept, number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    buckets = F.element_at(F.lit([int(-(-n // RANKED)) or 1 for n in histogram]), F.col("length").cast("int") + 1)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets)
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "piece", "ids_crc32")]
    ranked = numbered(cut_docs.where(F.col("length") < capacity), ["length"], order, bucket, "_rank_in")
    ranked = ranked.select(*kept, F.col("_rank_in").cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_docs.schema)
    return ranked.mapInArrow(_place(slots), f"{schema}, sequence_id bigint, offset bigint").unionByName(full)


def pack_documents(docs: DataFrame, file: str | None = None) -> DataFrame:
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path(TOKENIZER)
    return pack(stored(pieces(docs, file), "pieces"))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_pattern_packing": Query(packed_documents)}
