"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document's words stream through it; at
each word it knows the longest run ending there that some item holds. Where that run has
``window`` words or more, all its words are hit; an item shorter than a window is one itself and
is found on the chain of suffix links. Hit words make spans; ``cleaned`` removes spans
where they are long enough or cover enough of the document.

Words that no item holds end every run, so only stretches of known words are walked.

The benchmark goes to the tasks by broadcast, in groups of at most ``group_chars`` characters, one
automaton and one pass for each group, so a larger benchmark means more passes and no larger
broadcast. A document is judged by itself; nothing is shuffled.

Null texts and texts without words have no words and no hits; null items and items without words
hold nothing; a null item id counts as the id ``null``; repeated items and documents are judged
one by one; empty tables give no hits or no rows; further columns are kept, and columns named as the
results are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlens.llm.common import lean, table
from ledgerlens.plans.registry import Query

WINDOW = 13
#: a document is contaminated where hit words are at least one in COVERAGE
COVERAGE = 20
GROUP_CHARS = 2_000_000

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: bytes of words: digits, a-z (A-Z lower-cased) and all of other alphabets; the rest is space
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # letters of either case


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of many word lists, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.known: dict[bytes, int] = {}
        items = [(i, w) for i, w in items if w]
        coded = [(i, [self.known.setdefault(x, len(self.known)) for x in w]) for i, w in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: shortest run of known words that can hold a window
        self.least = min([window, *(len(c) for _, c in coded)])
        self._mark(coded)

    def _state(self, size: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """State of the longest run of ``p`` followed by ``c``, taken out of ``q`` where that holds longer ones."""
        if self.size[p] + 1 == self.size[q]:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        order = sorted(range(len(self.size)), key=self.size.__getitem__)
        #: state of the last ``window`` words of a state's runs
        self.window_state = [-1] * len(self.size)
        for s in order[1:]:
            if self.size[s] >= self.window:
                self.window_state[s] = s if self.size[self.link[s]] < self.window else self.window_state[self.link[s]]
        self.holders: dict[int, set[str]] = {}
        short: dict[int, set[tuple[int, str]]] = {}
        for item, codes in coded:
            s = 0
            for n, c in enumerate(codes, 1):
                s = self.next[s][c]
                if n >= self.window:
                    self.holders.setdefault(self.window_state[s], set()).add(item)
            if len(codes) < self.window:
                short.setdefault(s, set()).add((len(codes), item))
        #: short items that end where a state's run ends: the state's own and those on its suffix links
        self.short: dict[int, tuple[tuple[int, str], ...]] = {}
        for s in order[1:]:
            if found := (*short.get(s, ()), *self.short.get(self.link[s], ())):
                self.short[s] = found

    def scan(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of word positions, merged, and the items with an occurring window."""
        flags = bytes(map(self.known.__contains__, doc))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        at = flags.find(b"\1" * self.least) if self.known else -1
        while at >= 0:
            stop = flags.find(b"\0", at)
            stop = len(flags) if stop < 0 else stop
            self._walk(doc, at, stop, spans, found)
            at = flags.find(b"\1" * self.least, stop)
        return merged(spans), found

    def _walk(self, doc, at, stop, spans, found) -> None:
        follow, link, size, window = self.next, self.link, self.size, self.window
        s = run = 0
        for i in range(at, stop):
            c = self.known[doc[i]]
            while s and c not in follow[s]:
                s = link[s]
                run = size[s]
            if c in follow[s]:
                s = follow[s][c]
                run += 1
            else:
                s = run = 0
            if run >= window:
                spans.append((i + 1 - run, i + 1))
                found |= self.holders[self.window_state[s]]
            for n, item in self.short.get(s, ()):
                if n <= run:
                    spans.append((i + 1 - n, i + 1))
                    found.add(item)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans = sorted(spans)
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _scan(automaton, text: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton.__new__(Automaton)
        vars(machine).update(automaton.value)
        for b in batches:
            keep = [n for n in b.schema.names if n not in ("_spans", "_items", "_count") and (keep_text or n != text)]
            old_spans, old_items = b.column("_spans").to_pylist(), b.column("_items").to_pylist()
            spans, items, count = [], [], []
            for t, had, held in zip(_texts(b.column(text)), old_spans, old_items, strict=True):
                doc = words(t)
                hit, found = machine.scan(doc)
                spans.append([{"start": s, "end": e} for s, e in merged([*((x["start"], x["end"]) for x in had), *hit])])
                items.append(sorted(found.union(held)))
                count.append(len(doc))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in keep), pa.array(spans, _ARROW_SPANS), pa.array(items, pa.list_(pa.string())), pa.array(count, pa.int64())],
                [*keep, "_spans", "_items", "_count"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, coverage: int = COVERAGE, group_chars: int = GROUP_CHARS, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids), spans (word positions) and contaminated.

    ``keep_text=False`` leaves the text out of the result, and out of the way back from the tasks.
    """
    spark = docs.sparkSession
    made = ("n_words", "n_hit", "items", "spans", "contaminated")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    groups = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_chars) + 1
    out = docs.select(*[c for c in docs.columns if c not in made]).withColumns(
        {"_spans": F.array().cast(_SPANS), "_items": F.array().cast("array<string>"), "_count": F.lit(0).cast("long")})
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g).collect()  # about group_chars
        # plain lists and dicts, so that executors need no installed copy of this package
        automaton = spark.sparkContext.broadcast(vars(Automaton([(r["id"], words(r["text"].encode())) for r in part], window)))
        keep = keep_text or g < groups - 1
        schema = T.StructType([f for f in out.schema if keep or f.name != text])
        out = out.mapInArrow(lean(_scan(automaton, text, keep)), schema)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return out.withColumns({"n_words": F.col("_count"), "n_hit": hit, "items": F.col("_items"), "spans": F.col("_spans")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))).drop("_spans", "_items", "_count")


def cleaned(judged: DataFrame, text: str = "text", least_words: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """Remove hit spans of ``least_words`` words or more, and all spans of contaminated documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans, n_hit, n in zip(*(b.column(c).to_pylist() for c in (text, "spans", "n_hit", "n_words")), strict=True):
                cut = [s for s in spans if s["end"] - s["start"] >= least_words or n_hit * coverage >= n]
                if cut:
                    places = [m.span() for m in _WORD.finditer(t)]
                    keep, last = [], 0
                    for s in cut:
                        keep.append(t[last:places[s["start"]][0]])
                        last = places[s["end"] - 1][1]
                    t = "".join([*keep, t[last:]])
                out.append(t)
            yield b.set_column(b.schema.get_field_index(text), text, pa.array(out, pa.string()))
    return judged.mapInArrow(run, judged.schema)


def contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's benchmark hits and whether they contaminate it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def brute(doc: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, str]:
    """(n_words, n_hit, items digest) by trying every window; for tests."""
    d = words(doc.encode()) if doc else []
    hit, found = set(), set()
    for item, text in items:
        w = words(text.encode()) if text else []
        n = min(window, len(w))
        wanted = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(d) - n + 1):
            if n and tuple(d[i:i + n]) in wanted:
                hit.update(range(i, i + n))
                found.add(item)
    return len(d), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


QUERIES = {"op7_suffix_automaton_decontamination": Query(contaminated_documents)}
