"""Substring dedup by hashing lines or paragraphs.

Texts are cut at a separator (a line break, or a blank line for paragraphs). A unit is normalised (A-Z lower-cased,
runs of ASCII space as one space, trimmed) and known by a digest of that. Of the equal units of the whole corpus the
earliest by (document id, offset) stays and the others are removed; their offsets in the original text are kept.
Units of fewer than ``least_words`` words always stay.

Digests are counted before they are shuffled, so a unit that every document holds moves once for each
task; only units that repeat are joined back.

A passage may also repeat inside longer lines or across line breaks. ``repeated_passages`` finds every run of
``RUN_WORDS`` words (normalised in the same way) that stands at an earlier place too, wherever its lines end:

1. Each window of ``RUN_WORDS`` words chooses its group of ``GRAM`` words with the least hash. Equal windows choose
   alike, so only the chosen groups (one for about 13 words) are rows, each with a digest of the words of all windows
   that chose it: a stretch. Groups are counted first, and stretches whose group stands nowhere else go at once.
2. Stretches that are equal as a whole are repeats of the first of them.
3. Where stretches agree in the chosen group only, the windows of the first of each kind are compared by digests.

No such run is missed and none is found that does not repeat, up to collisions of digests (64 bits of the group and 64 of the stretch together, 128 for
windows and lines). A window that
overlaps its own first place (a text that repeats one word) stays. ``remove_repeats`` removes repeated units and passages; each removed word stands
in an equal unit or passage at an earlier place.

Null and empty texts hold no units. Very long texts give a row for each unit and are never gathered. Documents with a null
id stay as they are and count for nothing. Rows that repeat an id and a text tie in every place: all of
them stay as the first does. An empty table gives an empty result. ``remove_units`` keeps further columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.common import discard, lean, stored, table
from ledgerlens.plans.registry import Query

LEAST_WORDS = 5
LINE, PARAGRAPH = r"\n", r"\n[ \t]*\n"
#: Words of a passage, and of the groups by which equal passages meet.
RUN_WORDS, GRAM = 51, 26
BATCH_ROWS = 20_000


def _units(separator: str, least_words: int):
    cut = re.compile(separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, end, digest = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                at = 0
                for stop, after in [*((m.start(), m.end()) for m in cut.finditer(text)), (len(text), len(text))]:
                    words = text[at:stop].encode("utf-8", "surrogatepass").lower().split()
                    if len(words) >= least_words:
                        row.append(i)
                        start.append(at)
                        end.append(stop)
                        digest.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                    at = after
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("version").take(take), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())],
                ["doc_id", "version", "start", "end", "digest"])
    return run


def repeated_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = LINE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, version, start, end, first_doc, first_start) of every unit to remove; ``version`` is a hash of the text."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    units = stored(docs.mapInArrow(lean(_units(separator, least_words)), f"doc_id {kind}, version bigint, start int, end int, digest binary"), "units")
    firsts = units.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return units.join(firsts, "digest").where("doc_id != first.doc_id or start != first.start").select(
        "doc_id", "version", "start", "end", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))


def removed_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = LINE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, version and the spans to remove (start, end), for documents that lose something."""
    found = repeated_units(docs, doc_id, text, separator, least_words).distinct()
    return found.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _located(text: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Normalised words of a text, and where each starts and ends in it."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    b = np.frombuffer(raw, np.uint8)
    space = np.concatenate([[True], (b == 32) | ((b >= 9) & (b <= 13)), [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80, dtype=np.int32)])
    return raw.split(), chars[edges[0::2]], chars[edges[1::2]]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` words in a row, from those of the words."""
    size = 1
    while 2 * size <= n:
        h = _mixed(h[:len(h) - size], h[size:])
        size *= 2
    return h if size == n else _mixed(h[:len(h) - (n - size)], h[n - size:])


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _batch(b: pa.RecordBatch, rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    """Rows (place in ``b``, value...) with the id and version at that place."""
    row, *cols = zip(*rows, strict=True)
    take = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays(
        [b.column("doc_id").take(take), b.column("version").take(take), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "version", *names])


def _stretches(run_words: int, gram: int):
    names, types = ["gram", "digest", "at", "n", "start", "end"], [pa.int64(), pa.int64(), *[pa.int32()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in enumerate(b.column("text").to_pylist()):
                words, starts, ends = _located(text)
                if len(words) < run_words:
                    continue
                g = _grams(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), gram)
                chosen = np.lib.stride_tricks.sliding_window_view(g, run_words - gram + 1).argmin(1)
                chosen += np.arange(len(chosen))
                cuts = np.flatnonzero(np.diff(chosen)) + 1
                for at, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chosen)], strict=True):
                    last = stop + run_words - 1
                    rows.append((i, g[chosen[at]].view(np.int64), int.from_bytes(_digest(words[at:last])[:8], "little", signed=True), at, stop - at, starts[at], ends[last - 1]))
                    if len(rows) >= BATCH_ROWS:
                        yield _batch(b, rows, names, types)
                        rows = []
            if rows:
                yield _batch(b, rows, names, types)
    return run


def _windows(run_words: int):
    """Every window of the stretches (at, n) named beside a text."""
    names, types = ["digest", "at", "start", "end"], [pa.binary(), *[pa.int32()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            cuts, first, many = _spread(b.column("wanted"), "at", "n")
            for i, text in enumerate(b.column("text")):
                words, starts, ends = _located(text.as_py())
                for w in range(cuts[i], cuts[i + 1]):
                    rows += [(i, _digest(words[at:at + run_words]), at, starts[at], ends[at + run_words - 1]) for at in range(first[w], first[w] + many[w])]
                    if len(rows) >= BATCH_ROWS:
                        yield _batch(b, rows, names, types)
                        rows = []
            if rows:
                yield _batch(b, rows, names, types)
    return run


def _spread(lists: pa.ListArray, one: str, other: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each list among all, and two fields of the structs in them: a Python object for each would take a hundred times their bytes."""
    return lists.offsets.to_numpy(), lists.values.field(one).to_numpy(), lists.values.field(other).to_numpy()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each row in order, those that overlap or touch as one."""
    for b in batches:
        cuts, start, end = _spread(b.column("spans"), "start", "end")
        bounds, starts, ends = [0], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                order = np.argsort(start[lo:hi], kind="stable")
                s, e = start[lo:hi][order], np.maximum.accumulate(end[lo:hi][order])
                apart = np.flatnonzero(s[1:] > e[:-1])
                starts.append(s[np.concatenate([[0], apart + 1])])
                ends.append(e[np.concatenate([apart, [hi - lo - 1]])])
            bounds.append(bounds[-1] + (len(starts[-1]) if lo < hi else 0))
        both = [pa.array(np.concatenate([np.empty(0, np.int32), *x]).astype(np.int32)) for x in (starts, ends)]
        made = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(both, ["start", "end"]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), made], ["doc_id", "version", "spans"])


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, version, start, end) of stretches that together cover each run of ``run_words`` words or more with an equal at an
    earlier (doc_id, version, word). They may overlap."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.struct("doc_id", "version", "at")
    same_text = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    apart = ~same_text | (F.col("at") >= F.col("first.at") + run_words)

    stretches = stored(docs.mapInArrow(
        lean(_stretches(run_words, gram)), f"doc_id {kind}, version bigint, gram bigint, digest bigint, at int, n int, start int, end int"), "stretches")
    # two numbers for each group; what stands once is never sorted or joined again
    digests = stretches.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    # written, so that the join can split a group that very many stretches share
    several = stored(digests.where("k > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed")), "grams")
    shared = stored(stretches.join(several, "gram"), "shared")
    for table_ in (stretches, several):
        discard(table_)
    kinds = stored(shared.groupBy("gram", "digest", "mixed").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("k")), "kinds")
    equal = shared.join(kinds.where("k > 1").select("gram", "digest", "first"), ["gram", "digest"])
    whole = equal.where(apart).select("doc_id", "version", "start", "end")

    # the first of each kind, where kinds share a group of words; and what overlaps its own first
    near = equal.where(~apart & (F.col("at") != F.col("first.at")))
    wanted = kinds.where("mixed").select("first.*", "n").union(near.select("doc_id", "version", "at", "n")).union(near.select("first.*", "n"))
    wanted = wanted.groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "n")).alias("wanted"))
    windows = stored(docs.join(wanted, ["doc_id", "version"]).select("doc_id", "version", "text", "wanted").mapInArrow(
        lean(_windows(run_words)), f"doc_id {kind}, version bigint, digest binary, at int, start int, end int"), "windows")
    firsts = windows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    found = stored(whole.union(windows.join(firsts, "digest").where(apart).select("doc_id", "version", "start", "end")), "passages")
    for table_ in (shared, kinds, windows):
        discard(table_)
    return found


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = LINE, least_words: int = LEAST_WORDS,
                   run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, version and the spans of repeated units and passages together, for documents that lose something."""
    units = stored(repeated_units(docs, doc_id, text, separator, least_words).select("doc_id", "version", "start", "end"), "repeats")
    found = units.union(repeated_passages(docs, doc_id, text, run_words, (run_words + 1) // 2))
    found = found.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return found.mapInArrow(lean(_merged), found.schema)


def remove_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = LINE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without repeated units (their separators stay), with ``removed``: spans in the original text."""
    return _without(docs, removed_spans(docs, doc_id, text, separator, least_words), doc_id, text)


def _without(docs: DataFrame, spans: DataFrame, doc_id: str, text: str) -> DataFrame:
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("spans").alias("removed"))
    named = docs.drop("removed").join(spans, (F.col(doc_id) == F.col("_id")) & (F.xxhash64(text) == F.col("_version")), "left").drop("_id", "_version")
    ends = F.transform("removed", lambda s: s["end"])
    before = lambda i: F.when(i > 0, F.element_at(ends, F.greatest(i, F.lit(1)))).otherwise(F.lit(0))
    pieces = F.transform("removed", lambda s, i: F.substring(F.col(text), before(i) + 1, s["start"] - before(i)))
    tail = F.substring(F.col(text), F.element_at(ends, -1) + 1, F.length(text))
    return named.withColumn(text, F.when(F.size("removed") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(text)))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = LINE, least_words: int = LEAST_WORDS,
                   run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` without repeated units and passages, with ``removed`` as in ``remove_units``."""
    return _without(docs, repeated_spans(docs, doc_id, text, separator, least_words, run_words), doc_id, text)


def documents_without_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the spans that repeat an earlier line, or a passage of more than 50 words wherever its lines end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _summary(docs, repeated_spans(docs))


def documents_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the line spans that repeat an earlier line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _summary(docs, removed_spans(docs))


def _summary(docs: DataFrame, spans: DataFrame) -> DataFrame:
    out = docs.select("doc_id", F.xxhash64("text").alias("version"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).join(spans, ["doc_id", "version"], "left")
    lost = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]), F.lit(0))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_removed"), (F.col("n_chars") - lost).cast("long").alias("chars_kept"),
                      F.coalesce(text, F.lit("")).alias("removed"))


ORACLE = rf"""
with d as (select doc_id, text from documents where doc_id is not null and text is not null),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from d),
o as (select doc_id, line, cast(sum(length(line) + 1) over (partition by doc_id order by n) - length(line) - 1 as bigint) as start,
             trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) as unit from l),
k as (select doc_id, start, start + length(line) as stop, row_number() over (partition by unit order by doc_id, start) as place
      from o where len(string_split(unit, ' ')) >= {LEAST_WORDS}),
s as (select doc_id, count(*) as n_removed, sum(stop - start) as lost, string_agg(start || ':' || stop, ',' order by start) as removed from k where place > 1 group by 1)
select doc_id, coalesce(n_removed, 0) as n_removed, cast(coalesce(length(text), 0) - coalesce(lost, 0) as bigint) as chars_kept, coalesce(removed, '') as removed
from documents left join s using (doc_id)
"""

#: The SQL of ``op6_line_dedup`` holds whole lines; the first query also finds passages, and tests compare it with brute force.
QUERIES = {"op6_passage_dedup": Query(documents_without_passages), "op6_line_dedup": Query(documents_without_repeats, ORACLE)}
