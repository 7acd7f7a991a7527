"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword; each bit of it is a binary classifier that tells the languages with
a one there from those with a zero, by the n-grams of a text. Decoding weighs each bit by how far
the text is from that bit's border and takes the codeword with the smallest loss. A text whose two
best codewords lie close together is flagged ambiguous.

Training is one pass of counting: n-grams are hashed to ``2 ** width_bits`` cells, each task adds its
texts up for each language, and the sums give every classifier in closed form (log odds of a cell
between the two sides of a bit, all languages weighing the same). All labelled rows and all languages count. Cells are
fitted where their counts lie, each cell in one task; the model is cells x bits and languages x bits in size, and the
bits grow with the logarithm of the number of languages.

In training a text weighs by its length.

Null texts and texts without a letter are ``und`` with score 0. Very long texts are read whole. Null
languages teach nothing; with nothing to learn from, every text is ``und``. Ties go to the first
language by name. Repeated rows each get a row; empty tables give empty results. Further columns are kept;
``lang_pred``, ``score`` and ``ambiguous`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlens.llm.common import discard, lean, stored, table
from ledgerlens.plans.registry import Query

WIDTH_BITS, ORDERS = 15, (1, 2, 3)
#: Languages whose counts a training task holds at once, a quarter of a megabyte each; more are handed on in parts.
HELD = 256
#: Smoothing of a cell, as counts for a text of average length; and the loss gap below which a text is ambiguous.
SMOOTHING, AMBIGUOUS = 0.5, 0.02
UNKNOWN = "und"
#: Bytes are read in pieces, so that a text of any length needs little memory.
PIECE = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def codewords(languages: int) -> np.ndarray:
    """Rows of 0 and 1, one for each language: every split for up to 6 languages, else spread-out random splits."""
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 6:
        # every way to cut the languages in two, the first always on side 1
        splits = [(0, *rest) for n in range(languages - 1) for rest in combinations(range(1, languages), n)]
        return np.array([[int(i in s) for s in splits] for i in range(languages)], np.int8)
    bits = 4 * int(np.ceil(np.log2(languages))) + 7
    draws = [np.random.default_rng(seed).permuted(np.tile(np.arange(languages)[:, None] % 2, bits), axis=0) for seed in range(64 if languages <= 100 else 1)]
    apart = [min(int((a[i] != a[j]).sum()) for i, j in combinations(range(languages), 2)) if languages <= 100 else 0 for a in draws]
    return draws[int(np.argmax(apart))].astype(np.int8)


def cells(text: bytes, width_bits: int = WIDTH_BITS) -> np.ndarray:
    """Hashed counts of the byte n-grams of lower-cased text; runs of other than letters are one space."""
    total = np.zeros(1 << width_bits, np.int64)
    shift = np.uint64(64 - width_bits)
    before = np.array([32], np.uint64)  # the last bytes of earlier pieces; a text begins and ends with a space
    for at in range(0, len(text), PIECE):
        raw = np.frombuffer(text[at:at + PIECE], np.uint8)
        letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
        b = np.where(letter, raw, 32).astype(np.uint64)
        if at + PIECE >= len(text):
            b = np.append(b, np.uint64(32))
        b = b[(b != 32) | (np.concatenate([before[-1:], b[:-1]]) != 32)]
        b = np.concatenate([before, b])
        for n in ORDERS:
            # n-grams that end behind the bytes of earlier pieces
            first = max(0, len(before) - n + 1)
            if len(b) - first < n:
                continue
            gram = np.full(len(b) - n + 1 - first, n, np.uint64)
            for k in range(n):
                gram = gram << np.uint64(8) | b[first + k:len(b) - n + 1 + k]
            if n == 1:
                gram = gram[b[first:] != 32]
            total += np.bincount(((gram * _SPREAD) >> shift).astype(np.int64), minlength=1 << width_bits)
        before = b[1 - max(ORDERS):]
    return total


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _count(width_bits: int):
    def rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            for lo in range(0, len(at), 10_000):
                some = at[lo:lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(got[some])], ["lang", "cell", "n"])
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("lang").to_pylist(), strict=True):
                got = cells(text.translate(_LOWER), width_bits)
                if lang in sums:
                    sums[lang] += got
                else:
                    if len(sums) == HELD:
                        yield from rows(sums)
                    sums[lang] = got
        yield from rows(sums)
    return run


def _weigh(known):
    """Weights of the bits for every cell of a partition, whose rows (cell, lang, n) come sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        row, code, total = m["row"], m["code"], m["total"]
        ones, least = code.sum(0), _share(0, total)
        base = least @ code, least @ (1 - code)

        def done(cell, more):
            sides = [np.log((b + x) / n) for b, x, n in zip(base, more, (ones, len(code) - ones), strict=True)]
            return cell, (sides[0] - sides[1]).tolist()

        cell, more, out = None, None, []
        for b in batches:
            for c, lang, n in zip(*(b.column(x).to_pylist() for x in ("cell", "lang", "n")), strict=True):
                if c != cell:
                    if cell is not None:
                        out.append(done(cell, more))
                    cell, more = c, np.zeros((2, code.shape[1]))
                at = row[lang]
                extra = _share(n, total[at]) - least[at]
                more[0] += extra * code[at]
                more[1] += extra * (1 - code[at])
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out])], ["cell", "weights"])
                out = []
        if cell is not None:
            out.append(done(cell, more))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out])], ["cell", "weights"])
    return run


def _share(n, total):
    """Share of a cell with count ``n`` among the ``total`` n-grams of a language, smoothed."""
    return (n + SMOOTHING * 1e-6 * total + 1e-9) / (total + 1e-9)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", width_bits: int = WIDTH_BITS) -> dict:
    """Model from all rows with a text and a language; plain arrays, small enough for every task.

    The driver sees one row for each language and one of bits for each cell; counts stay where they are.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    sums = rows.mapInArrow(lean(_count(width_bits)), "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    sums = stored(sums, "ngrams")
    totals = {r["lang"]: r["n"] for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    code = codewords(len(names))
    weights = np.zeros((1 << width_bits, code.shape[1]))
    model = {"names": names, "code": code, "weights": weights.astype(np.float32), "width_bits": width_bits}
    if len(names) >= 2:
        total = np.array([totals[x] for x in names], np.float64)
        known = labelled.sparkSession.sparkContext.broadcast({"row": {x: i for i, x in enumerate(names)}, "code": code.astype(np.float64), "total": total})
        by_cell = sums.repartition("cell").sortWithinPartitions("cell", "lang")
        # a cell that no language has weighs by the smoothing alone
        ones, least = code.sum(0), _share(0, total)
        weights[:] = np.log(least @ code / ones) - np.log(least @ (1 - code) / (len(names) - ones))
        for r in by_cell.mapInArrow(_weigh(known), "cell int, weights array<double>").toLocalIterator():
            weights[r["cell"]] = r["weights"]
        model["weights"] = weights.astype(np.float32)
    discard(sums)
    return model


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best row of ``code`` for each row of margins, its score in 0..1, and the gap to the next.

    The loss of a codeword is the mean logistic loss of its bits; margins far from a border
    weigh more by themselves. Scores are the shares of exp(-bits x loss).
    """
    sign = 2.0 * code - 1
    loss = np.logaddexp(0, -margins[:, None, :] * sign[None]).mean(2)
    best = loss.argmin(1)
    power = np.exp(-(loss - loss.min(1, keepdims=True)) * code.shape[1])
    ordered = np.sort(loss, 1)
    gap = ordered[:, 1] - ordered[:, 0] if code.shape[0] > 1 else np.full(len(loss), np.inf)
    return best, power[np.arange(len(best)), best] / power.sum(1), gap


#: Margins are means over n-grams; this turns them into the odds of a short text.
SHARPNESS = 8.0


def _predict(model, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names, weights = m["names"], m["weights"].astype(np.float64)
        for b in batches:
            column = b.column(text)
            lang, score, unsure = [], [], []
            for s, raw in zip(column.to_pylist(), column.cast(pa.binary()).to_pylist(), strict=True):
                if not names or s is None or not any(map(str.isalpha, s)):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    unsure.append(False)
                    continue
                count = cells(raw.translate(_LOWER), m["width_bits"])
                at = np.flatnonzero(count)
                margins = (count[at] @ weights[at]) / max(1, count[at].sum()) * SHARPNESS
                best, share, gap = decode(margins[None], m["code"])
                lang.append(names[best[0]])
                score.append(float(share[0]))
                unsure.append(bool(gap[0] < AMBIGUOUS))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                [*keep, "lang_pred", "score", "ambiguous"])
    return run


def identify(docs: DataFrame, model: dict, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous; only the text is looked at."""
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")])
    keep = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.mapInArrow(lean(_predict(docs.sparkSession.sparkContext.broadcast(model), text, keep)), schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), model, keep_text=False).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


QUERIES = {"op5_output_code_languages": Query(document_languages)}
