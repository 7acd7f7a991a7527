"""Python workers hold little beside their batch, and give it back. No session is needed."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from ledgerlens.llm import common, packing


def test_encoder_asks_for_few_chunks_at_once(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encode = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    whole = encode._ids([text])[0]
    asked = []
    ids = encode._ids
    monkeypatch.setattr(encode, "_ids", lambda texts: asked.append(len(texts)) or ids(texts))
    assert encode(text) == whole
    assert len(asked) > 1 and max(asked) <= packing.ENCODED


def test_lean_gives_back_also_after_a_failure(monkeypatch):
    back = []
    monkeypatch.setattr(common, "give_back", lambda: back.append(1))
    assert list(common.lean(lambda batches: iter(batches))(iter([1, 2]))) == [1, 2]
    assert len(back) == 2

    def fails(batches):
        yield next(batches)
        raise ValueError("x")

    with pytest.raises(ValueError):
        list(common.lean(fails)(iter([1, 2])))
    assert len(back) == 4


def test_stages_of_the_pipeline_run_lean():
    import inspect

    from ledgerlens.llm import decontaminate, language, near_text
    for used, name in ((packing.pieces, "_pieces"), (language.train, "_count"), (language.identify, "_predict"),
                       (decontaminate.contamination, "_scan"), (near_text.one_of_each, "_sign")):
        assert f"lean({name}(" in inspect.getsource(inspect.getmodule(used))


def _spans(rows):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([[{"start": s, "end": e} for s, e in r] for r in rows], kind)],
                                      ["doc_id", "version", "spans"])


def test_merged_spans_against_marked_characters():
    from ledgerlens.llm.paragraphs import _merged

    rnd = random.Random(5)
    rows = [[(s := rnd.randrange(60), s + rnd.randint(1, 9)) for _ in range(rnd.randint(0, 8))] for _ in range(200)] + [[(0, 50), (3, 5), (50, 51), (52, 53)]]
    got = next(_merged(iter([_spans(rows)])))
    for row, made in zip(rows, got.column("spans").to_pylist(), strict=True):
        marked = sorted({c for s, e in row for c in range(s, e)})
        want = [c for c in marked if c - 1 not in marked], [c + 1 for c in marked if c + 1 not in marked]
        assert ([m["start"] for m in made], [m["end"] for m in made]) == want


def test_merging_many_spans_makes_no_object_for_each():
    from ledgerlens.llm.paragraphs import _merged

    batch = _spans([[(7 * i, 7 * i + 5 + i % 5) for i in range(50_000)]])
    tracemalloc.start()
    try:
        assert len(next(_merged(iter([batch]))).column("spans")[0]) == 20_001
        assert tracemalloc.get_traced_memory()[1] < 4e6  # 0.4 MB of spans
    finally:
        tracemalloc.stop()
