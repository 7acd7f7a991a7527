"""Near-duplicates, archives, packing, sharding and the pipeline."""

import random
import zlib

import numpy as np
import pytest

from ledgerlens.llm import captures, common, decontaminate, language, near_text, near_vectors, packing, shards
from ledgerlens.llm.common import table
from tests.compare import check, duck
from tests.llm import brute


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    want = brute.components({n for e in links for n in e}, links)
    got = {r.id: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and set(got) == {n for a, b in links if a != b for n in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- vectors

def brute_vectors(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, count = [], {}
    for x, (a, u) in enumerate(good):
        for b, v in good[x + 1:]:
            if len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9:
                links.append((a, b))
                count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
    comp = brute.components({i for i, _ in rows if i is not None}, links)
    return {i: (count.get(i, 0), comp[i]) for i, _ in rows if i is not None}


def test_vectors_against_brute(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    near = base[:20].repeat(4, 0) + rng.normal(size=(80, 16)) * 0.12
    crowd = base[0] + rng.normal(size=(120, 16)) * 0.05
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(np.concatenate([base, near, crowd, base[:10], base[:5] * 2]))]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [float("inf")] + [0.0] * 15), (1005, []), (1006, [1.0, 0.0]), (1007, [2.0, 0.1]),
             (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cls", "'l' as list")
    got = near_vectors.linked_vectors(df).collect()
    want = brute_vectors(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (*want[r.vec_id], want[r.vec_id][1] == r.vec_id), r
    assert near_vectors.linked_vectors(df.limit(0)).count() == 0


def test_vector_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    got = {r.vec_id: r.n_links for r in near_vectors.linked_embeddings(spark, sf).collect()}
    want = {i: n for i, (n, _) in brute_vectors(rows).items()}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.9 * sum(want.values())


def test_vector_recall_with_more_lists_than_probes(spark):
    # 8,000 vectors make 44 lists, so 16 probes leave 28 of them out
    rng = np.random.default_rng(12)
    base = rng.normal(size=(4000, 64))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.45])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum(int((unit[at:at + 1000] @ unit.T >= near_vectors.COSINE).sum()) for at in range(0, len(unit), 1000)) - len(unit)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = near_vectors.linked_vectors(df).agg({"n_links": "sum"}).first()[0]
    assert want > 1000 and 0.9 * want <= got <= want


def test_table_distance_bound_loses_nothing():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = near_vectors.fit(x, 8)
    order, codes, error = near_vectors.encode(model, x, 8)
    for lst in range(8):
        at = np.flatnonzero(order[:, 0] == lst)
        table_ = np.sqrt(np.maximum(0, near_vectors.table_distances(model, x, lst, codes[at])))
        true = np.linalg.norm(x[:, None] - x[at][None], axis=2)
        assert (abs(table_ - true) <= error[at][None] + 1e-9).all()


# ---- texts

def near_text_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    hub = [word() for _ in range(100)]
    for i in range(40):  # copies link with the hub and hardly with each other
        rows.append((n, " ".join(w if k // 2 != i else word() for k, w in enumerate(hub))))
        n += 1
    rows.append((n, " ".join(hub)))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "Two words"), (904, "two WORDS"), (905, "words two"), (906, "x " * 5000), (907, "x " * 9000), (908, "É é"), (909, "é É")]


@pytest.mark.parametrize("block", [1024, 8])
def test_near_texts_against_brute(spark, monkeypatch, block):
    monkeypatch.setattr(near_text, "BLOCK", block)
    monkeypatch.setattr(near_text, "LEADER_ROWS", 5)
    rows = near_text_rows()
    want = brute.near_texts(rows)
    df = spark.createDataFrame([*rows, rows[3], (None, rows[3][1])], "doc_id long, text string").selectExpr("*", "1 as cls", "2 as bucket", "3 as digest")
    got = near_text.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.kept is None and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r
    if block == 8:
        assert near_text.near_duplicates(df.limit(0)).count() == 0


def test_posterior_bounds():
    assert [near_text.least_matches(n, 0.8, 1e-5) for n in (32, 128)] == [14, 79] or near_text.least_matches(32, 0.8, 1e-5) < 20
    bounds = near_text._bounds((80, 100), 1e-5)
    assert bounds == sorted(bounds) and len(bounds) == near_text.HASHES // near_text.STEP
    same = np.zeros((1, near_text.HASHES), np.uint32)
    assert near_text.survivors(same, same, bounds)[0] == near_text.HASHES and near_text.survivors(same, same + 1, bounds)[0] == -1


# ---- archives

def test_archive_query_equals_sql(spark, sf_dir):
    q = captures.QUERIES["op8_capture_index"]
    ok, note = check(spark, duck(sf_dir), sf_dir, "op8", q.run, q.sql)
    assert ok, note


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(captures, "BLOCK_LINES", 3)
    big = "<p>ü\r\n\r\nWARC/1.1</p>" * 100
    rows = [(i, f"http://www.x{i % 4}.org/p{i}?q", f"page {i}") for i in range(40)]
    rows += [(50, "http://a.org/", big), (51, "HTTP://A.org/", big), (52, None, big), (52, None, big), (53, "no scheme\r\nX: y", None), (54, "http://a.org/", ""), (None, "http://n.org/", big),
             (60, "http://l.org/", "long " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' as key", "1 as digest")
    archive = captures.write_archive(pages)
    assert archive.files.agg({"blocks": "sum"}).first()[0] >= 16
    every = captures.lookup(archive, pages.select(captures.url_key(pages["url"]).alias("key")))
    got = captures.fetch(every).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [r.record_type for i in (50, 51, None) for r in by[i]] == ["revisit"] * 3 and [r.record_type for r in by[52]] == ["response"] * 2
    assert {by[i][0].refers_to_id for i in (50, 51, None)} == {by[52][0].record_id}
    for i, url, html in rows:
        for r in by[i]:
            if r.record_type == "response":
                assert r.payload == (html or "").encode() and r.payload_bytes == len(r.payload)
    assert by[53][0].url == "no%20scheme%0D%0AX:%20y" and by[52][0].url is None
    some = captures.lookup(archive, spark.createDataFrame([("org,x1,www)/p5?q",), ("missing",), (None,)], "key string")).collect()
    assert [r.page_id for r in some] == [5]
    empty = captures.write_archive(pages.limit(0))
    assert empty.files.count() == 0 and captures.lookup(empty, every.select("key")).count() == 0


def test_key_with_many_captures(spark, monkeypatch):
    """Captures of one key, and small payloads without a match, in more than one part."""
    monkeypatch.setattr(captures, "BLOCK_LINES", 4)
    monkeypatch.setattr(captures, "FOUND", 5)
    pages = spark.createDataFrame([(i, None, None) for i in range(60)] + [(None, None, None)] * 2, "page_id long, url string, html string")
    archive = captures.write_archive(pages)
    found = captures.lookup(archive, pages.select(captures.url_key(pages["url"]).alias("key")))
    assert sorted(r.page_id for r in found.collect() if r.page_id is not None) == list(range(60)) and found.count() == 62
    assert {r.record_type for r in captures.fetch(found).collect()} == {"response"}


# ---- packing

def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


ODD = ["", "a", "don't 'tis I'LL", "  two  spaces \n\n tabs\t x", "日本語abc 日本", "é̀x naïve ǅ ɏɐ", "x<|endoftext|>y", "12ab34 ٣٤ ½", "…—“q”", "a\u00a0b\u2003c", "🙂ok 🙂", "ſK\u0301z"]


def test_chunked_ids_equal_the_tokenizer(spark, sf_dir):
    import public_tokenizers

    whole, encode = tokenizer(), packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(9)
    texts = ODD + ["".join(rng.choice(["a", "É", " ", "'", "s", "\n", "日", "1", ".", "\u0301", "ɐ", "\u00a0"]) for _ in range(30)) for _ in range(500)]
    texts += [r.text for r in table(spark, sf_dir, "documents").limit(60).collect()]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def sound(rows, capacity=packing.CAPACITY):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packed_documents(spark, sf_dir):
    whole = tokenizer()
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = packing.packed_documents(spark, sf_dir).collect()
    used = sound(rows)
    histogram = np.bincount([r.length for r in rows], minlength=packing.CAPACITY + 1)
    assert used <= sum(n for _, n in packing.best_fit(histogram, packing.CAPACITY))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in texts.items():
        ids = [*whole.encode(text, add_special_tokens=False).ids, packing.END]
        want = [(p, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for p, (s, n) in enumerate(packing.cut(len(ids), packing.CAPACITY))]
        assert sorted(got[i]) == want


def test_plans_use_up_the_histogram():
    rng = np.random.default_rng(3)
    for capacity in (8, 50, 1024):
        for _ in range(4):
            histogram = np.concatenate([[0], rng.integers(0, 60, capacity) * (rng.random(capacity) < 0.4)])
            used, made = np.zeros_like(histogram), packing.plan(histogram, capacity)
            for lengths, n in made:
                assert sum(lengths) <= capacity and n > 0
                np.add.at(used, list(lengths), n)
            assert (used == histogram).all()
            assert sum(n for _, n in made) <= 1.03 * sum(n for _, n in packing.best_fit(histogram, capacity)) + 2
    assert packing.plan(np.zeros(1025, int)) == [] and packing.cut(3000, 1024) == [(0, 952), (952, 1024), (1976, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_packing_edges(spark):
    rows = [(1, None), (1, None), (None, "x"), (2, ""), (3, "word " * 40_000), *[(10 + i, t) for i, t in enumerate(ODD)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "'z' as length")
    got = packing.pack_documents(docs).collect()
    sound(got)
    assert [r.length for r in got if r.doc_id == 1] == [1, 1] and sum(r.length for r in got if r.doc_id == 3) == len(tokenizer().encode("word " * 40_000).ids) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_full_pieces_and_windows_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 2)
    rows = [(i, "word " * (1 + i % 3)) for i in range(90)] + [(100 + i, "word " * 3_000) for i in range(9)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sound(got)
    full = [r for r in got if r.length == packing.CAPACITY]
    assert len(full) >= 9 and len({r.sequence_id for r in full}) == len(full) and all(r.sequence_id < 0 and r.offset == 0 for r in full)


# ---- shards

def test_shards_against_brute(spark, sf_dir):
    rows = shards.sharded_documents(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        assert r.shard == brute.tree_shard(r.doc_id, shards.tree(24)) and r.grown_shard == brute.tree_shard(r.doc_id, shards.tree(25))
        assert r.grown_shard in (r.shard, 24)
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_changed_weight_moves_keys_of_its_subtree_only(spark):
    before = shards.tree(24)
    after = [s if s.shard != 5 else shards.Shard(s.region, s.rack, s.shard, 3.0) for s in before]
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    moved = shards.place(shards.place(keys, "doc_id", before), "doc_id", after, "new_").where("shard != new_shard").collect()
    # rows come into the heavier region; those of the region into the heavier rack; those of the rack into the shard
    assert moved and all(r.new_region == 0 for r in moved)
    assert all(r.new_rack == 1 for r in moved if r.region == 0) and all(r.new_shard == 5 for r in moved if r.rack == 1)
    share = shards.place(keys, "doc_id", after).where("shard = 5").count() / 4000
    assert abs(share - 3 / 26) < 0.02


def test_shard_edges(spark, tmp_path):
    rows = [(1, None), (None, "é"), (None, "é"), (2, ""), (2, ""), (3, "x" * 10**6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'r' as region", "'s' as shard", "0 as _none")
    placed = shards.place(docs, "doc_id", shards.tree(3))
    assert {r.shard for r in placed.where("doc_id is null").collect()} == {brute.tree_shard("null", shards.tree(3))}
    got = shards.slots(placed, "doc_id", ["text"]).collect()
    assert len(got) == 6
    for s in range(3):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert shards.slots(placed.limit(0), "doc_id", []).count() == 0
    shards.write_shards(docs, "doc_id", shards.tree(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    with pytest.raises(ValueError):
        shards.place(docs, "doc_id", [])


# ---- pipeline

def test_near_text_query_against_brute(spark, sf_dir):
    """The query takes shingles of four words; the operator's own default, and so the pipeline's, is five."""
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    found = near_text.QUERIES["op3_bayes_minhash"].run(spark, sf_dir)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == brute.near_texts(docs, words=4) and near_text.WORDS == 5
    five = {r.doc_id for r in near_text.near_duplicates(table(spark, sf_dir, "documents")).where("kept").collect()}
    assert five == {i for i, (_, c) in brute.near_texts(docs).items() if i == c} != {i for i, (_, c) in got.items() if i == c}


def test_rows_that_share_an_id_are_kept_apart(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(1, same, "a"), (1, "completely other words stand in this one row", "b"), (2, same, "c"), (2, "one more text that nothing else comes near to", "d"),
            (3, same + " eleven", "e"), (4, "", "f"), (4, None, "g"), (4, "", "f"), (5, "alone with few words", "z"), (5, "alone with few words", "y"), (None, same, "h"), (None, same, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version string")
    got = sorted(near_text.one_of_each(docs).collect(), key=repr)
    stays = [rows[0], rows[1], rows[3], rows[5], rows[6], rows[9], rows[10], rows[11]]
    assert [tuple(r) for r in got] == sorted(stays, key=lambda r: repr(docs.sparkSession.createDataFrame([r], docs.schema).first()))


def test_pipeline_against_brute(spark, sf_dir):
    import corpus_pipeline

    whole = tokenizer()
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()))
    named = {r.doc_id: r.lang_pred for r in language.identify(docs, model).where("not ambiguous").collect()}
    items = [(str(r.item_id), r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    left = [(r.doc_id, r.text) for r in docs.collect() if named.get(r.doc_id, "und") != "und"]
    near = brute.near_texts(left)
    want = set()
    for i, text in left:
        words, hit, _ = decontaminate.brute(text, items)
        if near[i][1] != i or (hit and 20 * hit >= words):
            continue
        found = brute.secrets(text)
        ids = [*whole.encode(brute.redacted(text, found) if found else text, add_special_tokens=False).ids, packing.END]
        want |= {(i, p, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for p, (s, n) in enumerate(packing.cut(len(ids), packing.CAPACITY))}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    sound(rows)
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


def test_pipeline_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    import corpus_pipeline

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "the cat and the dog", None, "s", 3), (3, "the cat and the dog sat on a mat", "en", "s", 4),
            (4, "the cat and the dog sat on a mat", "en", "s", 4), (5, "der hund und die katze mit password=abcdef12", "de", None, None)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "5", "None"]
    masked = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.secrets(spark, docs, sf_dir).collect()}
    assert masked[5] == ("der hund und die katze mit [SECRET]", 35) and masked[1] == (None, None)
