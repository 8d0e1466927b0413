"""Packing, leakage and shared spans against brute force, with the hard cases of each."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import kernels, leakage, packing, spans

DOCS = "doc_id bigint, text string"
TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]+", re.ASCII)
AWKWARD = ["", " ", "a", "é", "\\alpha2 b\\\\beta c", "x" * 5000, "word " * 9000, "日本語 text here", "\\", "\\1a", "A\\B", "a_b-c  d\t\x0be", "İstanbul K"]


def test_token_counts():
    texts = [*AWKWARD, *(" ".join(random.Random(i).choices(["ab", "--", "_", "é!", "\n"], k=50)) for i in range(50))]
    texts += ["a b\n\nc d", "\n\nx", "a\n\n", "one\n\ntwo\n\nthree " * 3]
    n, loss = kernels.token_counts([t.encode() for t in texts], b"\n\n")
    assert n.tolist() == [len(TOKEN.findall(t)) for t in texts]
    assert loss.tolist() == [len(TOKEN.findall(t.split("\n\n", 1)[-1])) for t in texts]


def plain_words(text):
    found = re.findall(r"[A-Za-z0-9]+", re.sub(r"\\[A-Za-z]+", " ", text or ""))
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found]


def test_word_hashes(monkeypatch):
    texts = [*AWKWARD, "Some \\LaTeX{} words, " * 300]
    for segment in (kernels._SEGMENT, 1024):  # long texts in pieces, too
        monkeypatch.setattr(kernels, "_SEGMENT", segment)
        got = [[] for _ in texts]
        for index, hashes, pos in kernels.placed_words([t.encode() for t in texts]):
            for h, i, k in zip(hashes.tolist(), index.tolist(), pos.tolist()):
                assert k == len(got[i])
                got[i].append(h)
        names = {}
        for t, hashes in zip(texts, got):
            want = plain_words(t)
            if max(map(len, want), default=0) < segment // 2:
                assert len(want) == len(hashes)
                assert all(names.setdefault(w, h) == h for w, h in zip(want, hashes))
        assert len(set(names.values())) == len(names)
        monkeypatch.undo()


def test_word_hashes_of_a_long_text_behind_short_ones():
    texts = [b"lorem ipsum " * 85] * 250 + [b"dolor sit amet " * 60_000, b"end"]  # about 250 KB, then 900 KB
    sizes = {}
    for index, hashes, pos in kernels.placed_words(texts):
        for i in np.unique(index):
            own = pos[index == i]
            assert np.array_equal(own, np.arange(len(own)) + sizes.get(i, 0))
            sizes[i] = sizes.get(i, 0) + len(own)
    assert sizes == {i: 170 for i in range(250)} | {250: 180_000, 251: 1}
    blanks = [b""] * (kernels._SEGMENT + 2000) + [b"word"]
    assert sum(len(h) for _, h, _ in kernels.word_hashes(blanks)) == 1


def test_packing_keeps_every_token_within_the_limits(spark):
    r = random.Random(3)
    sizes = [0, 1, 2048, 2049, 5000, 100_000, *(r.choice([r.randint(1, 40), r.randint(1, 2500)]) for _ in range(400))]
    counts = spark.createDataFrame([(i, n, r.randint(0, n)) for i, n in enumerate(sizes)], "id bigint, n_tokens bigint, n_loss bigint")
    limits = packing.Limits(2048, 5, 2048)
    rows = packing.pack(counts, limits, shard_items=100).collect()
    assert {x.id for x in rows} == {i for i, n in enumerate(sizes) if n}
    for i, n in enumerate(sizes):
        own = sorted((x for x in rows if x.id == i), key=lambda x: x.piece)
        assert len(own) == -(-n // 2048) and all(x.n_pieces == len(own) for x in own)
        assert [x.tok_from for x in own] == [k * 2048 for k in range(len(own))] and (not own or own[-1].tok_to == n)
    boxes = {}
    for x in rows:
        boxes.setdefault(x.container, []).append(x)
    marked = {i: counts_[1] for i, counts_ in enumerate((r_.n_tokens, r_.n_loss) for r_ in counts.orderBy("id").collect())}
    assert all(sum(x.loss for x in rows if x.id == i) == marked[i] for i in marked if sizes[i])
    assert all(sum(x.tok_to - x.tok_from for x in b) <= 2048 and len(b) <= 5 and sum(x.loss for x in b) <= 2048 for b in boxes.values())
    assert packing.pack(counts.limit(0)).count() == 0
    tight = packing.pack(counts, packing.Limits(2048, 64, 500), shard_items=100).groupBy("container").agg(F.sum("loss").alias("l")).agg(F.max("l")).first()[0]
    assert tight <= 500


def test_packing_leaves_little_room(spark):
    r = np.random.default_rng(4)
    counts = spark.createDataFrame([(i, int(n), int(n)) for i, n in enumerate(r.integers(50, 1200, 3000))], "id bigint, n_tokens bigint, n_loss bigint")
    rows = packing.pack(counts)
    used, boxes = rows.agg(F.sum(F.col("tok_to") - F.col("tok_from")), F.count_distinct("container")).first()
    assert used / (boxes * 2048) > 0.98


def test_packing_texts_with_nulls(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "x " * 3000)], DOCS).withColumn("n_tokens", F.lit("clash"))
    rows = packing.packed_documents(docs).collect()
    assert sorted((x.id, x.piece, x.tok_to - x.tok_from) for x in rows) == [(3, 0, 2), (4, 0, 2048), (4, 1, 952)]


def leaks(docs, items, words):
    out = set()
    for d, text in docs:
        if d is None:
            continue
        w = plain_words(text)
        grams = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
        for item, *fields in items:
            for f in fields:
                q = plain_words(f)
                if any(tuple(q[i : i + words]) in grams for i in range(len(q) - words + 1)):
                    out.add((d, item))
    return out


@pytest.mark.parametrize("repeated", [False, True])
def test_leakage_equals_brute_force(spark, repeated):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)] + [f"rare{i}" for i in range(300)]
    text = lambda n: " ".join(r.choices(vocabulary, weights=[30] * 12 + [1] * 300, k=n))
    items = [(i, text(r.randint(3, 20)), text(r.randint(0, 9)) or None) for i in range(30)]
    items += [(90, "w1 " * 10, None), (91, None, None), (92, "only in the test set and nowhere else", None), (93, items[0][1], items[1][1]), (93, items[0][1], None)]
    docs = []
    for d in range(80):
        parts = [text(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            w = plain_words(r.choice(items)[1])
            a = r.randint(0, max(0, len(w) - 4))
            parts.append(r.choice([", ", " \\cmd ", " % "]).join(x.upper() if r.random() < 0.3 else x for x in w[a : a + r.randint(2, 9)]))
        docs.append((d, " ; ".join(parts)))
    docs += [(900, None), (901, ""), (902, "W1 " * 9), (903, "w1 w1 w1 w1 w1"), (None, items[0][1])]
    if repeated:  # rows with one id: equal, and halves that hold a passage only together
        w = plain_words(items[2][1])
        docs += [docs[0], (950, " ".join(w[:4]) + " x" * 40), (950, "x x x x " + " ".join(w[4:]))]
    frame = spark.createDataFrame(docs, DOCS).withColumn("pos", F.lit("clash"))
    found = leakage.matches(frame, spark.createDataFrame(items, "item_id bigint, passage string, question string"), "item_id", ["passage", "question"], words=5)
    got = {(x.doc_id, x.item_id) for x in found.where("longest_run >= 5").collect()}
    assert got == leaks(docs, items, 5) and len(got) > 50
    for empty in (frame.limit(0), frame):
        none = spark.createDataFrame([], "item_id bigint, passage string, question string") if empty is frame else spark.createDataFrame(items, "item_id bigint, passage string, question string")
        assert leakage.matches(empty, none, "item_id", ["passage", "question"], words=5).count() == 0


def test_leakage_in_a_very_long_text(spark, monkeypatch):
    filler = "lorem ipsum dolor " * 70_000  # over a segment of 2**20 bytes
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = spark.createDataFrame([(1, filler + passage + " " + filler), (2, filler)], DOCS)
    items = spark.createDataFrame([(7, passage, None)], "item_id bigint, passage string, question string")
    got = leakage.matches(docs, items, "item_id", ["passage", "question"]).collect()
    assert [(x.doc_id, x.item_id, x.longest_run, x.first_word) for x in got] == [(1, 7, 13, 210_000)]


def shared(docs, stretch):
    by_id = {}
    for d, t in docs:
        if d is None:
            continue
        by_id.setdefault(d, []).append(t or "")
    where = {}
    for d, texts in by_id.items():
        for t in texts:
            for i in range(len(t) - stretch + 1):
                where.setdefault(t[i : i + stretch], set()).add(d)
    out = {}
    for d, texts in by_id.items():
        for t in set(texts):
            on = np.zeros(len(t), bool)
            for i in range(len(t) - stretch + 1):
                if len(where[t[i : i + stretch]]) > 1:
                    on[i : i + stretch] = True
            if on.any():
                out[d] = out.get(d, 0) + int(on.sum())
    return out


@pytest.mark.parametrize(("seed", "stretch", "size", "most_bits"), [(1, 40, 16, 28), (2, 40, 4, 28), (3, 21, 16, 28), (4, 60, 7, 28), (1, 40, 16, 2), (3, 21, 16, 2)])
def test_shared_spans_equal_brute_force(spark, seed, stretch, size, most_bits):
    bits = 12 if most_bits == 28 else 21  # else four blocks, not broadcast
    r = random.Random(seed)
    letters = "abc é日\n" if seed % 2 else "ab"
    make = lambda n: "".join(r.choices(letters, k=n))
    pool = [make(r.randint(stretch - 5, 3 * stretch)) for _ in range(12)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(pool)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            parts += [make(r.randint(0, 50)), r.choice([p, p, p[a:b], p[:b], p[a:]])]
        docs.append((d, "".join(parts)))
    docs += [(100, None), (101, ""), (102, "z" * 500), (103, "z" * stretch), (104, "q" * 300), (105, docs[7][1]), (106, pool[0] * 3)]
    if seed > 2:  # rows that repeat an id, with the same and with another text; a row without an id
        docs += [docs[7], (8, docs[9][1] + "!"), (None, docs[10][1])]
    frame = spark.createDataFrame(docs, DOCS).withColumn("start", F.lit("clash"))
    got = {x.doc_id: x.shared_chars for x in spans.shared_characters(frame, stretch, bits=bits, size=size, most_bits=most_bits).collect()}
    assert got == shared(docs, stretch) and len(got) > 20


def test_sketch_collisions_lose_nothing(spark):
    r = random.Random(8)
    make = lambda n: "".join(r.choices("abcdefgh", k=n))
    docs = [(i, make(900)) for i in range(20)] + [(50, "abc" + make(30)), (51, None)]
    docs.append((60, docs[3][1][100:500] + docs[4][1][50:340]))
    frame = spark.createDataFrame(docs, DOCS)
    for bits in (3, 20):
        got = {x.doc_id: x.shared_chars for x in spans.shared_characters(frame, 300, bits=bits).collect()}
        assert got == {3: 400, 60: 400}
    assert spans.shared_characters(frame.limit(0)).count() == 0


def test_shared_spans_of_very_long_texts(spark):
    r = random.Random(5)
    body = "".join(r.choices("abcdefghij ", k=kernels.CHUNK + 5000))
    piece = body[kernels.CHUNK - 200 : kernels.CHUNK + 250]  # across the border of two segments
    docs = [(1, body), (2, "##" + piece + "##"), (3, body[:kernels.CHUNK // 2] + "#" * 10)]
    got = {x.doc_id: x.shared_chars for x in spans.shared_characters(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: 450 + kernels.CHUNK // 2, 2: 450, 3: kernels.CHUNK // 2}


def test_sketch_counts_merge(spark):
    hashes = kernels.mix(np.arange(1000, dtype=np.uint64))
    parts = [list(s.add(h)) + list(s.flush()) for s, h in ((spans._Sketch(16, i), h) for i, h in enumerate((hashes[:600], hashes[500:])))]
    rows = [row for part in parts for batch in part for row in batch.to_pylist()]
    planes = spans._planes(spans._merged(spark.createDataFrame([tuple(x.values()) for x in rows], spans.SKETCH_SCHEMA), 16), 16)
    twice = spans._repeated(hashes, planes, 16)
    assert twice[500:600].all() and twice.sum() < 130  # overestimates, never under


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_sketch_grown_with_its_corpus_drops_what_is_unique(spark, broadcast):
    n, again = 400_000, 20_000
    hashes = kernels.mix(np.arange(n, dtype=np.uint64))
    bits = spans._width(n)
    assert bits > spans._BLOCK_BITS and (1 << bits) >= spans.LOAD * n / 2 and spans._width(10**13) > spans.MOST_BITS  # no cap
    sketches = [(spans._Sketch(bits, part), hashes[: n if part else again]) for part in (0, 1)]
    rows = pa.Table.from_batches([batch for s, h in sketches for batch in (*s.add(h), *s.flush())])
    merged = spans._merged(spark.createDataFrame(rows), bits)
    if broadcast:
        kept = set(np.flatnonzero(spans._repeated(hashes, spans._planes(merged, bits), bits)).tolist())
    else:
        frame = spark.createDataFrame(pa.table({"doc_id": np.arange(n), "hash": hashes.view(np.int64)}))
        kept = {r.doc_id for r in spans.at_blocks(frame, merged, bits).collect()}
    assert kept >= set(range(again)) and len(kept) < again + n // 10
