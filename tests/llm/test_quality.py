from __future__ import annotations

import zlib

import numpy as np

from latticework.llm.common import picked
from latticework.llm import quality


def brute_scores(net, raw):
    """Filters slid one place at a time over each chunk of the padded text."""
    data = np.frombuffer(raw + bytes(quality.WIDTH), np.uint8)
    n = max(len(raw), 1)
    segments = -(-n // quality.SEGMENT)
    places = [(k * quality.SEGMENT, (k + 1) * quality.SEGMENT if k < segments - 1 else len(raw) + 1) for k in range(segments)]
    pad = np.concatenate([data, np.zeros(quality.WIDTH, np.uint8)])
    act = lambda t: np.einsum("we,wef->f", net.embed[pad[t : t + quality.WIDTH]], net.filters)
    top = [np.max([act(t) for t in range(a, b)], axis=0) for a, b in places]
    chunks = [np.maximum(x, y) for x, y in zip(top[:-1], top[1:], strict=True)] or [top[0]]
    x = np.concatenate([np.max(chunks, axis=0), np.min(chunks, axis=0), np.mean(chunks, axis=0)])
    hidden = np.tanh(x @ net.hidden + net.hidden_bias)
    return float((1 / (1 + np.exp(-(hidden @ net.out + net.out_bias))))[0])


def test_scores_match_brute_force_alone_and_together():
    net = quality.Network.fresh(1)
    rng = np.random.default_rng(0)
    raws = [b"", b"a", b"abc" * 50, bytes(rng.integers(32, 127, 1000).astype(np.uint8)), bytes(rng.integers(0, 256, 129).astype(np.uint8)), b"x" * 128]
    together = quality.scores(net, raws)
    for raw, s in zip(raws, together, strict=True):
        assert abs(quality.scores(net, [raw])[0] - s) < 1e-5
        assert abs(brute_scores(net, raw) - s) < 1e-3, raw[:20]


def test_gradients_match_differences():
    net = quality.Network.fresh(3)
    raws = [b"hello there, some words " * 20, b"ZZZ!! QQQ!! " * 30, b"k"]
    wanted = np.array([1, 0, 1], np.float32)

    def loss():
        p = quality.scores(net, raws)
        return float(-(wanted * np.log(p) + (1 - wanted) * np.log(1 - p)).mean())

    grads = quality._gradients(net, raws, wanted)
    rng = np.random.default_rng(1)
    for w, g in zip(net.weights(), grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape) if rng.random() < 0.5 else np.unravel_index(np.abs(g).argmax(), g.shape)
            old, step = w[at], 1e-2
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3 + 0.1 * abs(g[at])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.score_texts(docs, quality.fit(docs, labels)).collect()}
    known = [(r["doc_id"], r["quality"]) for r in labels.collect()]
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    unseen = [rows[d]["predicted"] == q for d, q in known if rows[d]["held_out"]]
    assert len(unseen) > 50 and np.mean(unseen) > 0.95


def test_held_out_labels_do_not_matter(spark):
    texts = [(i, ("good words here " if i % 2 else "BAD!! JUNK!! ") * 8) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    held = {i for i in range(40) if zlib.crc32(str(i).encode()) % 3 == 1}
    make = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and i in held), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    a, b = (quality.fit(docs, make(f)) for f in (False, True))
    assert all((x == y).all() for x, y in zip(a.weights(), b.weights(), strict=True))


def test_edges(spark, edges, none):
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 5)], "doc_id long, quality int")
    net = quality.fit(edges, labels)
    assert net is None
    got = quality.score_texts(edges, net).collect()
    assert len(got) == edges.count() and {r["score"] for r in got} == {0.5} and {r["predicted"] for r in got} == {1}
    assert quality.score_texts(none, net).count() == 0
    fresh = quality.Network.fresh(1)
    by_text = {}
    for r in quality.score_texts(edges, fresh).join(picked(edges, doc_id=("doc_id", None), text=("text", None)), "doc_id").collect():
        assert abs(by_text.setdefault(r["text"], r["score"]) - r["score"]) < 1e-6
    kept = quality.keep_good(edges, fresh)
    assert kept.columns == edges.columns and kept.count() <= edges.count()
    assert quality.fit(none, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_what_reaches_the_driver_is_bounded(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(quality, "train", lambda raws, labels: learned.extend(zip(raws, labels.tolist(), strict=True)))
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 50)
    docs = spark.createDataFrame([(i, "é" * (30 if i % 3 == 0 else 20)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    quality.fit(docs, labels, rows=20)
    assert sorted(q for _, q in learned) == [0] * 10 + [1] * 10 and all(len(raw) == 40 for raw, _ in learned)
