from __future__ import annotations

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_payload_round_trip(raw):
    payload = media.payload_of(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[: len(raw)] == raw and not any(payload[len(raw) :])
    assert len(payload) - len(raw) < 64 or not raw
    assert media.read_wav(media.write_wav(payload)) == payload


def brute_peaks(x):
    """Frame by frame, bin by bin, with a plain transform."""
    total = max(1, -(-(len(x) - media.FRAME) // media.HOP) + 1)
    part = np.zeros((total + 1) * media.HOP + media.FRAME)
    part[: len(x)] = x.astype(float) - 128
    part[len(x) :] = 0
    level = np.zeros((total + 2, media.FRAME // 2 + 1))
    window = np.hanning(media.FRAME)
    for t in range(total + 1):
        frame = part[t * media.HOP : t * media.HOP + media.FRAME]
        level[t + 1] = np.round(np.abs(np.fft.rfft(frame * window)), 1)
    before = np.zeros(media.FRAME)
    before[media.FRAME - (media.FRAME - media.HOP) :] = part[: media.FRAME - media.HOP]
    level[0] = np.round(np.abs(np.fft.rfft(before * window)), 1)
    out = []
    for t in range(total):
        for lo, hi in media.BANDS:
            k = lo + int(level[t + 1, lo:hi].argmax())
            if level[t + 1, k] > 0 and level[t + 1, k] >= level[t, k] and level[t + 1, k] > level[t + 2, k]:
                out.append((t, k))
    return out


def test_peaks_match_brute_force_and_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(32, 123, 64 * 300).astype(np.uint8)
    whole = media.fingerprints(x)
    t, f = media.peaks(x)
    brute = brute_peaks(x)
    got = list(zip(t.tolist(), f.tolist(), strict=True))
    assert len(set(got) ^ set(brute)) <= 0.02 * len(brute)  # float32 and float64 may round a tie apart
    monkeypatch.setattr(media, "_CHUNK", 7)
    assert (media.fingerprints(x) == whole).all()


def test_a_shifted_excerpt_shares_fingerprints():
    rng = np.random.default_rng(3)
    x = rng.integers(32, 123, media.HOP * 200).astype(np.uint8)
    a, b = media.fingerprints(x), media.fingerprints(x[media.HOP * 50 : media.HOP * 150])
    low = (1 << 24) - 1
    shared = {(int(v) >> 24, int(v) & low) for v in a} & {((int(v) >> 24) + 50, int(v) & low) for v in b}
    assert len(shared) > 0.8 * len(b)


def test_columns(edges, none):
    rows = media.media_columns(edges).collect()
    assert len(rows) == edges.count()
    seen = {}
    for r, (d, text) in zip(sorted(rows, key=str), sorted(((x["doc_id"], x["text"]) for x in edges.collect()), key=str), strict=True):
        assert r["payload_bytes"] % 64 == 0
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for x in [x for x in edges.collect() if x["doc_id"] is not None]:
        r, raw = by_id[x["doc_id"]], (x["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert media.read_wav(r["media"]) == payload
        assert r["n_fingerprints"] == len(r["fingerprints"])
        same = seen.setdefault(x["text"], r)
        assert same["feature"] == r["feature"] and same["media_sha256"] == r["media_sha256"]
    assert media.media_columns(none).count() == 0
    assert "media" not in media.media_columns(edges, with_media=False).columns
