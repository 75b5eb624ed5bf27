"""Personal data in whole texts (operator 10): exact base rules, and a tagger that adds spans.

The base rules find e-mail addresses, IP addresses, card and phone numbers.  The
tagger (``tagger.py``) reads overlapping windows; each window is decoded by itself
and the windows are reconciled over the whole document: a span must lie inside a
window with room on both sides, of overlapping spans the one nearest its window's
middle wins, and what overlaps a base span is left out.  The tagger finds forms that
no base rule has (bare phone numbers, cards with other marks, addresses in disguise)
and a kind of its own, secrets such as keys and tokens.  A span that it adds must have
its kind's outer form, and with it an ``@`` or at least four digits.
A window with neither can therefore add nothing and isn't decoded; ``every_window``
decodes them all and finds the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from latticework.llm.common import number_of, numbered, picked, raw_texts, slices
from latticework.llm.tagger import KINDS, STRIDE, WINDOW, Tagger, classes, code_points, luhn, tag_spans, trained

BASE_KINDS = 4
Span = tuple[int, int, int]  # kind, start, end in code points

_SEED = re.compile(rb"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run of digits is tried from its first digit only: what fails there fails further in
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARGIN = 4  # places kept free between an added span and its window's ends


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each ``@`` so that long runs cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The base rules' spans, by kind, then start."""
    spans: list[Span] = [(0, a, b) for a, b in _emails(text)]
    spans += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    spans += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


_ADDED = (
    re.compile(r"[A-Za-z0-9._%+-]+ ?\[?@\]? ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}"),
    re.compile(r"[0-9]{4}([./ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([./ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19}"),
    re.compile(r"\+?[0-9]{0,3}[ -]?\(?[0-9]{2,4}\)?[ ./-]{1,3}[0-9]{3}[ ./-]?[0-9]{3,4}"),
    re.compile(r"[A-Za-z0-9_-]{16,80}"),
)


def sound(kind: int, said: str) -> bool:
    """Whether an added span has its kind's form."""
    if not _ADDED[kind].fullmatch(said):
        return False
    digits = _digits(said)
    if kind == 1:
        return all(_small(p.strip()) for p in said.split("."))
    if kind == 2:
        return luhn(digits)
    if kind == 4:
        return len(digits) >= 4 and any(c.isalpha() for c in said)
    return kind == 0 or 9 <= len(digits) <= 15


def windows_of(points: np.ndarray, every: bool) -> np.ndarray:
    """Starts of the windows that cover a text; without ``every``, of those that can add a span."""
    starts = np.arange(0, max(1, len(points) - WINDOW + STRIDE), STRIDE)
    if every:
        return starts
    count = lambda hit: np.concatenate(([0], np.cumsum(hit)))
    ends = np.minimum(starts + WINDOW, len(points))
    ats, digits = count(points == 64), count((points >= 48) & (points <= 57))
    return starts[(ats[ends] > ats[starts]) | (digits[ends] - digits[starts] >= 4)]


def added_spans(texts: list[str], bases: list[list[Span]], net: Tagger, every_window: bool = False) -> list[list[Span]]:
    """What the tagger adds to each text's base spans."""
    found: list[dict[Span, float]] = [{} for _ in texts]
    places, rows = [], []
    for i, text in enumerate(texts):
        if not text or not (every_window or any(c in text for c in "@0123456789")):
            continue
        points = code_points(text)
        seen = np.concatenate([classes(points), np.zeros(WINDOW, np.uint8)])
        for start in windows_of(points, every_window).tolist():
            places.append((i, start))
            rows.append(seen[start : start + WINDOW])
    for at in range(0, len(rows), 1024):
        for (i, start), tags in zip(places[at : at + 1024], net.tags(np.stack(rows[at : at + 1024])), strict=True):
            size = len(texts[i])
            for kind, a, b in tag_spans(tags):
                inside = (a >= _MARGIN or start == 0) and (b <= WINDOW - _MARGIN or start + WINDOW >= size)
                span = (kind, start + a, min(start + b, size))
                if inside and sound(kind, texts[i][span[1] : span[2]]):
                    off = abs((a + b) / 2 - WINDOW / 2)
                    found[i][span] = min(off, found[i].get(span, np.inf))
    out = []
    for base, some in zip(bases, found, strict=True):
        kept: list[Span] = []
        for span in sorted(some, key=lambda s: (some[s], s[1] - s[2], s)):
            if all(span[2] <= a or b <= span[1] for _, a, b in [*base, *kept]):
                kept.append(span)
        out.append(kept)
    return out


def find_spans(texts: list[str], net: Tagger, every_window: bool = False) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each whole text."""
    bases = [base_spans(t) for t in texts]
    return list(zip(bases, added_spans(texts, bases, net, every_window), strict=True))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _texts_and_spans(raws: list[bytes | None], net: Tagger, every: bool) -> Iterator[tuple[str | None, list[Span], list[Span]]]:
    maybe = [every or (raw is not None and _SEED.search(raw) is not None) for raw in raws]
    texts = [raw.decode("utf-8", "replace") if raw and m else "" for raw, m in zip(raws, maybe, strict=True)]
    for m, text, (base, more) in zip(maybe, texts, find_spans(texts, net, every), strict=True):
        yield (text if m else None), base, more


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every_window: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts of the base rules' spans by kind,
    base_sha256, spans (base and added), n_added, n_spans (base and added).

    A null text counts as empty and has no spans; a null doc_id stays null; equal
    texts have equal spans.  Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for _, base, more in _texts_and_spans(raw_texts(batch.column("text")), shared.value, every_window):
                counts = [sum(k == kind for k, _, _ in base) for kind in range(BASE_KINDS)]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more), len(base) + len(more)))
            arrays = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], [p.split()[0] for p in _SCHEMA.split(", ")])

    return picked(docs, doc_id=(doc_id, "long"), text=(text, "string")).mapInArrow(run, _SCHEMA)


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind's name in brackets."""
    out, done, at = [], 0, 0
    ordered = sorted(spans, key=lambda s: (s[1], -s[2], s[0]))
    while at < len(ordered):
        kind, a, b = ordered[at]
        at += 1
        while at < len(ordered) and ordered[at][1] < b:
            b = max(b, ordered[at][2])
            at += 1
        out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; every other column, whatever its name, and null texts stay as they are."""
    plain, at = numbered(docs), number_of(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            column = batch.column(at)
            changed = {}
            for i, (said, base, more) in enumerate(_texts_and_spans(raw_texts(column), shared.value, False)):
                if base or more:
                    changed[i] = redact_text(said, base + more)
            if changed:
                column = pa.array([changed.get(i, v) for i, v in enumerate(column.to_pylist())], column.type)
            yield pa.RecordBatch.from_arrays([column if n == at else batch.column(k) for k, n in enumerate(batch.schema.names)], batch.schema.names)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
