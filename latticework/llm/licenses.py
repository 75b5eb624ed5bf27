"""License scans by conditional compression (operator 2).

All that lies within ``REACH`` words of a hint word, the most a declaration can
have, is cut into candidate blocks of at most ``BLOCK`` words that overlap by
half, so each declaration lies whole in a block, over whatever lines, indents and
comment marks it runs.  The words of a block are compressed with zstandard alone
and with each template as raw dictionary; the reduction in size ranks the templates.
Each is confirmed by the exact differences in wording: all key words (names and versions)
must be there, at most a tenth of the words may be missing or added, and no other
version or name may stand among them.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from latticework.llm.common import picked, raw_texts, slices

# The identifiers that stand in a line of their own in source files, and the licenses they name.
SPDX: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("GPL-3.0", "GPL-3.0"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"), ("GPL-2.0", "GPL-2.0"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"),
    ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1", "LGPL-2.1-or-later"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"),
    ("BSD-3-Clause", "BSD-3-Clause"), ("BSD-2-Clause", "BSD-2-Clause"), ("MPL-2.0", "MPL-2.0"), ("ISC", "ISC"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC0-1.0", "CC0-1.0"), ("Unlicense", "Unlicense"),
)
# License identifiers and the wordings in which texts declare them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
    *((name, f"SPDX-License-Identifier: {said}") for name, said in SPDX),
)
# A declaration holds at least one of these words.
HINTS = (b"licens", b"permission", b"permitted", b"public domain", b"redistribut")
# Words that tell one license from another.
NAMES = frozenset("apache mit gnu lesser affero general bsd 2-clause 3-clause mozilla cc cc0 by by-sa by-nc by-nd by-nc-sa by-nc-nd creative commons attribution attribution-sharealike attribution-noncommercial universal unencumbered".split())

MOST_OFF = 0.1
_WORD = re.compile(r"[^\W_]+(?:[-./][^\W_]+)*")
_HINT = re.compile("|".join(r"[\W_]+".join(h.decode().split()) for h in HINTS), re.IGNORECASE)


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words with their places."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def rejoined(words: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int]]:
    """The words, those of a template that a line feed after a hyphen divides in one again."""
    out: list[tuple[str, int, int]] = []
    for word in words:
        if out and text[out[-1][2]] == "-" and "\n" in (between := text[out[-1][2] + 1 : word[1]]) and not between.split("\n")[0].strip() and f"{out[-1][0]}-{word[0]}" in _hyphened():
            word = (f"{out[-1][0]}-{word[0]}", out.pop()[1], word[2])
        out.append(word)
    return out


def is_key(word: str) -> bool:
    return word in NAMES or any(c.isdigit() for c in word)


@cache
def _compressors() -> tuple[zstandard.ZstdCompressor, tuple[zstandard.ZstdCompressor, ...]]:
    options = {"level": 3, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    with_dictionary = tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for _, t in TEMPLATES)
    return zstandard.ZstdCompressor(**options), with_dictionary


@cache
def _template_words() -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(w for w, _, _ in words_of(t)) for _, t in TEMPLATES)


@cache
def _hyphened() -> frozenset[str]:
    """The hyphened words of the templates, and what a line feed after a later hyphen leaves of them."""
    parts = [w.split("-") for words in _template_words() for w in words]
    return frozenset("-".join(p[:n]) for p in parts for n in range(2, len(p) + 1))


REACH = int(max(map(len, _template_words())) * (1 + MOST_OFF))
BLOCK = 2 * REACH  # words
_LONGEST = max(len(w) for words in _template_words() for w in words)


def ranked(block: bytes) -> list[tuple[float, int]]:
    """(reduction, template) of all templates for the lower-case block, the best first: the bytes a
    template saves, as a share of what the shorter of both takes by itself.  No least reduction is
    asked for: among much other text an exact wording may save next to nothing."""
    alone, each = _compressors()
    plain = len(alone.compress(block))
    found = []
    for i, c in enumerate(each):
        saved = plain - len(c.compress(block))
        found.append((saved / min(plain, len(TEMPLATES[i][1])), i))
    return sorted(found, key=lambda f: (-f[0], f[1]))


def differences(template: int, words: list[tuple[str, int, int]]) -> tuple[int, int, list[str], list[str]] | None:
    """(first word, end word, missing, added) of the template's best place among ``words``; None if it isn't confirmed."""
    wanted, said = _template_words()[template], [w for w, _, _ in words]
    most = int(MOST_OFF * len(wanted))
    there = set(said)
    absent = [w for w in wanted if w not in there]
    if len(absent) > most or any(map(is_key, absent)):
        return None
    # so few differences leave a run of so many words at least
    least = -(-(len(wanted) - most) // (most + 1))
    parts = [(0, len(said))]
    while parts:
        low, high = parts.pop()
        if high - low < len(wanted) - most:
            continue
        blocks = [b for b in SequenceMatcher(None, wanted, said[low:high], autojunk=False).get_matching_blocks() if b.size]
        if not blocks:
            continue
        # the longest run anchors the place; runs further off than the template is long belong to other text
        anchor = max(blocks, key=lambda b: (b.size, -b.b))
        if anchor.size < least:
            continue
        near = [b for b in blocks if abs((b.b - b.a) - (anchor.b - anchor.a)) <= max(2, len(wanted) // 10)]
        first, end = low + near[0].b, low + near[-1].b + near[-1].size
        hit = {b.a + k for b in near for k in range(b.size)}
        kept = {low + b.b + k for b in near for k in range(b.size)}
        missing = [w for k, w in enumerate(wanted) if k not in hit]
        added = [said[k] for k in range(first, end) if k not in kept]
        if not (any(map(is_key, missing)) or any(map(is_key, added)) or len(missing) + len(added) > MOST_OFF * len(wanted)):
            return first, end, missing, added
        # a wording refused at one place may stand before or after it
        parts += [(low + anchor.b + anchor.size, high), (low, low + anchor.b)]
    return None


def _start(text: str, place: int) -> int:
    """Where the ``REACH`` whole words before the word at ``place`` begin."""
    size = 8 * REACH
    while True:
        begin = max(0, place - size)
        starts = [m.start() for m in _WORD.finditer(text, begin, place)]
        if len(starts) > REACH + 1:  # the first may be cut
            return starts[-REACH - 1]
        if not begin:
            return 0
        size *= 2


def candidate_blocks(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """The words, with their places, of the blocks to compare: all within ``REACH`` words of a hint."""
    hints = [m.start() for m in _HINT.finditer(text)]
    at = 0
    while at < len(hints):
        block: list[tuple[str, int, int]] = []
        since = -REACH
        for m in _WORD.finditer(text, _start(text, hints[at])):
            if len(block) == BLOCK:
                yield block
                block = block[REACH:]
            block.append((m[0].lower(), m.start(), m.end()))
            since += 1
            while at < len(hints) and hints[at] < m.end():
                at, since = at + 1, 0
            if since == REACH:
                break
        yield block


def scan_text(raw: bytes | None) -> list[tuple[int, int, str, float, str, str]]:
    """(start, end, license, reduction, missing, added) of each declaration in one whole
    text, by place; start and end in code points. Of overlapping ones the better stays."""
    found = []
    low = (raw or b"").lower()
    text = raw.decode("utf-8", "ignore") if any(h.split()[-1] in low for h in HINTS) else ""
    for block in candidate_blocks(text):
        words = rejoined(block, text)
        taken: list[tuple[int, int]] = []
        again = True
        while again:  # a block may hold several declarations: each is cut out before the next is ranked
            again = False
            open_ = [w for w in words if all(w[2] <= a or b <= w[1] for a, b in taken)]
            # longer words are in no template, so their beginnings do for the ranking
            shown = " ".join(w[: _LONGEST + 1] for w, _, _ in open_).encode()
            ranks = ranked(shown) if any(h in shown for h in HINTS) else []
            close = [(d, gain, t) for gain, t in ranks if (d := differences(t, open_))]
            if close:
                (first, end, missing, added), gain, t = min(close, key=lambda c: (len(c[0][2]) + len(c[0][3]), c[0][0] - c[0][1], -c[1]))
                a, b = open_[first][1], open_[end - 1][2]
                taken.append((a, b))
                found.append((a, b, TEMPLATES[t][0], round(gain, 6), " ".join(missing), " ".join(added)))
                again = True
    kept: list[tuple] = []  # by place, so a new one need only be held against its neighbours
    for f in sorted(set(found), key=lambda f: (len(f[4]) + len(f[5]), f[0] - f[1], f[0])):
        at = bisect(kept, f)
        if (not at or kept[at - 1][1] <= f[0]) and (at == len(kept) or f[1] <= kept[at][0]):
            kept.insert(at, f)
    return kept


_SCHEMA = "doc_id long, start long, end long, license string, reduction double, missing string, added string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = [(doc, *f) for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True) for f in scan_text(raw)]
        if rows:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [p.split()[0] for p in _SCHEMA.split(", ")])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each license declaration in each row of ``docs``: doc_id, start, end
    (code points), license, reduction, missing and added words.

    Null, empty and undeclared texts have no rows; rows with equal or null doc_ids
    are scanned each; equal texts have equal declarations.  Other columns are ignored.
    """
    return picked(docs, doc_id=(doc_id, "long"), text=(text, "string")).mapInArrow(_run, _SCHEMA)
