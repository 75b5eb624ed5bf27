from __future__ import annotations

import random
import textwrap
import time

import pytest

from latticework.llm.licenses import BLOCK, TEMPLATES, ranked, scan_licenses, scan_text


@pytest.mark.parametrize(("name", "wording"), TEMPLATES)
def test_every_template_is_found_in_place(name, wording):
    before = "Ein Wört über alles. "
    for text in (f"{before}{wording} And more text follows here.\nx", f"{before * 90}{wording}", wording.upper()):
        found = scan_text(text.encode())
        assert [f[2] for f in found] == [name]
        start, end = found[0][:2]
        assert text[start:end].rstrip(".:").lower() == wording.rstrip(".:").lower()
        assert found[0][4:] == ("", "")


@pytest.mark.parametrize(("name", "wording"), TEMPLATES)
def test_every_template_is_found_over_lines(name, wording):
    for width, mark, feed in ((70, "", "\n"), (70, " * ", "\n"), (70, "# ", "\r\n"), (70, "// ", "\n"), (30, " " * 40, "\n"), (1, "", "\n")):
        said = feed.join(mark + line for line in textwrap.wrap(wording, width, break_long_words=False))
        for before, after in (("", ""), ("Ein Wört über alles.\n" * 90, "\nAnd more text follows here.\n" * 90)):
            text = f"{before}{said}{after}"
            found = scan_text(text.encode())
            assert [f[2] for f in found] == [name]
            start, end = found[0][:2]
            assert text[start:end].rstrip(".:") == said[len(mark) :].rstrip(".:")
            assert found[0][4:] == ("", "")


def test_a_wording_among_much_other_text_is_found():
    before = "Oned " * 90 + "\nAnreti the atshin torestouti heshly nteaha erwhst the. A was.\n"
    for wording in ("Licensed under CC BY-NC 4.0.", "Released under the MIT License."):
        assert [f[0] for f in scan_text((before + wording).encode())] == [len(before)]


def test_a_refused_wording_does_not_hide_a_changed_one():
    first, second = TEMPLATES[8][1].replace("version 2", "version 1"), TEMPLATES[8][1].replace("modify", "change")
    text = f"{first}\n{second}"
    (found,) = scan_text(text.encode())
    assert found[2] == "GPL-2.0" and found[4:] == ("modify", "change") and found[0] == len(first) + 1


def test_dense_and_far_hints_leave_no_gap():
    rng = random.Random(3)
    said, places, at = [], [], 0
    for n in range(300):
        name, wording = rng.choice(TEMPLATES)
        between = " ".join(rng.choice(("licensed", "word", "z" * 3000, "ü-x", "-- \n#")) for _ in range(rng.choice((3, 30, 200)))) + "\n"
        at += len(between)
        places.append((at, at + len(wording.rstrip(".:")), name))
        said += [between, wording, "\n"]
        at += len(wording) + 1
    assert [f[:3] for f in scan_text("".join(said).encode())] == places


def test_other_versions_and_names_are_not_confirmed():
    for said in ("This work is licensed under the GNU General Public License, version 1.", "Licensed under CC BY-NC 3.0.", "Licensed drivers only.", "Released under the moon.", "A permission slip."):
        assert scan_text(said.encode()) == []


def test_every_ranked_template_is_tried():
    for other in ("This work is licensed under the GNU General Public License, version 1.", "Licensed under CC BY-NC 3.0. Licensed under CC BY-NC-SA 3.0."):
        for name, wording in (("MIT", "Released under the MIT License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.")):
            assert [f[2] for f in scan_text(f"{other} {wording}".encode())] == [name]


def test_identifiers_in_source_files():
    text = "#!/bin/sh\n# SPDX-License-Identifier: GPL-3.0-or-later\n/* SPDX-License-Identifier: MIT */\n# SPDX-License-Identifier: ISC\n# SPDX-License-Identifier: Other-1.0\n"
    assert [(f[2], text[f[0] : f[1]]) for f in scan_text(text.encode())] == [("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"), ("MIT", "SPDX-License-Identifier: MIT"), ("ISC", "SPDX-License-Identifier: ISC")]


def test_long_texts_take_linear_time():
    """Eight times the text takes no more than some ten times as long, whether or not it declares licenses in one line."""
    for part in ("licensed drivers may license ", "Released under the MIT License. filler words follow here and there "):
        took = []
        for n in (250, 2000):
            began = time.process_time()
            scan_text((part * n).encode())
            took.append(time.process_time() - began)
        assert took[1] < 14 * took[0] + 0.2
    began = time.process_time()
    assert scan_text(("words and lines\n" * 625_000 + "Released under the MIT License.").encode())[0][2] == "MIT"
    assert time.process_time() - began < 10  # ten million bytes


def test_small_changes_are_told():
    text = TEMPLATES[4][1].replace("hereby", "kindly")
    (found,) = scan_text(text.encode())
    assert found[2] == "MIT" and found[4:] == ("hereby", "kindly")


def test_several_declarations_in_one_line_and_block_ends():
    line = "Licensed under CC BY 4.0. " + "filler words here " * 60 + "Released under the MIT License. " + "more words " * 200 + "Licensed under the Apache License, Version 2.0."
    assert len(line) > 2 * BLOCK
    assert [f[2] for f in scan_text(line.encode())] == ["CC-BY-4.0", "MIT", "Apache-2.0"]


def test_reduction_ranks_the_right_template_first():
    for i, (_, wording) in enumerate(TEMPLATES):
        assert ranked(wording.lower().encode())[0][1] == i


def test_brute_force_over_documents(spark, sf):
    """Every planted wording is found, at its place, and nothing else."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = set()
    for r in docs.collect():
        for name, wording in TEMPLATES:
            at = r["text"].find(wording)
            while at >= 0:
                want.add((r["doc_id"], at, at + len(wording.rstrip(".:")), name))
                at = r["text"].find(wording, at + 1)
    got = {(r["doc_id"], r["start"], r["end"], r["license"]) for r in scan_licenses(docs).collect()}
    assert got == want and want


def test_edges(edges, none):
    got = scan_licenses(edges).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(15, "MIT")]
    assert scan_licenses(none).count() == 0
