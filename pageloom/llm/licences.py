"""License scans by conditional compression.

A sentence that speaks of rights, be it wrapped over several lines, is a candidate block. It is compressed alone and with
each template as a raw zstandard dictionary, and the templates are ranked by the share of their own length that they
save. Every template that saves enough is confirmed by its exact wording: its telling words (all but FILLER: names,
versions, clauses) stand in the block exactly and in a row, few of its other words differ, and no word before the notice
denies it. Of several templates of one license the one of fewest differences is reported, with these.

Defined results: a null or empty text gives no row; texts of any length are scanned whole, in windows that overlap by more
than the longest template; ties go to the first license by name; repeated rows are scanned each, and equal blocks get
equal verdicts; an empty table gives an empty table; only the id and text columns are read, so extra columns of any name
do not clash.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices and sentences of license texts by SPDX identifier, shortest first.
NOTICES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-2-Clause OR BSD-3-Clause": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": [
        "This work is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty."],
}
#: The parts that Creative Commons licenses are named by.
_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}


def _templates() -> dict[str, list[str]]:
    """NOTICES, the Creative Commons notices by rule, and the SPDX tag of each license."""
    out = {k: list(v) for k, v in NOTICES.items()}
    for parts in (["BY"], ["BY", "SA"], ["BY", "ND"], ["BY", "NC"], ["BY", "NC", "SA"], ["BY", "NC", "ND"]):
        for version, kind in (("3.0", "Unported"), ("4.0", "International")):
            name = "-".join(parts)
            out[f"CC-{name}-{version}"] = [f"Licensed under CC {name} {version}.", f"This work is licensed under a Creative Commons {'-'.join(map(_PARTS.get, parts))} {version} {kind} License."]
    for name, of in out.items():
        if " " not in name and name != "Proprietary":
            of.append(f"SPDX-License-Identifier: {name}")
    return dict(sorted(out.items()))


TEMPLATES = _templates()
_MARK = r"[\s#*/;%-]"
#: What a sentence must have to speak of rights, for Python and for Java alike.
RIGHTS = rf"licen[sc]e|copyright|all{_MARK}+rights{_MARK}+reserved|public{_MARK}+domain|spdx|permission|redistribut|free{_MARK}+software|as-is|CC{_MARK}*(?:BY|0)"
SPEAKS = re.compile(RIGHTS, re.I)
_SENTENCE = re.compile(r"(?<=[.!?])(?<!\b[vV]\.)\s+(?=\S)")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_WORD = re.compile(r"\w+(?:[.-]\w+)*")
#: A confirmed template saves at least this share of its length; at most this share of its words differ.
SAVING, WORDING = 0.3, 0.25
#: Words that do not tell licenses apart (all others of a template must stand as they are), and words that,
#: up to DENIAL words before a notice, deny it.
FILLER = frozenset("a an and as dedicated distributed is licence licensed licenced license of released subject terms the this to under version work".split())
DENIES = frozenset("cannot except excluding isn neither never no non nor not than unlike without".split())
DENIAL = 4
#: Characters of a word at most when a window's end is moved to the end of a word.
WORD = 40
#: Longer sentences are scanned in windows of so many times the longest template, which overlap by all but once that.
WINDOW = 3


def blocks(text: str, longest: int) -> Iterator[tuple[int, str]]:
    """(start, block) of the sentences that speak of rights; a sentence goes on over single newlines."""
    at = 0
    for gap in [*((m.start(), m.end()) for m in _BLANK.finditer(text)), (len(text), len(text))]:
        passage = text[at : gap[0]]
        if SPEAKS.search(passage):
            start = 0
            for end in [*(m.start() for m in _SENTENCE.finditer(passage)), len(passage)]:
                part = passage[start:end]
                if SPEAKS.search(part):
                    for k in range(0, max(1, len(part) - (WINDOW - 1) * longest), longest):
                        low, high = _whole_words(part, k, k + WINDOW * longest)
                        piece = part[low:high]
                        if SPEAKS.search(piece):
                            lead = len(piece) - len(piece.lstrip())
                            yield at + start + low + lead, piece.strip()
                start = end
        at = gap[1]


def _whole_words(part: str, low: int, high: int) -> tuple[int, int]:
    """The window, widened to whole words (of up to WORD characters), so that no cut makes another version of one."""
    for _ in range(WORD):
        low -= 0 < low and not part[low - 1].isspace()
        high += high < len(part) and not part[high].isspace()
    return low, high


class Scanner:
    """Verdicts on blocks, given templates by license."""

    def __init__(self, templates: dict[str, list[str]]):
        import zstandard as z

        plain = {"level": 19, "write_content_size": False, "write_checksum": False}
        self.alone = z.ZstdCompressor(**plain)
        self.given = []
        for name, texts in sorted(templates.items()):
            for t in texts:
                raw = z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(level=plain["level"])
                self.given.append((name, _WORD.findall(t.lower()), len(t.encode()), z.ZstdCompressor(dict_data=raw, **plain)))
        self.longest = max((len(t) for texts in templates.values() for t in texts), default=1)
        self.known: dict[str, list] = {}

    def scan(self, block: str) -> list[tuple]:
        """(license, saving, rank, number of differences, differences, confirmed) of each confirmed license, or of the
        best one if none is; the rank is the license's place by saving."""
        if block in self.known:
            return self.known[block]
        raw = block.encode()
        alone, own = len(self.alone.compress(raw)), _WORD.findall(block.lower())
        tells = [k for k, w in enumerate(own) if w not in FILLER]
        best: dict[str, tuple] = {}
        for name, want, size, c in self.given:
            saving = round((alone - len(c.compress(raw))) / size, 6)
            found = _confirmed(want, own, tells) if saving >= SAVING else None
            ok = found is not None and len(found) <= WORDING * len(want)
            entry = (ok, -len(found) if ok else 0, saving, found, want)
            if name not in best or entry[:3] > best[name][:3]:
                best[name] = entry
        ranked = sorted(best, key=lambda n: (-best[n][2], n))
        got = [(n, best[n][2], k, len(best[n][3]), best[n][3], True) for k, n in enumerate(ranked, 1) if best[n][0]]
        if not got:
            differ = _differences(best[ranked[0]][4], own)
            got = [(ranked[0], best[ranked[0]][2], 1, len(differ), differ, False)]
        if len(self.known) > 10_000:
            self.known.clear()
        self.known[block] = got
        return got


def _confirmed(want: list[str], own: list[str], tells: list[int]) -> list[str] | None:
    """The fewest differences where the template's telling words stand, exactly and in a row, and nothing denies them."""
    at = [k for k, w in enumerate(want) if w not in FILLER] or list(range(len(want)))
    places = tells if any(w not in FILLER for w in want) else list(range(len(own)))
    found = []
    for k in range(len(places) - len(at) + 1):
        if all(own[places[k + j]] == want[at[j]] for j in range(len(at))):
            first, last = places[k], places[k + len(at) - 1]
            before = max(0, first - at[0])
            if DENIES.isdisjoint(own[max(0, before - DENIAL) : before]) and DENIES.isdisjoint(set(own[before:first]) - set(want)):
                found.append(_differences(want, own[max(0, before - 2) : last + len(want) - at[-1] + 2]))
    return min(found, key=len, default=None)


def _differences(want: list[str], own: list[str]) -> list[str]:
    """-word and +word of what a notice lacks and has beside the template."""
    out: list[str] = []
    ops = difflib.SequenceMatcher(None, want, own, autojunk=False).get_opcodes()
    for k, (kind, a, b, c, d) in enumerate(ops):
        # words before and after the notice are other wording of the sentence, not of the notice
        if kind == "equal" or (kind == "insert" and k in (0, len(ops) - 1)):
            continue
        more = own[c:d] if 0 < a and b < len(want) else []
        pairs = max(b - a, len(more))
        out += [f"-{want[a + j]}" if j < b - a and j >= len(more) else f"-{want[a + j]}+{more[j]}" if j < b - a else f"+{more[j]}" for j in range(pairs)]
    return out


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate block and license confirmed in it, or one for the best license if none is: id, start, block,
    license, saving, rank, n_differ, differences, confirmed."""
    source = docs.select(id_col, text_col).where(F.col(text_col).rlike(f"(?iU){RIGHTS}"))
    given = templates or TEMPLATES
    names = [id_col, "start", "block", "license", "saving", "rank", "n_differ", "differences", "confirmed"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given)
        for b in batches:
            at, rows = [], []
            for k, t in enumerate(b.column(1)):
                for start, block in blocks(t.as_py(), scanner.longest):
                    for verdict in scanner.scan(block):
                        at.append(k)
                        rows.append((start, block, *verdict))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, start long, block string, license string, saving double, rank long, n_differ long, differences array<string>, confirmed boolean")
