"""License scans by conditional compression.

Candidate blocks are windows of ``AROUND`` characters about the words that
license notices share (``CUES``) and about the family names of licenses
(``FAMILIES``). Templates that a block can hold, by the words it has, are each
given to zstandard as a raw-content dictionary; the block is compressed alone
and with each, and they are ranked by how many bytes they save. Winners are
confirmed by the exact wording: the word edits that turn the template into a
stretch of the block must not be over ``EDITS`` of its words (one at least, from
``SHORT`` words on), and none may touch a word of ``DECIDING``, those that tell
licenses apart (families, versions, clauses), in the template or in the text. Of
confirmed stretches that overlap only the one with the least edits counts, the
longer one among equals. Every window of a text is scanned.

Besides the notices of ``TEMPLATES`` each name of ``NAMES`` is looked for in the
``FRAMES`` by which a text grants it, reported as ``<license>-named``.

Versions are one word, without a final .0 (2.0 is 2, GPLv3 is gpl 3). The
names of an SPDX expression are a word each, and each follows the tag anew.

Edge cases: null and empty texts have no block; a notice twice in a text counts
once in licenses and twice in n_confirmed, also where blocks overlap, in which
one notice counts once; ties of saved bytes go to the name; repeated rows get
equal results; a very long text is scanned window by window.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import by_batch, only

CUES = ("licen", "copyright", "permission is hereby", "redistribut", "spdx", "warrant", "public domain", "creative commons", "cc0")
#: Names of families that stand for a license without such a word; MIT notices always have one.
FAMILIES = ("apache", "bsd", "isc", "mozilla", "mpl", "gnu", "gpl", "lgpl", "agpl", "cc0", "cc", "artistic", "eclipse", "epl", "boost", "unlicense", "attribution")
AROUND, EDITS, SHORT, LEVEL = 400, 0.15, 5, 3

#: Short public notices by which licenses are named or granted.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Artistic-2.0": "Licensed under the Artistic License 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0": "This work is licensed under CC0 1.0.",
    "CC0-1.0-long": "This work is dedicated to the public domain under Creative Commons Zero 1.0 Universal.",
    "EPL-1.0": "Licensed under the Eclipse Public License 1.0.",
    "EPL-2.0": "Licensed under the Eclipse Public License 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "ISC-name": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-name": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0-short": "Licensed under the Mozilla License, Version 2.0.",
}

_CLAUSES = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _k, _long in _CLAUSES.items():
    for _v, _kind in (("4.0", "International"), ("3.0", "Unported")):
        for _name, _text in ((f"CC-{_k}-{_v}-long", f"This work is licensed under a Creative Commons {_long} {_v} {_kind} License."), (f"CC-{_k}-{_v}-short", f"Licensed under CC {_k} {_v}.")):
            if _text not in TEMPLATES.values():
                TEMPLATES[_name if _name.rsplit("-", 1)[0] in TEMPLATES else _name.rsplit("-", 1)[0]] = _text

#: Names of the SPDX list that a tag may give.
SPDX = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0
CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2
GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only
LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 PSF-2.0 Python-2.0 Unlicense WTFPL Zlib""".split()
TEMPLATES |= {f"{k}-spdx": f"SPDX-License-Identifier: {k}" for k in SPDX}

#: Short names of licenses, without their articles.
NAMES = {
    "AGPL-3.0": ("AGPL v3", "GNU AGPL v3", "GNU Affero General Public License v3"),
    "Apache-2.0": ("Apache 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License, Version 2.0", "Apache Software License 2.0"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD": ("BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "BSL-1.0": ("Boost Software License 1.0",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"),
    "EPL-1.0": ("EPL 1.0", "Eclipse Public License 1.0"),
    "EPL-2.0": ("EPL 2.0", "Eclipse Public License 2.0"),
    "GPL-2.0": ("GPL v2", "GNU GPL v2", "GNU GPL version 2", "GNU General Public License v2", "GNU General Public License version 2", "GPL 2.0 License"),
    "GPL-3.0": ("GPL v3", "GNU GPL v3", "GNU GPL version 3", "GNU General Public License v3", "GNU General Public License version 3", "GPL 3.0 License"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("LGPL v2.1", "GNU LGPL v2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("LGPL v3", "GNU LGPL v3", "GNU Lesser General Public License v3"),
    "MIT": ("MIT License", "MIT Software License"),
    "MPL-2.0": ("MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0"),
    "Unlicense": ("Unlicense",),
}
for _k, _long in _CLAUSES.items():
    for _v in ("4.0", "3.0"):
        NAMES[f"CC-{_k}-{_v}"] = (f"CC {_k} {_v}", f"CC {_k} {_v} License", f"Creative Commons {_long} {_v}", f"Creative Commons {_long} {_v} License")
#: How a text grants or names one.
FRAMES = ("licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "distributed under the {}", "available under the {}", "provided under the {}", "published under the {}", "under the terms of the {}", "under the {} or later", "uses the {}", "covered by the {}", "license: {}")

#: Words that tell licenses apart, besides versions and the names of SPDX tags.
DECIDING = frozenset("apache mit bsd isc mozilla mpl gnu gpl lgpl agpl general lesser library affero creative commons cc cc0 zero attribution sharealike noncommercial noderivatives noderivs by nc sa nd share alike non commercial derivatives artistic boost eclipse epl unlicense clause only".split())

_TAG = re.compile(r"spdx-license-identifier:[ \t]*([(]*[\w.+-]+[)]*(?:[ \t]+(?:or|and|with)[ \t]+[(]*[\w.+-]+[)]*)*)")
_NAME = re.compile(r"[\w+-]+(?:\.[\w+-]+)*")
_WORD = re.compile(r"\d+(?:\.\d+)*(?![^\W\d_])|[^\W_]+")
_VERSION = re.compile(r"\d+(?:\.\d+)*")
_GLUED = re.compile(r"(v|l?gpl|agpl|mpl|epl)v?(\d)(?![^\W\d_])")


def words(text: str) -> list[str]:
    """Lower-cased words; versions without a final .0; names of an SPDX tag start with =."""
    low, out, at = text.lower(), [], 0
    for m in _TAG.finditer(low):
        out += _plain(low[at : m.start()])
        for name in _NAME.findall(m[1]):
            if name not in ("or", "and", "with"):
                out += ["spdx", "license", "identifier", "=" + name]
        at = m.end()
    return out + _plain(low[at:])


def _plain(low: str) -> list[str]:
    out = _WORD.findall(_GLUED.sub(r"\1 \2", low))
    return [re.sub(r"(\.0+)+$", "", w) if w[0].isdigit() else w for w in out]


def decides(word: str) -> bool:
    return word in DECIDING or word[0] == "=" or _VERSION.fullmatch(word) is not None


def edits(template: list[str], block: list[str]) -> int:
    """Least word edits between the template and any stretch of the block."""
    ids: dict[str, int] = {}
    t = [ids.setdefault(w, len(ids)) for w in template]
    b = np.array([ids.setdefault(w, len(ids)) for w in block], np.int64)
    row = np.zeros(len(b) + 1, np.int64)
    at = np.arange(len(b) + 1)
    for k, w in enumerate(t, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (b != w), row[1:] + 1)
        # Insertions run along the row: the least of new[j] + (i - j) for j <= i.
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def stretches(template: list[str], block: list[str], most: int) -> list[tuple[int, int, int]]:
    """Edits, start and end (words of the block) of the best stretch for each end that takes at most so many edits, none of a deciding word."""
    never = 1 << 20
    cost_b = [never if decides(w) else 1 for w in block]
    # (edits, start) by number of words of the block; a stretch starts anywhere.
    row = [(0, j) for j in range(len(block) + 1)]
    for w in template:
        gone = never if decides(w) else 1
        new = [(row[0][0] + gone, 0)]
        for j, b in enumerate(block):
            d, s = row[j]
            if b != w:
                d += max(gone, cost_b[j])
            up, left = row[j + 1], new[j]
            new.append(min((d, -s), (up[0] + gone, -up[1]), (left[0] + cost_b[j], -left[1])))
            new[-1] = (new[-1][0], -new[-1][1])
        row = new
    return [(d, s, j) for j, (d, s) in enumerate(row) if d <= most and s < j]


def named() -> dict[str, str]:
    """The frames filled with each name, by <license>-named-<number>; not those that are a template word for word."""
    known, out = {tuple(words(t)) for t in TEMPLATES.values()}, {}
    for k, names in NAMES.items():
        for frame in FRAMES:
            for name in names:
                text = frame.format(name)
                if (w := tuple(words(text))) not in known:
                    known.add(w)
                    out[f"{k}-named-{len(out)}"] = text
    return out


_NUMBER = re.compile(r"-named-\d+$")
_PART = re.compile(r"\w")


def blocks(text: str | None, around: int = AROUND) -> list[tuple[str, int]]:
    """Windows about the cues and family names; those that overlap are one, up to eight windows long. With each the characters that it shares with the one before."""
    if not text:
        return []
    low = text.lower()
    found = [m for c in CUES if c in low for m in _all(low, c)]
    # A family name is a word of its own, or the begin of one with a version.
    found += [m for c in FAMILIES if c in low for m in _all(low, c) if not (m and _PART.match(low[m - 1])) and not low[m + len(c) : m + len(c) + 1].isalpha() or low[m + len(c) : m + len(c) + 2].startswith("v") and low[m + len(c) + 1 : m + len(c) + 2].isdigit()]
    found.sort()
    out: list[list[int]] = []
    for k in found:
        if out and k - around <= out[-1][1] and k - out[-1][0] < 8 * around:
            out[-1][1] = k + around
        else:
            out.append([max(0, k - around), k + around])
    return [(low[a:b], max(0, before - a)) for (a, b), before in zip(out, [0, *[b for _, b in out]], strict=False)]


def _all(text: str, cue: str) -> Iterator[int]:
    k = text.find(cue)
    while k >= 0:
        yield k
        k = text.find(cue, k + 1)


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, edit_share: float = EDITS, level: int = LEVEL):
        self.templates = dict(sorted((templates or TEMPLATES | named()).items()))
        self.words = {k: words(t) for k, t in self.templates.items()}
        self.most = {k: max(int(edit_share * len(w)), int(len(w) >= SHORT)) for k, w in self.words.items()}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.plain = zstandard.ZstdCompressor(level=level)
        self.packers = {k: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, t in self.templates.items()}
        #: Templates by their rarest deciding word, or under None: only those whose word a block has need a look.
        of = Counter(w for c in self.counts.values() for w in c)
        self.by: dict[str | None, list[str]] = {}
        for k, c in self.counts.items():
            self.by.setdefault(min((w for w in c if decides(w)), key=lambda w: (of[w], w), default=None), []).append(k)

    def possible(self, own: list[str]) -> list[str]:
        """Templates that the block's words can make up: all deciding ones, and no more missing than edits allow."""
        had = Counter(own)
        out = []
        for k in [*self.by.get(None, []), *(k for w in had for k in self.by.get(w, []))]:
            missing = 0
            for w, n in self.counts[k].items():
                if (lack := n - had[w]) > 0:
                    missing += lack
                    if missing > self.most[k] or decides(w):
                        break
            else:
                out.append(k)
        return out

    def rank(self, block: str, names: list[str] | None = None) -> list[tuple[int, str]]:
        """Bytes saved and name, the most first."""
        raw = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        return sorted(((alone - len(self.packers[k].compress(raw)), k) for k in (self.packers if names is None else names)), key=lambda x: (-x[0], x[1]))

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int]]]:
        """Number of blocks; name, bytes saved and word edits of each confirmed notice."""
        found, bs = [], blocks(text)
        before: set[tuple[str, int]] = set()
        for b, shared in bs:
            own = words(b)
            near = []
            for saved, k in self.rank(b, names) if (names := self.possible(own)) else []:
                if saved <= 0:
                    break
                # The bound on edits with all words alike is quick; the exact one with deciding words comes after it.
                if edits(self.words[k], own) <= self.most[k]:
                    near += [(d, lo - hi, -saved, k, lo, hi) for d, lo, hi in stretches(self.words[k], own, self.most[k])]
            taken: list[tuple[int, int]] = []
            # A notice that the block before confirmed too, as far from the end of what both share.
            common = len(words(b[:shared]))
            now = set()
            for d, _, saved, k, lo, hi in sorted(near):
                if all(hi <= x or y <= lo for x, y in taken):
                    taken.append((lo, hi))
                    name = _NUMBER.sub("-named", k)
                    now.add((name, len(own) - lo))
                    if (name, common - lo) not in before:
                        found.append((name, -saved, d))
            before = now
        return len(bs), found


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Per document row: doc_id, licenses (names, sorted, comma-joined; empty if none), n_blocks, n_confirmed, bytes_saved and word_edits (of the one that saves most, else null)."""
    rows = only(docs, doc_id, text).toDF("doc_id", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates)
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for t in b.column(1).to_pylist():
                n, found = s.scan(t)
                best = max(found, key=lambda x: (x[1], -x[2]), default=("", None, None))
                for to, v in zip(out, (",".join(sorted({f[0] for f in found})), n, len(found), best[1], best[2]), strict=True):
                    to.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], ["doc_id", "licenses", "n_blocks", "n_confirmed", "bytes_saved", "word_edits"])

    return by_batch(rows, go, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, licenses string, n_blocks long, n_confirmed long, bytes_saved int, word_edits int")
