"""License scans (operator 2): conditional compression against license templates.

A text's candidate blocks are the words around license wording, as far as a template reaches, over line
breaks and comment marks. A block is compressed alone and with each template as Zstandard raw dictionary; templates are
ranked by the bytes that they save. Down this ranking the exact differences of wording (template words missing, words added
within the aligned stretch) confirm or reject: the winner is the first template that differs in at most a share of its words
and whose stretch loses a share of its compressed size; of those that save nearly as much (CLOSE bytes), the one with the
fewest differences for its length. Templates that lack more words in a block than differences may amount to can't be confirmed
and are not compressed with. Both rests of the block are searched again, until no template is confirmed. In an SPDX
expression each name is confirmed as an identifier line of its own.

Every whole text is scanned in Arrow batches by one map pass; nothing is shuffled. Templates are a
fixed list in this module, so what tasks carry is bounded.

Defined results: texts of any length are scanned whole; null counts as empty text; a text without license wording has no block; equal
rankings go to the template that comes first in the list; repeated rows are returned each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectext

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
# License names with notices and passages that state them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *((n, f"SPDX-License-Identifier: {n}") for n in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")),
    *((n, f"SPDX-License-Identifier: {n}{e}") for n in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0") for e in ("", "-only", "-or-later")),
    ("proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited."),
)
WORDING = r"(?i)licen[sc]e|spdx|copyright|permission\W+is\W+hereby|permission\W+to\W+use|redistribut|public\W+domain|all\W+rights\W+reserved"
_WORDING = re.compile(WORDING)
#: An SPDX expression after its first name.
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*\(*[A-Za-z0-9.+-]+((?:[ \t)(]+(?:AND|OR|WITH)[ \t(]+[A-Za-z0-9.+-]+)+)")
#: Bytes of compressed size that are no difference between templates.
CLOSE = 16
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

FOUND = "array<struct<license:string,begin:int,stop:int,reduction:double,n_missing:int,n_added:int,missing:string,added:string>>"


def blocks(words: list[tuple[str, int, int]], text: str, reach: int) -> list[tuple[int, int]]:
    """Word ranges around license wording: `reach` words on both sides, joined where they meet."""
    out: list[tuple[int, int]] = []
    ends = [e for _, _, e in words]
    for m in _WORDING.finditer(text):
        at = bisect.bisect_right(ends, m.start())
        begin, end = max(0, at - reach), min(len(words), at + reach + 1)
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


class Scanner:
    """Compressors with a template each, and their words."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, level: int = 3) -> None:
        self.templates = templates
        self.alone = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for _, t in templates]
        self.words = [[w.lower() for w in _WORD.findall(t)] for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        self.longest = max(map(len, self.words))

    def reduction(self, stretch: str, template: int) -> float:
        """Share of its compressed size that a stretch loses when the template is known."""
        data = stretch.encode("utf-8", "surrogatepass")
        return 1 - len(self.given[template].compress(data)) / len(self.alone.compress(data))

    def differences(self, matcher: difflib.SequenceMatcher, template: int) -> tuple[list[str], list[str], int, int] | None:
        """Template words that are missing, words added inside the aligned stretch, and that stretch as word range, where these are fewest; None if nothing aligns."""
        words, own = self.words[template], matcher.b
        matcher.set_seq1(words)
        same = [b for b in matcher.get_matching_blocks() if b.size]
        best = None
        for i in range(len(same)):  # a stray word before or after the stretch isn't part of it
            size = 0
            for b in same[i:]:
                size += b.size
                n = len(words) - size + b.b + b.size - same[i].b - size
                if best is None or n < best[0]:
                    best = (n, i, b)
        if best is None:
            return None
        same = same[best[1] : same.index(best[2]) + 1]
        first, last = same[0].b, same[-1].b + same[-1].size
        kept = {i for b in same for i in range(b.a, b.a + b.size)}
        used = {i for b in same for i in range(b.b, b.b + b.size)}
        return [w for i, w in enumerate(words) if i not in kept], [own[i] for i in range(first, last) if i not in used], first, last

    def ranked(self, block: str, have: Counter, most_share: float) -> list[tuple[int, int]]:
        """(bytes saved, template) of a block, most first; without templates that lack too many of their words to be confirmed."""
        some = [i for i, t in enumerate(self.words) if (self.counts[i] - have).total() <= most_share * len(t)]
        if not some:
            return []
        data = block.encode("utf-8", "surrogatepass")
        alone = len(self.alone.compress(data))
        return sorted(((alone - len(self.given[i].compress(data)), i) for i in some), key=lambda r: (-r[0], r[1]))

    def best(self, text: str, words: list[tuple[str, int, int]], begin: int, end: int, least: float, most_share: float) -> tuple[int, int, dict] | None:
        """The license of a word range that wins by the bytes its template saves, confirmed by the differences, and the words that it takes."""
        own = [w for w, _, _ in words[begin:end]]
        matcher, best = difflib.SequenceMatcher(None, (), (), autojunk=False), None
        for saved, i in self.ranked(text[words[begin][1] : words[end - 1][2]], Counter(own), most_share):
            if best and saved < best[0] - CLOSE:
                break
            if not matcher.b:
                matcher.set_seq2(own)
            diff, size = self.differences(matcher, i), len(self.words[i])
            if not diff or len(diff[0]) + len(diff[1]) > most_share * size:
                continue
            first, last = words[begin + diff[2]][1], words[begin + diff[3] - 1][2]
            reduction, key = self.reduction(text[first:last], i), ((len(diff[0]) + len(diff[1])) / size, -size, i)
            if reduction >= least and (best is None or key < best[1]):
                found = {"license": self.templates[i][0], "begin": first, "stop": last, "reduction": round(reduction, 6), "n_missing": len(diff[0]), "n_added": len(diff[1]), "missing": " ".join(diff[0]), "added": " ".join(diff[1])}
                best = (best[0] if best else saved, key, begin + diff[2], begin + diff[3], found)
        return best and best[2:]

    def scan(self, text: str, least: float = 0.15, most_share: float = 0.15) -> tuple[list[dict], int]:
        """Confirmed licenses of a text and its number of blocks."""
        words = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
        out, spans = [], blocks(words, text, int(self.longest * (1 + most_share)) + 1)
        rest = list(spans)
        while rest:
            begin, end = rest.pop()
            found = self.best(text, words, begin, end, least, most_share) if begin < end else None
            if found:
                out.append(found[2])
                rest += [(begin, found[0]), (found[1], end)]
        for m in _EXPRESSION.finditer(text):
            for name in re.finditer(r"[A-Za-z0-9.+-]+", m[1]):
                line = f"SPDX-License-Identifier: {name[0]}"
                own = [(w[0].lower(), w.start(), w.end()) for w in _WORD.finditer(line)]
                place = m.start(1) + name.start()
                if name[0] not in ("AND", "OR", "WITH") and (hit := self.best(line, own, 0, len(own), least, 0.0)):
                    out.append(hit[2] | {"begin": place, "stop": place + len(name[0])})
        return sorted(out, key=lambda f: f["begin"]), len(spans)


def scan_licenses(docs: DataFrame, carry: list[str], **options: float) -> DataFrame:
    """docs[carry] with n_blocks and found, the confirmed licenses with span, reduction and exact differences."""
    schema = common.wider(docs, carry, f"n_blocks int, found {FOUND}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, kind = Scanner(), pa.list_(pa.struct([("license", pa.string()), ("begin", pa.int32()), ("stop", pa.int32()), ("reduction", pa.float64()), ("n_missing", pa.int32()), ("n_added", pa.int32()), ("missing", pa.string()), ("added", pa.string())]))
        for part in vectext.parts(batches, "_text", 8 << 20):
            text = part.column("_text")
            look = pc.match_substring_regex(text, WORDING).to_numpy(zero_copy_only=False)
            got = [scanner.scan(text[i].as_py(), **options) if look[i] else ([], 0) for i in range(len(text))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array([n for _, n in got], pa.int32()), pa.array([f for f, _ in got], kind)], names=[*carry, "n_blocks", "found"])

    return docs.select(*carry, F.coalesce(F.col("text"), F.lit("")).alias("_text")).mapInArrow(run, schema)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f.license))), ",")
    return scan_licenses(docs, ["doc_id"]).select("doc_id", F.col("n_blocks").cast("long").alias("n_blocks"), F.size("found").cast("long").alias("n_licenses"), names.alias("licenses"), F.array_join(F.transform("found", lambda f: F.concat_ws(":", f.license, f.begin.cast("string"), f.stop.cast("string"))), ",").alias("spans"), F.coalesce(F.array_max(F.transform("found", lambda f: f.reduction)), F.lit(0.0)).alias("best_reduction"))
