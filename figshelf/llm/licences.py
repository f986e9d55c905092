"""Licence scans by sentence rules (operator 3).

1. Texts are cut into fragments, at line ends and after `.`, `;`, `:`, `!` and `?` before white space; marks of
   comments at the start of lines go. A fragment is normalised: lower case, and every run of characters
   that are neither letters nor digits is one space.
2. A known licence sentence may be wrapped over lines, so consecutive fragments are joined as long as
   they begin a known sentence; a join that equals one gives that sentence's identifier. The longest wins.
3. The identifiers of a text, in order, are matched against ordered rules, more sentences first: a rule
   matches where its identifiers follow each other with at most MAX_GAP unknown fragments in between.
   Identifiers that no rule takes count as unmatched.

Null and empty texts have no licence. Each row gets its own answer, repeated rows and null ids too; very long
texts are read whole; an empty table gives an empty one. Rows are mapped in place: nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from figshelf.llm.common import bounded_batches, col, documents, map_batches, quoted

MAX_GAP = 3

# Sentences of published licences and of the notices they ask for.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-name": "Released under the MIT License.",
    "mit-name-2": "Licensed under the MIT License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-name": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl3-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "lgpl3-name": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mpl2-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-name": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "mit-0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "gpl2-name": "This work is licensed under the GNU General Public License, version 2.",
    "gpl2-only-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-free": "This library is free software;",
    "lgpl21-grant": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl3-grant": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl2-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by-sa-4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-4-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-3-long": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "cc-by-sa-3-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0.",
    "cc0-long": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-warranty": "This software is distributed without any warranty.",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-mpl2": "SPDX-License-Identifier: MPL-2.0",
    "spdx-gpl2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl2-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx-lgpl21": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx-agpl3": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "spdx-cc0": "SPDX-License-Identifier: CC0-1.0",
    "spdx-unlicense": "SPDX-License-Identifier: Unlicense",
    "spdx-zlib": "SPDX-License-Identifier: Zlib",
    "spdx-boost": "SPDX-License-Identifier: BSL-1.0",
    "spdx-epl2": "SPDX-License-Identifier: EPL-2.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
}
RULES = [
    ("MIT", "mit-grant mit-notice mit-warranty mit-liability"),
    ("MIT-0", "mit-0-grant mit-warranty mit-liability"), ("MIT-0", "mit-0-grant"),
    ("BSD-4-Clause", "bsd-grant bsd-source bsd-binary bsd-advertising bsd-name"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-name bsd-warranty bsd-liability"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-warranty bsd-liability"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-name"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
    ("ISC", "isc-grant isc-warranty isc-liability"), ("ISC", "isc-grant isc-warranty"), ("ISC", "isc-grant"),
    ("Zlib", "zlib-warranty zlib-liability zlib-grant"), ("Zlib", "zlib-grant"),
    ("BSL-1.0", "boost-grant mit-warranty"), ("BSL-1.0", "boost-grant"), ("BSL-1.0", "boost-name"),
    ("GPL-2.0-only", "gpl-free gpl2-only-grant gpl-warranty gpl-see gpl-copy"), ("GPL-2.0-only", "gpl-free gpl2-only-grant"),
    ("GPL-3.0-or-later", "gpl-free gpl3-grant gpl-warranty gpl-see gpl-copy"),
    ("GPL-2.0-or-later", "gpl-free gpl2-grant gpl-warranty gpl-see gpl-copy"),
    ("LGPL-2.1-or-later", "lgpl-free lgpl21-grant lgpl-warranty lgpl-see"), ("LGPL-2.1-or-later", "lgpl-free lgpl21-grant"),
    ("AGPL-3.0-or-later", "gpl-free agpl3-grant gpl-warranty agpl-see"), ("AGPL-3.0-or-later", "gpl-free agpl3-grant"),
    ("MPL-2.0", "mpl2-grant mpl2-copy"), ("EPL-2.0", "epl2-grant"), ("Unlicense", "unlicense unlicense-grant"),
    ("CC0-1.0", "cc0-long cc0-warranty"), ("CC0-1.0", "cc0-long"), ("GPL-2.0", "gpl2-name"),
    ("CC-BY-SA-4.0", "cc-by-sa-4-long"), ("CC-BY-ND-4.0", "cc-by-nd-4-long"), ("CC-BY-ND-4.0", "cc-by-nd-4"),
    ("CC-BY-3.0", "cc-by-3-long"), ("CC-BY-SA-3.0", "cc-by-sa-3-long"),
    ("ISC", "spdx-isc"), ("BSD-2-Clause", "spdx-bsd2"), ("MPL-2.0", "spdx-mpl2"), ("GPL-2.0-only", "spdx-gpl2"), ("GPL-2.0-or-later", "spdx-gpl2-later"),
    ("LGPL-2.1-or-later", "spdx-lgpl21"), ("AGPL-3.0-or-later", "spdx-agpl3"), ("CC0-1.0", "spdx-cc0"), ("Unlicense", "spdx-unlicense"),
    ("Zlib", "spdx-zlib"), ("BSL-1.0", "spdx-boost"), ("EPL-2.0", "spdx-epl2"),
    ("Apache-2.0", "apache-grant apache-use apache-copy apache-warranty apache-see"),
    ("Apache-2.0", "apache-grant apache-use"),
    ("GPL-3.0-or-later", "gpl-free gpl3-grant gpl-warranty gpl-see"),
    ("GPL-3.0-or-later", "gpl-free gpl3-grant"),
    ("GPL-2.0-or-later", "gpl-free gpl2-grant gpl-warranty gpl-see"),
    ("GPL-2.0-or-later", "gpl-free gpl2-grant"),
    ("MIT", "mit-grant"), ("MIT", "mit-name"), ("MIT", "mit-name-2"), ("MIT", "spdx-mit"),
    ("Apache-2.0", "apache-name"), ("Apache-2.0", "spdx-apache"),
    ("GPL-3.0", "gpl3-name"), ("GPL-3.0-or-later", "spdx-gpl3"), ("LGPL-3.0", "lgpl3-name"),
    ("MPL-2.0", "mpl2-grant"), ("BSD-3-Clause", "spdx-bsd3"), ("Unlicense", "unlicense"),
    ("CC-BY-4.0", "cc-by-4"), ("CC-BY-SA-4.0", "cc-by-sa-4"), ("CC-BY-NC-4.0", "cc-by-nc-4"),
    ("CC-BY-4.0", "cc-by-4-long"), ("CC-BY-NC-4.0", "cc-by-nc-4-long"),
]

FRAGMENT = re.compile(r"(?:[^\n.;:!?]|[.;:!?](?!\s|$))*[.;:!?]?")
LEADER = re.compile(r"^\s*(?:/\*+|\*+/?|//+|#+|--+|;+|<!--|\d+\.|\(\w\))?\s*")
NOT_WORD = re.compile(r"[\W_]+")


def normalise(fragment: str) -> str:
    return NOT_WORD.sub(" ", fragment.lower()).strip()


def fragments(text: str) -> Iterator[tuple[int, str]]:
    """Where each fragment begins, and its normalised words; fragments without words are left out."""
    at = 0
    for line in text.split("\n"):
        lead = LEADER.match(line).end()
        for m in FRAGMENT.finditer(line, lead):
            if m.end() > m.start() and (words := normalise(m[0])):
                yield at + m.start(), words
        at += len(line) + 1


KNOWN = {" ".join(w for _, w in fragments(s)): name for name, s in SENTENCES.items()}
SORTED = sorted(KNOWN)
FIRST_WORDS = {s.split(" ")[0] for s in SORTED}
ANCHORS = re.compile("licen[sc]|permission|redistribut|warrant|software|liable|mpl|copyright", re.I)  # each known sentence has one of these
ORDERED = sorted(((licence, ids.split()) for licence, ids in RULES), key=lambda r: -len(r[1]))


def begins_known(words: str) -> bool:
    k = bisect_left(SORTED, words)
    return k < len(SORTED) and (SORTED[k] == words or SORTED[k].startswith(words + " "))


def sentence_ids(text: str) -> list[tuple[int, int, int, str]]:
    """(first fragment, next fragment, where it begins, identifier) of the known sentences, in order."""
    if not ANCHORS.search(text):
        return []
    parts, out, i = list(fragments(text)), [], 0
    while i < len(parts):
        begin, words = parts[i]
        found, j = None, i
        if words.split(" ", 1)[0] in FIRST_WORDS:
            while begins_known(words):
                j += 1
                if words in KNOWN:
                    found = (i, j, begin, KNOWN[words])
                if j == len(parts):
                    break
                words += " " + parts[j][1]
        if found:
            out.append(found)
        i = found[1] if found else i + 1
    return out


def licences(text: str) -> tuple[list[tuple[str, int, int]], int]:
    """(licence, where it begins, sentences) of each match, and the number of known sentences no rule takes."""
    ids, out, i, free = sentence_ids(text), [], 0, 0
    while i < len(ids):
        for licence, rule in ORDERED:
            part = ids[i : i + len(rule)]
            if [x[3] for x in part] == rule and all(b[0] - a[1] <= MAX_GAP for a, b in zip(part, part[1:])):
                out.append((licence, part[0][2], len(rule)))
                i += len(rule)
                break
        else:
            free, i = free + 1, i + 1
    return out, free


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_matches, n_sentences in them, n_unmatched sentences, licences (distinct, sorted,
    joined by a comma), first_begin (code points before the first match, null if none)."""
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {"n_matches": [], "n_sentences": [], "n_unmatched": [], "licences": [], "first_begin": []}
            for text in batch.column(1).to_pylist():
                found, free = licences(text or "")
                for column, value in zip(made.values(), (len(found), sum(n for _, _, n in found), free, ",".join(sorted({x for x, _, _ in found})), found[0][1] if found else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string() if k == "licences" else pa.int64()) for k, x in made.items())], [id_col, *made])

    two = docs.select(col(id_col), col(text_col))
    return map_batches(two, scan, f"{quoted(id_col)} {two.dtypes[0][1]}, n_matches long, n_sentences long, n_unmatched long, licences string, first_begin long")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(documents(spark, sf_dir))
