"""Licence scans by sentence recognition.

A text is cut into sentences, each is normalised (case, punctuation, white space, the names and
years of copyright lines) and looked up among known licence sentences. The identifiers found,
in the order of the text, are matched against ordered rules: from left to right, the
longest rule whose identifiers follow in that order names a licence and takes them.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrowtext as at

BATCH_BYTES = 4_000_000

# The words of public licence notices.
#: identifier: sentence. More of them follow from the names below.
SENTENCES = {
    "apache2-short": "Licensed under the Apache License, Version 2.0",
    "apache2-the-license": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache2-comply": "you may not use this file except in compliance with the License",
    "apache2-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache2-limits": "See the License for the specific language governing permissions and limitations under the License",
    "mit-short": "Released under the MIT License",
    "mit-short-licensed": "Licensed under the MIT License",
    "mit-name": "The MIT License (MIT)",
    "mit-name-plain": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib-notice": "This notice may not be removed or altered from any source distribution",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "boost-file": "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
    "epl1-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc0-short": "Released under CC0 1.0",
    "cc-by-short": "Licensed under CC BY 4.0",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-short": "Licensed under CC BY-ND 4.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "rights-reserved": "All rights reserved",
    "copyright": "Copyright",
}

#: (licence, identifiers in order); a licence may have several rules.
RULES = (
    ("Apache-2.0", ("apache2-the-license", "apache2-comply", "apache2-obtain", "apache2-asis", "apache2-limits")),
    ("Apache-2.0", ("apache2-short",)),
    ("Apache-2.0", ("apache2-the-license",)),
    ("MIT", ("mit-name", "copyright", "mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-name-plain", "copyright", "mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short-licensed",)),
    ("MIT", ("mit-name",)),
    ("ISC", ("isc-grant", "isc-asis", "isc-liability")),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-asis", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Zlib", ("zlib-asis", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-file",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("CC0-1.0", ("cc0-short",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-short",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
)

#: Licences by the names that short notices give them.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License, Version 2.0"),
    "MIT": ("MIT License", "MIT licence", "Expat License"),
    "ISC": ("ISC License",),
    "BSD": ("BSD License", "BSD licence"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "MPL 2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
#: How such notices begin.
OPENINGS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "Available under", "Published under")
#: GNU licences: name in notices, stem of identifiers, versions.
GNU = (
    ("GNU General Public License", "GPL", ("2", "3")),
    ("GNU Lesser General Public License", "LGPL", ("2.1", "3")),
    ("GNU Library General Public License", "LGPL", ("2",)),
    ("GNU Affero General Public License", "AGPL", ("3",)),
)


def _families() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Sentences and rules that follow from the names: short notices, notices of GNU licences, SPDX lines."""
    sentences: dict[str, str] = {}
    rules: dict[tuple[str, ...], str] = {}

    def one(licence: str, identifier: str, text: str) -> None:
        sentences[identifier] = text
        rules[identifier,] = licence

    for licence, names in NAMES.items():
        for i, name in enumerate(names):
            for j, opening in enumerate(OPENINGS):
                for article in ("", "the ", "a "):
                    one(licence, f"{licence}/{i}/{j}/{article.strip() or 'bare'}", f"{opening} {article}{name}")
        one(licence, f"{licence}/spdx", f"SPDX-License-Identifier: {licence}")
    for name, stem, versions in GNU:
        kind = name.split()[1].lower()
        sentences[f"{kind}-details"] = f"See the {name} for more details"
        for i, what in enumerate(("program", "library", "software", "file")):
            sentences[f"{kind}-copy/{i}"] = f"You should have received a copy of the {name} along with this {what}"
        for v in versions:
            dotted = v if "." in v else f"{v}.0"
            for tail, ending in (("only", ""), ("or-later", " or later"), ("or-later", " or any later version"), ("or-later", ", or (at your option) any later version")):
                licence = f"{stem}-{dotted}-{tail}"
                for j, opening in enumerate(OPENINGS):
                    for k, version in enumerate((f"version {v}", f"v{v}", f"Version {v}.0", f"v{v}.0")):
                        bare = ending == "" and tail == "only"  # a bare number says nothing of later ones
                        one(f"{stem}-{dotted}" if bare else licence, f"{kind}-{v}/{j}/{k}/{ending.strip() or 'bare'}", f"{opening} the {name}, {version}{ending}")
                one(licence, f"{licence}/spdx", f"SPDX-License-Identifier: {licence}")
            one(f"{stem}-{dotted}-or-later", f"{stem}-{dotted}+/spdx", f"SPDX-License-Identifier: {stem}-{dotted}+")
            one(f"{stem}-{dotted}", f"{stem}-{dotted}/spdx", f"SPDX-License-Identifier: {stem}-{dotted}")
            for i, what in enumerate(("This program", "This library", "This software", "This file", "It")):
                free = f"{what} is free software: you can redistribute it and/or modify it under the terms of the {name}"
                for j, (tail, text) in enumerate((
                    ("or-later", f"{free} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version"),
                    ("only", f"{free} as published by the Free Software Foundation, version {v} of the License"),
                    ("only", f"{free} version {v} as published by the Free Software Foundation"),
                    ("only", f"{free}, version {v}, as published by the Free Software Foundation"),
                )):
                    own = f"{kind}-{v}-free/{i}/{j}"
                    sentences[own] = text
                    licence = f"{stem}-{dotted}-{tail}"
                    rules[own, "gnu-useful", "gnu-implied", f"{kind}-details"] = rules[own, "gnu-useful"] = rules[own,] = licence
    sentences["gnu-useful"] = "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"
    for i, what in enumerate(("program", "library", "software", "file")):
        sentences[f"gnu-useful/{i}"] = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"
    sentences["gnu-implied"] = "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
    return sentences, [(licence, ids) for ids, licence in rules.items()]


_FAMILIES = _families()
SENTENCES = _FAMILIES[0] | SENTENCES
RULES = (*RULES, *_FAMILIES[1])
#: Beginnings of the identifiers that are evidence in longer rules, or of nothing by themselves.
EVIDENCE = (
    "mit-name-plain", "mit-grant", "apache2-comply", "apache2-obtain", "apache2-asis", "apache2-limits", "mit-notice", "mit-asis", "mit-liability", "isc-asis", "isc-liability", "zlib-", "bsd-", "mpl2-copy", "unlicense-anyone",
    "rights-reserved", "copyright", "gnu-", "general-", "lesser-", "library-", "affero-",
)

_COPYRIGHT = re.compile(r"^(?:copyright|\(c\)|©)(?:\s+(?:\(c\)|©))?\s+(?:\d{4}\b.*|the .*|by .*)$", re.I | re.S)
_END = re.compile(r"(?<=[.!?;:,])\s+|\n\s*\n")
_LINE = re.compile(r"[\r\n]+")
_EDGE = re.compile(r"[^0-9a-z]+")
_SIGNS = " \t\r\n" + string.punctuation
_SPDX = re.compile(r"SPDX-License-Identifier:", re.I)
_OPERATOR = re.compile(r"\s+(?:OR|AND|WITH)\s+|[()]|\Z")


def normalised(sentence: str) -> str:
    """Lower-case letters and digits, each run of other signs as one space; a copyright line as `copyright`."""
    sentence = sentence.strip()
    if _COPYRIGHT.match(sentence):
        return "copyright"
    return _EDGE.sub(" ", sentence.lower()).strip()


class Recogniser:
    """Sentences by a trie of their words, and rules by their first identifier."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> None:
        self.known: dict[str, str] = {}
        for name, text in sentences.items():
            if key := normalised(text):
                self.known[key] = name
        self.words = max((len(t.split()) for t in self.known), default=0)
        self.starts = {t.split()[0] for t in self.known}
        # Rules by their first identifier, those with more first; of two with the same identifiers the first counts.
        named: dict[tuple, str] = {}
        for name, ids in rules:
            if ids:
                named.setdefault(tuple(x.partition("/")[0] if x.startswith("gnu-") else x for x in ids), name)
        self.rules: dict[str, list[tuple[tuple, str]]] = {}
        for ids, name in sorted(named.items(), key=lambda r: -len(r[0])):
            self.rules.setdefault(ids[0], []).append((ids, name))

    def hint(self) -> str | None:
        """A pattern that every text with a known sentence holds: the longest word of each. None where there is no sentence."""
        words = {max(t.split(), key=lambda w: (len(w), w)) for t in self.known}
        # A word that holds another one is found by it.
        words = sorted(w for w in words if not any(o != w and o in w for o in words))
        if "copyright" in self.known:
            words += [r"\(c\)", "©"]
        return f"(?i){'|'.join(words)}" if words else None

    def sentences(self, text: str) -> list[tuple[int, int, str]]:
        """Known sentences as (start, end, identifier), in order, none inside another.

        A sentence may run over line ends or fill a line, and may hold commas and other
        breaks, so runs of fragments are looked up, the longest first.
        """
        breaks = sorted({0, len(text), *(m.end() for m in _END.finditer(text)), *(m.end() for m in _LINE.finditer(text))})
        pieces = [_EDGE.sub(" ", text[a:b].lower()).strip() for a, b in zip(breaks, breaks[1:], strict=False)]
        full = [i for i, p in enumerate(pieces) if p]
        ends = [*full[1:], len(pieces)]  # signs and blank lines after a fragment go with it
        before = [0, *accumulate(pieces[i].count(" ") + 1 for i in full)]
        found, k = [], 0
        while k < len(full):
            i, got = full[k], 0
            # No run of more words than the longest sentence has can be one.
            most = max(1, bisect_right(before, before[k] + self.words) - 1 - k) if pieces[i].partition(" ")[0] in self.starts else 1
            for n in range(most, 0, -1):
                end, name = ends[k + n - 1], self.known.get(" ".join(pieces[j] for j in full[k : k + n]))
                if name is None and n == 1 and normalised(text[breaks[i] : breaks[i + 1]]) == "copyright":
                    end, name = i + 1, self.known.get("copyright")
                if name is not None:
                    found.append((breaks[i], breaks[end], name))
                    got = n
                    break
            else:
                if pieces[i].startswith("spdx"):
                    found += self._expression(text, breaks[i], breaks[ends[k]])
            k += got or 1
        return found

    def _expression(self, text: str, start: int, end: int) -> list[tuple[int, int, str]]:
        """The operands of the SPDX expression whose tag is in a fragment, up to the end of the line, each as if it stood alone after the tag."""
        tag = _SPDX.search(text, start, end)
        if not tag or text[start : tag.start()].strip(_SIGNS):
            return []
        line = _LINE.search(text, tag.end())
        end = line.start() if line else len(text)
        own, begin = [], tag.end()
        for m in _OPERATOR.finditer(text[:end], begin):
            name = self.known.get(normalised(tag.group() + text[begin : m.start()]))
            if name is not None:
                own.append((begin, m.start(), name))
            begin = m.end()
        return own

    def licences(self, ids: list[str]) -> list[str]:
        """Licences of a sequence of identifiers, in order.

        From left to right, the longest rule whose identifiers follow in order names a licence and takes
        them; identifiers that a rule doesn't name may stand between, and stay for others.
        """
        ids = [x.partition("/")[0] if x.startswith("gnu-") else x for x in ids]
        spots: dict[str, list[int]] = {}
        for i, x in enumerate(ids):
            spots.setdefault(x, []).append(i)
        taken = [False] * len(ids)
        out = []
        for i, x in enumerate(ids):
            if taken[i]:
                continue
            for rule, name in self.rules.get(x, ()):
                chain = [i]
                for want in rule[1:]:
                    own = spots.get(want, [])
                    j = bisect_right(own, chain[-1])
                    while j < len(own) and taken[own[j]]:
                        j += 1
                    if j == len(own):
                        break
                    chain.append(own[j])
                # A second beginning of the rule in between is another notice.
                again = spots[x][bisect_right(spots[x], i) :][:1]
                if len(chain) == len(rule) and not (again and again[0] < chain[-1]):
                    for j in chain:
                        taken[j] = True
                    out.append(name)
                    break
        return out


_SCHEMA = "doc_id bigint, n_sentences bigint, sentence_ids array<string>, spans array<struct<start: bigint, end: bigint>>, licenses array<string>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("sentence_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("licenses", pa.list_(pa.string()))])


def _scan(sentences: dict[str, str], rules: tuple):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Recogniser(sentences, rules)
        pattern = known.hint()
        for table in at.batches(frames, "text", BATCH_BYTES):
            texts = at.chunk(table, "text").fill_null("")
            n = len(texts)
            hint = pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) if pattern else np.zeros(n, bool)
            ids: list[list] = [[] for _ in range(n)]
            spans: list[list] = [[] for _ in range(n)]
            names: list[list] = [[] for _ in range(n)]
            for r in hint.nonzero()[0].tolist():
                found = known.sentences(texts[r].as_py())
                ids[r] = [x for _, _, x in found]
                spans[r] = [{"start": a, "end": b} for a, b, _ in found]
                names[r] = known.licences(ids[r])
            yield pa.RecordBatch.from_arrays([at.chunk(table, "doc_id"), pa.array([len(x) for x in ids], pa.int64()), *(pa.array(c, k) for c, k in zip((ids, spans, names), _ARROW.types[2:], strict=True))], schema=_ARROW)

    return run


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """Licences named in every text.

    docs needs doc_id and text; other columns are not read. Returns a row a row: doc_id,
    n_sentences recognised, sentence_ids and their spans (code points, end exclusive) in
    the order of the text, licenses (one a rule that fits, in order, with repeats). Null and empty
    texts have none. Other sentences, known ones too, between those of a rule don't matter. Of two rules with the
    same identifiers the first counts.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scan(dict(sentences), tuple(rules)), _SCHEMA)
