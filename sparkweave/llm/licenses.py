"""Licence scans by sentence-rule recognition.

Known sentences of licences have identifiers. A text is normalised to lower-case words with the places they come from; where a
sentence or a line begins, the known sentences that begin with the next words are compared word by word, so line breaks and
punctuation within a sentence do not matter. What remains of a document is the sequence of its identifiers. Rules
name sequences in order; at every place of the sequence the longest rule that fits is taken, and the scan goes on after it.
Between two sentences of a rule other text may stand, up to ``GAP`` words.

Cases: of rules that fit at one place with equally many sentences the first by name is taken; null and empty texts match nothing; repeated rows match each; null ids come back as they are; an empty table gives no
rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm.common import in_arrow, table

GAP = 40

#: Known sentences of licence texts and notices, by identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-notice-3": "This project is licensed under the MIT License",
    "mit-title": "The MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "cc-by-nc-sa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-details": "See the GNU Lesser General Public License for more details",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-details": "See the GNU Affero General Public License for more details",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib-notice": "This notice may not be removed or altered from any source distribution",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}

#: Rule, licence, kind and the sentences in order.
RULES = (
    ("mit-full", "MIT", "text", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("mit-titled", "MIT", "text", ("mit-title", "mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("mit-short", "MIT", "notice", ("mit-grant",)),
    ("mit-released", "MIT", "notice", ("mit-notice",)),
    ("mit-licensed", "MIT", "notice", ("mit-notice-2",)),
    ("mit-project", "MIT", "notice", ("mit-notice-3",)),
    ("isc", "ISC", "text", ("isc-grant",)),
    ("bsd-2", "BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd-3", "BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("apache-header", "Apache-2.0", "notice", ("apache-notice", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("apache-short", "Apache-2.0", "notice", ("apache-notice",)),
    ("gpl-3-header", "GPL-3.0-or-later", "notice", ("gpl-free", "gpl-hope", "gpl-details")),
    ("gpl-3-short", "GPL-3.0-or-later", "notice", ("gpl-free",)),
    ("gpl-3-only", "GPL-3.0-only", "notice", ("gpl3-notice",)),
    ("gpl-2-header", "GPL-2.0-or-later", "notice", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("gpl-2-short", "GPL-2.0-or-later", "notice", ("gpl2-free",)),
    ("mpl", "MPL-2.0", "notice", ("mpl-notice",)),
    ("cc-by-nc", "CC-BY-NC-4.0", "notice", ("cc-by-nc-notice",)),
    ("cc-by", "CC-BY-4.0", "notice", ("cc-by-notice",)),
    ("cc-by-sa", "CC-BY-SA-4.0", "notice", ("cc-by-sa-notice",)),
    ("cc-by-nc-long", "CC-BY-NC-4.0", "notice", ("cc-by-nc-work",)),
    ("cc-by-long", "CC-BY-4.0", "notice", ("cc-by-work",)),
    ("cc-by-sa-long", "CC-BY-SA-4.0", "notice", ("cc-by-sa-work",)),
    ("unlicense", "Unlicense", "notice", ("unlicense-domain",)),
    ("cc0", "CC0-1.0", "notice", ("cc0-waiver",)),
    ("cc-by-nc-sa-long", "CC-BY-NC-SA-4.0", "notice", ("cc-by-nc-sa-work",)),
    ("cc-by-nd-long", "CC-BY-ND-4.0", "notice", ("cc-by-nd-work",)),
    ("isc-full", "ISC", "text", ("isc-grant", "isc-warranty", "isc-liability")),
    ("bsd-2-full", "BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("bsd-3-full", "BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty", "bsd-liability")),
    ("apache-text", "Apache-2.0", "text", ("apache-title", "apache-terms")),
    ("gpl-3-text", "GPL-3.0-only", "text", ("gpl3-title", "gnu-verbatim")),
    ("gpl-2-text", "GPL-2.0-only", "text", ("gpl2-title", "gnu-verbatim")),
    ("lgpl-3-text", "LGPL-3.0-only", "text", ("lgpl3-title", "gnu-verbatim")),
    ("agpl-3-text", "AGPL-3.0-only", "text", ("agpl3-title", "gnu-verbatim")),
    ("gpl-3-header-copy", "GPL-3.0-or-later", "notice", ("gpl-free", "gpl-hope", "gpl-details", "gpl-copy")),
    ("gpl-2-header-copy", "GPL-2.0-or-later", "notice", ("gpl2-free", "gpl-hope", "gpl-details", "gpl-copy")),
    ("lgpl-header", "LGPL-2.1-or-later", "notice", ("lgpl-free", "lgpl-hope", "lgpl-details")),
    ("lgpl-short", "LGPL-2.1-or-later", "notice", ("lgpl-free",)),
    ("agpl-header", "AGPL-3.0-or-later", "notice", ("agpl-free", "gpl-hope", "agpl-details")),
    ("agpl-short", "AGPL-3.0-or-later", "notice", ("agpl-free",)),
    ("mpl-header", "MPL-2.0", "notice", ("mpl-notice", "mpl-copy")),
    ("epl", "EPL-2.0", "notice", ("epl-made",)),
    ("zlib-full", "Zlib", "text", ("zlib-warranty", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("zlib-short", "Zlib", "notice", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("boost", "BSL-1.0", "notice", ("boost-grant",)),
    ("unlicense-full", "Unlicense", "text", ("unlicense-domain", "unlicense-free")),
)

#: Identifiers of licences in one-line tags.
TAGS = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
SENTENCES |= {f"tag-{t.lower()}": f"SPDX-License-Identifier: {t}" for t in TAGS}
RULES += tuple((f"tag-{t.lower()}", t, "tag", (f"tag-{t.lower()}",)) for t in TAGS)

_WORD = re.compile(r"[^\W_]+")
#: Between two words: the end of a line or a sentence, after which a sentence may begin.
_START = re.compile(r"[\n.!?:;,(\"*#/-]")


class Recogniser:
    """Sentences by their first two words, and rules from the longest."""

    def __init__(self, sentences: dict[str, str], rules) -> None:
        self.by_start: dict[tuple[str, ...], list[tuple[tuple[str, ...], str]]] = {}
        for name, sentence in sentences.items():
            words = tuple(_WORD.findall(sentence.lower()))
            self.by_start.setdefault(words[:2], []).append((words, name))
        for known in self.by_start.values():
            known.sort(key=lambda k: (-len(k[0]), k[1]))
        self.rules = sorted(rules, key=lambda r: (-len(r[3]), r[0]))
        #: A text without any sentence's longest word has no sentence: a quick test.
        self.keys = sorted({max(_WORD.findall(s.lower()), key=len) for s in sentences.values()})

    def sentences(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """identifier, first word, end word, first character, end character of the known sentences, in order."""
        low = text.lower()
        if len(low) != len(text):  # some capitals become two characters; places must be those of the text
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        if not any(k in low for k in self.keys):
            return []
        found = [(m[0], m.start(), m.end()) for m in _WORD.finditer(low)]
        words = [w for w, _, _ in found]
        out, i = [], 0
        while i < len(words) - 1:
            hit = None
            known = self.by_start.get((words[i], words[i + 1]))
            if known and (i == 0 or _START.search(low, found[i - 1][2], found[i][1])):
                hit = next(((k, name) for k, name in known if tuple(words[i : i + len(k)]) == k), None)
            if hit:
                end = i + len(hit[0])
                out.append((hit[1], i, end, found[i][1], found[end - 1][2]))
                i = end
            else:
                i += 1
        return out

    def matches(self, text: str | None) -> list[tuple]:
        """rule, licence, kind, number of sentences, first character, end character."""
        seen = self.sentences(text or "")
        out, i = [], 0
        while i < len(seen):
            for rule, licence, kind, names in self.rules:
                part = seen[i : i + len(names)]
                if tuple(s[0] for s in part) == tuple(names) and all(b[1] - a[2] <= GAP for a, b in zip(part, part[1:])):
                    out.append((rule, licence, kind, len(names), part[0][3], part[-1][4]))
                    i += len(names)
                    break
            else:
                i += 1
        return out


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """One row for each match: doc_id, rule, license, kind, n_sentences, start, end (in code points)."""

    def run(batches):
        recogniser = Recogniser(sentences, rules)
        names = ["doc_id", "rule", "license", "kind", "n_sentences", "start", "end"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = [(key, *m) for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in recogniser.matches(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(
        in_arrow, run, "doc_id long, rule string, license string, kind string, n_sentences int, start int, end int"
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
