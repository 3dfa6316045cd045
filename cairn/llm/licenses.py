"""Licence scans by sentence rules.

Known licence sentences carry identifiers. A text is cut at line ends and sentence ends; from every such place
the words that follow (lower case, letters and digits only) are looked up in a tree of the known sentences, the longest
one that ends at a cut winning, so hard-wrapped sentences are recognised too. Notices of the form "licensed under
<name>", made by rule from NAMES, are also recognised inside of a sentence. That gives the sequence of identifiers in
the text. Licence rules are ordered: each names identifiers that must follow each other with at most
MAX_GAP other characters between two of them; a rule claims the sentences that it matches, and later rules see
only the rest. Both steps are linear in the text.

Defined cases: null and empty texts and texts without a known sentence have no licences; a sentence that
repeats is found each time; repeated rows are scanned row by row; an empty table gives no rows. Only the id and text
columns are read. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_GAP = 400

# Fixed texts: known licence sentences by identifier.
SENTENCES = {
    "apache-by": ["Licensed under the Apache License, Version 2.0", "This project is licensed under the Apache License, Version 2.0", "This file is licensed under the Apache License, Version 2.0"],
    "apache-grant": ['Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache-only": ["you may not use this file except in compliance with the License", "You may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-url": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-asis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit-by": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License"],
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-asis": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'
    ],
    "bsd-by": ["Licensed under the BSD License", "Released under the BSD License", "Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": [
        x + "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution" for x in ("", "2. ")
    ],
    "bsd-names": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "gpl3-by": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0", "Released under the GNU General Public License, version 3"],
    "gpl2-by": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License v2.0"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "lgpl-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "gnu-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "mpl-title": ["Mozilla Public License Version 2.0"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "epl2-title": ["Eclipse Public License - v 2.0"],
    "epl1-title": ["Eclipse Public License - v 1.0"],
    "cc-by-title": ["Creative Commons Attribution 4.0 International Public License"],
    "cc-by-sa-title": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "cc0-title": ["CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"],
    "boost-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "boost-grant": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'
    ],
    "zlib-asis": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-event": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "unlicense-free": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "isc-asis": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "bsd-asis": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl-by": ["Licensed under the GNU Lesser General Public License, version 3", "Licensed under the GNU Lesser General Public License, version 2.1"],
    "agpl-by": ["Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"],
    "mpl-by": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0"],
    "cc0": ["Released under CC0 1.0", "Licensed under CC0 1.0", "This work has been dedicated to the public domain under CC0 1.0"],
    "public-domain": ["This work is in the public domain", "This work is released into the public domain"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "all-rights": ["All rights reserved", "All Rights Reserved"],
}

# Fixed texts: names of licences in notices, by licence.
NAMES = {
    "MIT": ["MIT License", "MIT Licence", "MIT X11 License", "Expat License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache Software License 2.0", "Apache 2.0"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "BSD": ["BSD License", "BSD-style license"],
    "ISC": ["ISC License"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPL"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPL v2", "GNU GPL version 2", "GPLv2", "GPL v2", "GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GNU GPL v3", "GNU GPL version 3", "GPLv3", "GPL v3", "GPL version 3"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPL"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPL v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPL v3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPL v3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1"],
    "EPL-1.0": ["Eclipse Public License v1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License v2.0", "Eclipse Public License 2.0"],
    "EUPL-1.2": ["European Union Public Licence v1.2", "EUPL 1.2", "EUPL v1.2"],
    "CDDL-1.0": ["Common Development and Distribution License, version 1.0", "CDDL 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
    "PSF-2.0": ["Python Software Foundation License", "PSF License"],
    "PostgreSQL": ["PostgreSQL License"],
    "NCSA": ["University of Illinois/NCSA Open Source License", "NCSA License"],
    "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons CC0 1.0 Universal"],
    **{
        f"CC-{kind.upper()}-{version}": [f"CC {kind.upper()} {version}", f"CC-{kind.upper()}-{version}", f"Creative Commons {words} {version} International License", f"Creative Commons {words} {version} International", f"Creative Commons {words} {version} License"]
        for kind, words in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
        for version in ("4.0", "3.0", "2.0")
    },
}
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", *(x for x in NAMES if x.startswith("CC-")), *(f"{x}{end}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("-only", "-or-later", ""))]
#: How a notice may begin; it counts inside of a sentence too.
VERBS = ["licensed", "released", "distributed", "available", "published", "provided"]

#: Licence rules in order: licence and identifiers in sequence.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-title", "apache-terms"]),
    ("Apache-2.0", ["apache-grant", "apache-only", "apache-copy", "apache-url", "apache-asis", "apache-see"]),
    ("Apache-2.0", ["apache-grant", "apache-only"]),
    *((x, [title, "gnu-verbatim"]) for x, title in (("GPL-3.0", "gpl3-title"), ("GPL-2.0", "gpl2-title"), ("LGPL-3.0", "lgpl3-title"), ("LGPL-2.1", "lgpl-title"), ("AGPL-3.0", "agpl-title"))),
    *((x, [free, "gpl-warranty"]) for x, free in (("GPL-3.0-or-later", "gpl-free"), ("GPL-2.0-or-later", "gpl2-free"), ("LGPL-2.1-or-later", "lgpl-free"), ("LGPL-3.0-or-later", "lgpl3-free"), ("AGPL-3.0-or-later", "agpl-free"))),
    ("MPL-2.0", ["mpl-by", "mpl-copy"]), ("BSL-1.0", ["boost-title", "boost-grant"]), ("Zlib", ["zlib-asis", "zlib-event", "zlib-grant"]), ("Unlicense", ["unlicense", "unlicense-free"]), ("ISC", ["isc-grant", "isc-asis"]),
    ("GPL-3.0-or-later", ["gpl-free"]), ("GPL-2.0-or-later", ["gpl2-free"]), ("LGPL-2.1-or-later", ["lgpl-free"]), ("LGPL-3.0-or-later", ["lgpl3-free"]), ("AGPL-3.0-or-later", ["agpl-free"]), ("ISC", ["isc-grant"]), ("MIT", ["mit-grant"]),
    ("BSL-1.0", ["boost-grant"]), ("Zlib", ["zlib-grant"]), ("Unlicense", ["unlicense"]), ("BSD-2-Clause", ["bsd-grant"]),
    ("Apache-2.0", ["apache-by"]), ("Apache-2.0", ["apache-grant"]), ("MIT", ["mit-by"]), ("BSD", ["bsd-by"]), ("GPL-3.0", ["gpl3-by"]), ("GPL-2.0", ["gpl2-by"]), ("LGPL", ["lgpl-by"]), ("AGPL-3.0", ["agpl-by"]), ("MPL-2.0", ["mpl-by"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]), ("CC-BY-SA-4.0", ["cc-by-sa"]), ("CC-BY-ND-4.0", ["cc-by-nd"]), ("CC-BY-4.0", ["cc-by"]), ("CC0-1.0", ["cc0"]), ("public-domain", ["public-domain"]),
    *((x, [f"spdx-{x.lower()}"]) for x in SPDX),
    *((x, [f"notice-{x.lower()}"]) for x in NAMES),
    ("GPL-3.0", ["gpl3-title"]), ("GPL-2.0", ["gpl2-title"]), ("LGPL-3.0", ["lgpl3-title"]), ("LGPL-2.1", ["lgpl-title"]), ("AGPL-3.0", ["agpl-title"]), ("Apache-2.0", ["apache-title"]), ("MPL-2.0", ["mpl-title"]),
    ("EPL-2.0", ["epl2-title"]), ("EPL-1.0", ["epl1-title"]), ("CC-BY-4.0", ["cc-by-title"]), ("CC-BY-SA-4.0", ["cc-by-sa-title"]), ("CC0-1.0", ["cc0-title"]), ("BSL-1.0", ["boost-title"]),
    ("MIT", ["mit-title"]),
    ("proprietary", ["all-rights"]),
]

#: Every known sentence holds one of these, so a text without any holds no known sentence. Between two words stands whatever ``normalise`` drops.
ANCHOR = re.compile(
    r"licen[sc]e|permission|warrant|copyright|redistribut|misrepresented|rights[^a-z0-9]+reserved|public[^a-z0-9]+(?:domain|license)|free[^a-z0-9]+(?:software|to[^a-z0-9]+copy)|cc0|held[^a-z0-9]+liable|"
    rf"reproduction[^a-z0-9]+and[^a-z0-9]+distribution|copy[^a-z0-9]+of[^a-z0-9]+the[^a-z0-9]+mpl|(?:{'|'.join(VERBS)})[^a-z0-9]+under",
    re.I,
)
#: Each anchor holds one of these; looking for them first is cheaper.
_HINTS = ["licen", "permission", "warrant", "copyright", "redistribut", "misrepresented", "reserved", "public", "free", "cc0", "liable", "reproduction", "mpl", *VERBS]
_WORD = re.compile(r"[A-Za-z0-9]+")
_CUT = re.compile(r"\n+|[.!?;:]+(?=\s)|,?\s+(?=you may not use this file)")
_NOTICE = re.compile(rf"\b(?:{'|'.join(VERBS)})(?=[^A-Za-z0-9]+under\b)", re.I)
#: Marks in the tree of sentences: the identifier of one that ends here, and whether more words may follow in its sentence.
_ENDS = ("ends",)


def normalise(text: str) -> str:
    return " ".join(_WORD.findall(text)).lower()


def _tree() -> dict:
    """Words of the known sentences, each in the node of those before it."""
    root: dict = {}

    def put(sentence: str, name: str, inside: bool) -> None:
        node = root
        for word in normalise(sentence).split():
            node = node.setdefault(word, {})
        if _ENDS not in node or not inside:
            node[_ENDS] = (name, inside)

    for name, names in NAMES.items():
        for verb in VERBS:
            for terms in ("", "the terms of "):
                for article in ("", "the ", "a "):
                    for x in names:
                        put(f"{verb} under {terms}{article}{x}", f"notice-{name.lower()}", True)
    for x in SPDX:
        put(f"SPDX-License-Identifier: {x}", f"spdx-{x.lower()}", True)
    for name, texts in SENTENCES.items():
        for x in texts:
            put(x, name, False)
    return root


TREE = _tree()


def sentences(text: str | None) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the known sentences of a text, in order, without overlaps."""
    if not text:
        return []
    low = text.lower()
    if not any(x in low for x in _HINTS) or not ANCHOR.search(text):
        return []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    if not words:
        return []
    first = [a for a, _ in words]
    starts, stops = {0}, {len(words) - 1}
    for m in _CUT.finditer(text):
        starts.add(bisect_left(first, m.end()))
        stops.add(bisect_left(first, m.start()) - 1)
    starts.update(bisect_left(first, m.start()) for m in _NOTICE.finditer(text))
    out, done = [], 0
    for k in sorted(starts):
        if k < done:
            continue
        node, best = TREE, None
        for j in range(k, len(words)):
            node = node.get(text[words[j][0] : words[j][1]].lower())
            if node is None:
                break
            name, inside = node.get(_ENDS, (None, False))
            if name and (inside or j in stops):
                best = (name, j)
        if best:
            out.append((best[0], words[k][0], words[best[1]][1]))
            done = best[1] + 1
    return out


def licences(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(licence, start, end) by the ordered rules."""
    by: dict[str, list[int]] = {}
    for i, (name, _, _) in enumerate(found):
        by.setdefault(name, []).append(i)
    taken, out = [False] * len(found), []
    for licence, ids in RULES:
        if any(x not in by for x in ids):
            continue
        places = [[i for i in by[x] if not taken[i]] for x in ids]
        at = [0] * len(ids)
        for i in places[0]:
            chain = [i]
            for level in range(1, len(ids)):
                later = places[level]
                while at[level] < len(later) and (later[at[level]] <= chain[-1] or taken[later[at[level]]]):
                    at[level] += 1
                if at[level] == len(later) or found[later[at[level]]][1] - found[chain[-1]][2] > MAX_GAP:
                    break
                chain.append(later[at[level]])
            else:
                for j in chain:
                    taken[j] = True
                out.append((licence, found[chain[0]][1], found[chain[-1]][2]))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``sentences`` and ``licences``, both ``array<struct<name,start,end>>``."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    span = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(rows) -> pa.Array:
            return pa.array([[dict(zip(("name", "start", "end"), x, strict=True)) for x in row] for row in rows], span)

        for batch in batches:
            found = [sentences(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), spans(found), spans(map(licences, found))], names=[id_col, "sentences", "licences"])

    kind = "array<struct<name:string,start:int,end:int>>"
    return source.mapInArrow(scanned, f"`{id_col}` {source.schema[0].dataType.simpleString()}, sentences {kind}, licences {kind}")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda s: s["name"]))), ",")
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), names.alias("licences"), line("licences").alias("spans"), line("sentences").alias("sentences"))
