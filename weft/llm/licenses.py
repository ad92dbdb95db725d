"""License scans by sentence rules.

Texts are cut into sentences three times: at line ends and sentence ends, at sentence ends alone (for notices wrapped over
lines), and from each line's start to the sentence's end (a title line before a notice); of the last, those over four times as
long as the longest known sentence are left out: they cannot be one. A sentence is normalised (A-Z lowered, comment marks and punctuation dropped, blanks folded, years and names of a
copyright line replaced) and looked up among the known sentences; those found give a sequence of identifiers in text order. A
rule is an ordered sequence of identifiers; it matches where its identifiers follow one another with at most ``gap``
unknown sentences between two. Of matches that overlap the longest rule wins, then the earlier, then the smaller name.

Sentences and rules are parameters of a bounded size; texts are read whole, one at a time, and no row is moved.

Defined cases: null and empty texts have no sentence and no license; repeated rows are scanned one by one; an empty table
gives no rows; columns of docs stay as they are: the result is one more column, a struct named by ``into``.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weft.llm.common import read_table

#: Sentences of public license notices, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-name": "MIT License",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache2-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache2-the-license": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache2-compliance": "you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-or-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl21-version": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-or-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-or-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsl1": "Distributed under the Boost Software License, Version 1.0.",
    "all-rights": "All rights reserved.",
}
#: Ordered rules, by license expression.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("Apache-2.0", ("apache2-the-license", "apache2-compliance", "apache2-copy", "apache2-as-is")),
    ("Apache-2.0", ("apache2-licensed",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-or-later", ("gpl3-or-later", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl3-or-later",)),
    ("GPL-2.0-or-later", ("gpl2-terms", "gpl2-version", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-terms", "gpl2-version")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-terms", "lgpl21-version")),
    ("LGPL-3.0-or-later", ("lgpl3-or-later",)),
    ("AGPL-3.0-or-later", ("agpl3-or-later",)),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("EPL-2.0", ("epl2",)),
    ("BSL-1.0", ("bsl1",)),
    ("LicenseRef-all-rights-reserved", ("all-rights",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC0-1.0", ("cc0",)),
)
_LINE_OR_END = re.compile(r"[^\n]*?(?:[.;:!?](?=\s|$)|\n|$)")
_END = re.compile(r"(?s).*?(?:[.;:!?](?=\s|$)|\n\s*\n|$)")
_DROP = re.compile(r"[^0-9a-z\u0080-\U0010ffff]+")
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_SOLID = re.compile(r"\S")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_COPYRIGHT = re.compile(r"^(?:copyright|c) .*")


def normalise(sentence: str) -> str:
    words = _DROP.sub(" ", sentence.translate(_LOWER)).strip()
    return _COPYRIGHT.sub("copyright", words)


def heads(known: Iterable[str]) -> set[tuple[str, ...]]:
    """The first words, three at most, of normalised sentences."""
    return {tuple(words.split()[:3]) for words in known}


def _begins(text: str, at: int, end: int, known: set[tuple[str, ...]]) -> bool:
    """Whether the text from ``at`` on begins as one of them does."""
    words: list[str] = []
    for m in _WORD.finditer(text, at, end):
        words.append(m.group().translate(_LOWER))
        if tuple(words) in known or len(words) == 1 and words[0] in ("c", "copyright") and ("copyright",) in known:
            return True
        if len(words) == 3:
            break
    return False


def sentences(text: str, longest: int, known: set[tuple[str, ...]]) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of all sentences of the three cuts, in order of start, then end; equal spans once. The third cut, from a line's start to the
    sentence's end, is normalised only at lines that begin as a known sentence does; of others the start alone is kept (end -1, no words)."""
    spans, found = {m.span() for cut in (_LINE_OR_END, _END) for m in cut.finditer(text)}, set()
    for a, b in [m.span() for m in _END.finditer(text)]:
        at = max(a, b - 4 * longest)
        while 0 <= (at := text.find("\n", at, b)) < b:
            at += 1
            if _begins(text, at, b, known):
                spans.add((at, b))
            elif _WORD.search(text, at, b):
                found.add((_SOLID.search(text, at, b).start(), -1, ""))  # counts as a start
    for a, b in spans:
        part = text[a:b]
        if words := normalise(part):
            start = a + len(part) - len(part.lstrip())
            found.add((start, start + len(part.strip()), words))
    return sorted(found)


class Scanner:
    def __init__(self, known: dict[str, str], rules, gap: int):
        self.ids = {normalise(s): name for name, s in known.items()}
        #: Every known sentence has one of these words: a text without any has none.
        self.cue = re.compile("|".join(map(re.escape, sorted({min(words.split(), key=lambda w: (-len(w), w)) for words in self.ids}))))
        self.longest, self.heads = max(map(len, self.ids)), heads(self.ids)
        self.rules, self.gap = rules, gap

    def known(self, text: str) -> tuple[int, list[tuple[int, int, int, str]]]:
        """(sentences, [(ordinal, start, end, id)]): the ordinal counts sentences of the finer cut before it."""
        every = sentences(text, self.longest, self.heads)
        out, number, lines = [], 0, 0
        reached = -1
        for start, end, words in every:
            if start > reached:
                lines += 1
                number, reached = lines, start
            if words in self.ids:
                out.append((number, start, end, self.ids[words]))
        return lines, out

    def scan(self, text: str | None) -> dict:
        none = {"n_known": 0, "sentence_ids": "", "licenses": "", "n_matches": 0, "first_start": -1, "last_end": -1}
        if not text or not self.cue.search(text.translate(_LOWER)):
            return none
        _, found = self.known(text)
        if not found:
            return none
        matches = []
        for name, rule in self.rules:
            for i in range(len(found)):
                at = self.match(found, i, rule)
                if at is not None:
                    matches.append((-len(rule), found[i][1], name, found[at][2]))
        taken: list[tuple[int, int, str]] = []  # in order and apart, so that only the neighbours of a place can overlap it
        for _, start, name, end in sorted(matches):
            at = bisect.bisect_left(taken, (start, end, ""))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                taken.insert(at, (start, end, name))
        return {
            "n_known": len(found), "sentence_ids": ",".join(f[3] for f in found), "licenses": ",".join(sorted({n for _, _, n in taken})), "n_matches": len(taken),
            "first_start": taken[0][0] if taken else -1, "last_end": max((b for _, b, _ in taken), default=-1),
        }

    def match(self, found, i: int, rule) -> int | None:
        """Index of the last sentence of a match that begins with sentence i."""
        if found[i][3] != rule[0]:
            return None
        for want in rule[1:]:
            number, end = found[i][0], found[i][2]
            for j in range(i + 1, len(found)):
                if found[j][0] - number > self.gap + 1:
                    return None
                if found[j][1] >= end and found[j][3] == want:
                    i = j
                    break
            else:
                return None
        return i


RESULT = T.StructType([
    T.StructField("n_known", T.LongType()), T.StructField("sentence_ids", T.StringType()), T.StructField("licenses", T.StringType()),
    T.StructField("n_matches", T.LongType()), T.StructField("first_start", T.LongType()), T.StructField("last_end", T.LongType()),
])
_ARROW = pa.struct([("n_known", pa.int64()), ("sentence_ids", pa.string()), ("licenses", pa.string()), ("n_matches", pa.int64()), ("first_start", pa.int64()), ("last_end", pa.int64())])


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules=RULES, gap: int = 2, into: str = "_license") -> DataFrame:
    """docs with a struct column ``into``: n_known, sentence_ids, licenses (names, comma-joined), n_matches, first_start, last_end (code points)."""
    scanner = Scanner(known, rules, gap)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([scanner.scan(t) for t in texts], _ARROW)], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, RESULT)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_license.*")
