"""Licences by sentence identifiers and ordered rules (operator 8).

A text is cut into fragments at line ends, sentence ends and colons, and the
fragments are normalised. From each fragment on, the runs of one and more
fragments are compared with the known licence sentences, so that these may wrap
over lines and hold end marks. The identifiers found, in order, are matched
against rules: ordered identifier sequences that name a licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and text of known licence sentences.
SENTENCES = (
    ("mit-short", "Released under the MIT License."),
    ("mit-short-2", "Licensed under the MIT License."),
    ("mit-name", "The MIT License (MIT)"),
    ("mit-name-2", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-short", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-basis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl3-short", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl2-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-short", "Licensed under CC BY-NC 4.0."),
    ("cc-by-short", "Licensed under CC BY 4.0."),
    ("cc-by-sa-short", "Licensed under CC BY-SA 4.0."),
    ("cc0-short", "Licensed under CC0 1.0."),
    ("unlicense-1", "This is free and unencumbered software released into the public domain."),
    ("rights", "All rights reserved."),
    ("apache2-short", "Licensed under the Apache License 2.0."),
    ("apache-released", "Released under the Apache License, Version 2.0."),
    ("gpl3-short-2", "Released under the GNU General Public License, version 3."),
    ("gpl3-short-3", "Licensed under the GNU General Public License, version 3."),
    ("gpl2-short", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl2-short-2", "Licensed under the GNU General Public License, version 2."),
    ("gpl2-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl3-free", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-warranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("bsd3-short", "Licensed under the BSD 3-Clause License."),
    ("bsd2-short", "Licensed under the BSD 2-Clause License."),
    ("isc-short", "Licensed under the ISC License."),
    ("mpl2-short", "Licensed under the Mozilla Public License 2.0."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl2-form", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl2-short", "Licensed under the Eclipse Public License 2.0."),
    ("bsl1-form", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("cc-by-work", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd-work", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-work", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nd-short", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa-short", "Licensed under CC BY-NC-SA 4.0."),
    ("cc0-dedication", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense-2", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("spdx-mit", "SPDX-License-Identifier: MIT"),
    ("spdx-apache2", "SPDX-License-Identifier: Apache-2.0"),
    ("spdx-gpl2", "SPDX-License-Identifier: GPL-2.0-only"),
    ("spdx-gpl3", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("spdx-bsd2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("spdx-bsd3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("spdx-mpl2", "SPDX-License-Identifier: MPL-2.0"),
    ("spdx-isc", "SPDX-License-Identifier: ISC"),
    ("spdx-gpl2-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("spdx-gpl3-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("spdx-lgpl21", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("spdx-lgpl21-later", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("spdx-lgpl3", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("spdx-lgpl3-later", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("spdx-agpl3", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("spdx-agpl3-later", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("spdx-epl2", "SPDX-License-Identifier: EPL-2.0"),
    ("spdx-bsl1", "SPDX-License-Identifier: BSL-1.0"),
    ("spdx-zlib", "SPDX-License-Identifier: Zlib"),
    ("spdx-unlicense", "SPDX-License-Identifier: Unlicense"),
    ("spdx-cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("spdx-cc-by", "SPDX-License-Identifier: CC-BY-4.0"),
    ("spdx-cc-by-sa", "SPDX-License-Identifier: CC-BY-SA-4.0"),
)

#: Licence and the identifiers that name it, in order; other known sentences may stand between.
RULES = (
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short-2",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-name", "mit-grant")),
    ("MIT", ("mit-name-2", "mit-grant")),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-header", "apache-copy")),
    ("Apache-2.0", ("apache-header", "apache-basis")),
    ("GPL-3.0", ("gpl3-short",)),
    ("GPL-3.0", ("gpl-free", "gpl-warranty")),
    ("GPL-2.0", ("gpl2-free", "gpl-warranty")),
    ("LGPL-2.1", ("lgpl-free",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC0-1.0", ("cc0-short",)),
    ("Unlicense", ("unlicense-1",)),
    ("Unlicense", ("unlicense-2",)),
    ("Apache-2.0", ("apache2-short",)),
    ("Apache-2.0", ("apache-released",)),
    ("GPL-3.0", ("gpl3-short-2",)),
    ("GPL-3.0", ("gpl3-short-3",)),
    ("GPL-3.0", ("gpl-free", "gpl-copy")),
    ("GPL-2.0", ("gpl2-short",)),
    ("GPL-2.0", ("gpl2-short-2",)),
    ("GPL-2.0", ("gpl2-only",)),
    ("GPL-2.0", ("gpl2-free", "gpl-copy")),
    ("LGPL-3.0", ("lgpl3-free",)),
    ("AGPL-3.0", ("agpl3-free",)),
    ("BSD-3-Clause", ("bsd3-short",)),
    ("BSD-2-Clause", ("bsd2-short",)),
    ("ISC", ("isc-short",)),
    ("MPL-2.0", ("mpl2-short",)),
    ("EPL-2.0", ("epl2-form",)),
    ("EPL-2.0", ("epl2-short",)),
    ("BSL-1.0", ("bsl1-form",)),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin")),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-short",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-work",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-short",)),
    ("CC0-1.0", ("cc0-dedication",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache2",)),
    ("GPL-2.0", ("spdx-gpl2",)),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("BSD-2-Clause", ("spdx-bsd2",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("MPL-2.0", ("spdx-mpl2",)),
    ("ISC", ("spdx-isc",)),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-2.0", ("gpl2-free",)),
    ("GPL-2.0", ("spdx-gpl2-later",)),
    ("GPL-3.0", ("spdx-gpl3-only",)),
    ("LGPL-2.1", ("spdx-lgpl21",)),
    ("LGPL-2.1", ("spdx-lgpl21-later",)),
    ("LGPL-3.0", ("spdx-lgpl3",)),
    ("LGPL-3.0", ("spdx-lgpl3-later",)),
    ("AGPL-3.0", ("spdx-agpl3",)),
    ("AGPL-3.0", ("spdx-agpl3-later",)),
    ("EPL-2.0", ("spdx-epl2",)),
    ("BSL-1.0", ("spdx-bsl1",)),
    ("Zlib", ("spdx-zlib",)),
    ("Unlicense", ("spdx-unlicense",)),
    ("CC0-1.0", ("spdx-cc0",)),
    ("CC-BY-4.0", ("spdx-cc-by",)),
    ("CC-BY-SA-4.0", ("spdx-cc-by-sa",)),
)

#: ASCII characters that aren't letters or digits, no-break spaces, dashes and curly quotes; a run of them is one space in the normal form.
CURLY = "\xa0\u2010\u2011\u2013\u2014\u2018\u2019\u201c\u201d"
MARKS = rf"[\x00-\x2F\x3A-\x60\x7B-\x7F{CURLY}]+"

#: SPDX expressions: the operands of OR and AND are declarations of their own; what WITH adds is left out.
SPDX = "spdx-license-identifier:"
OPERATORS, EXCEPTION = r"[ \t()]+(?:or|and)[ \t()]+", r"[ \t]+with[ \t]+[^ \t()]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: str) -> str:
    """Normal form of a sentence in Python, for the tables above."""
    import re

    return re.sub(MARKS, " ", "".join(c.lower() if c.isascii() else c for c in text)).strip(" ")


def _longest_wrap(sentences) -> int:
    """A known sentence wraps over no more fragments than it has words."""
    return max(len(normal(s).split()) for _, s in sentences)


def _fragments(text: Column) -> Column:
    """Normal forms of the parts of a text between line ends and end marks, without empty ones."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    operands = lambda line: F.regexp_replace(F.regexp_replace(line, EXCEPTION, ""), OPERATORS, f"\n{SPDX} ")
    lines = F.transform(F.split(plain, "\n"), lambda line: F.when(line.contains(SPDX), operands(line)).otherwise(line))
    plain = F.when(plain.contains(SPDX), F.array_join(lines, "\n")).otherwise(plain)
    plain = F.regexp_replace(plain, r"[.!?:][ \t]+|\r\n?", "\n")
    plain = F.regexp_replace(plain, rf"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F{CURLY}]+", " ")
    return F.filter(F.split(F.regexp_replace(plain, r" *\n[ \n]*", "\n"), "\n"), lambda f: F.trim(f) != "")


def licence_sentences(text: Column, sentences=SENTENCES) -> Column:
    """Array of identifiers of the known sentences in a text, in order; of those with the same start the shorter first."""
    forms: dict[str, list] = {}
    for i, s in sorted(sentences, key=lambda x: len(normal(x[1]))):
        forms.setdefault(normal(s).split()[0], []).append(F.struct(F.lit(normal(s)).alias("form"), F.lit(i).alias("id")))
    known = F.create_map(*(x for w, entries in forms.items() for x in (F.lit(w), F.array(*entries))))
    wrap = _longest_wrap(sentences)

    def fits(run, form):
        size = F.length(form)
        return (F.translate(F.substring(run, F.lit(1), size), "\n", " ") == form) & F.substring(run, size + 1, F.lit(1)).isin("", "\n")

    def identify(all_fragments):
        def one(f, i):
            entries = F.try_element_at(known, F.substring_index(f, " ", 1))
            run = F.array_join(F.slice(all_fragments, i + 1, F.lit(wrap)), "\n")
            ids = lambda r: F.transform(F.filter(entries, lambda e: fits(r, e["form"])), lambda e: e["id"])
            return F.when(entries.isNotNull(), F.element_at(F.transform(F.array(run), ids), 1))

        return F.flatten(F.filter(F.transform(all_fragments, one), lambda x: x.isNotNull()))

    trimmed = F.transform(_fragments(text), lambda f: F.trim(f))
    return F.element_at(F.transform(F.array(trimmed), identify), 1)


def _within(short, long) -> bool:
    """Whether a sequence is part of a longer one, in order."""
    rest = iter(long)
    return len(short) < len(long) and all(x in rest for x in short)


def _longer(name: str, sequence, rules) -> list[tuple]:
    """Rules of other licences that a rule gives way to, as it is part of them."""
    return [s for n, s in rules if n != name and _within(sequence, s)]


def matched_licences(ids: Column, rules=RULES) -> Column:
    """Sorted, distinct licences whose rules' identifiers occur in ids in their order.

    A rule that is part of another licence's doesn't count over sentences that the longer one has taken.
    """

    def fits(sequence, of):
        wanted = F.array(*(F.lit(x) for x in sequence))
        return F.aggregate(of, F.lit(0), lambda k, x: F.when(F.get(wanted, k) == x, k + 1).otherwise(k)) == len(sequence)

    def left(sequence, of):
        """of without the sentences of whole runs of the sequence; each run begins after the one before."""
        wanted, n = F.array(*(F.lit(x) for x in sequence)), len(sequence)
        start = F.struct(F.lit(0).alias("k"), F.array().cast("array<struct<x: string, run: int>>").alias("out"))
        goes_on = lambda acc, x: F.get(wanted, acc["k"] % n) == x
        add = lambda acc, x: F.array_append(acc["out"], F.struct(x.alias("x"), F.when(goes_on(acc, x), F.floor(acc["k"] / n)).otherwise(-1).cast("int").alias("run")))
        step = lambda acc, x: F.struct((acc["k"] + goes_on(acc, x).cast("int")).alias("k"), add(acc, x).alias("out"))
        done = lambda acc: F.transform(F.filter(acc["out"], lambda o: (o["run"] < 0) | (o["run"] >= F.floor(acc["k"] / n))), lambda o: o["x"])
        return F.aggregate(of, start, step, done)

    def counts(name, sequence):
        of = ids
        for s in _longer(name, sequence, rules):
            of = F.when(fits(s, of), left(s, of)).otherwise(of)
        return fits(sequence, of)

    found = F.array_compact(F.array(*(F.when(counts(n, s), F.lit(n)) for n, s in rules)))
    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(found)))


def scan_licences(docs: DataFrame, sentences=SENTENCES, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids and licences (arrays) of every row, from the whole text.

    Null and empty texts have none; null ids stay; repeated rows stay; a sentence
    that occurs twice is listed twice; an empty table gives no rows. No shuffle.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), licence_sentences(F.col(text_col).cast("string"), sentences).alias("sentence_ids"))
    return found.select("doc_id", "sentence_ids", matched_licences(F.col("sentence_ids"), rules).alias("licences"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Sentence identifiers and licences of every document, comma-joined."""
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rules_sql() -> str:
    """name, pattern, and what the longer rule takes out of ',id,,id,' lists (its runs, by the expression and what it leaves)."""
    rows = []
    for name, sequence in RULES:
        longer = _longer(name, sequence, RULES)
        assert len(longer) < 2
        take = "".join(f",{x},(.*?)" for x in longer[0])[: -len("(.*?)")] if longer else "^$"
        leave = "".join(f"\\{k}" for k in range(1, len(longer[0]))) if longer else ""
        rows.append(f"({_quoted(name)}, {_quoted('%,' + ',%,'.join(sequence) + ',%')}, {_quoted(take)}, {_quoted(leave)})")
    return ", ".join(rows)


#: The same result in SQL: fragments as rows, each compared with the known sentences of its first word; rules as patterns.
ORACLE_SQL = f"""
WITH known(id, s) AS (VALUES {", ".join(f"({_quoted(i)}, {_quoted(normal(s))})" for i, s in SENTENCES)}),
 rules(name, pattern, take, leave) AS (VALUES {_rules_sql()}),
 low AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents),
 spdx AS (SELECT doc_id, CASE WHEN contains(x, '{SPDX}') THEN array_to_string(list_transform(string_split(x, chr(10)), lambda y: CASE WHEN contains(y, '{SPDX}') THEN regexp_replace(regexp_replace(y, '{EXCEPTION}', '', 'g'), '{OPERATORS}', chr(10) || '{SPDX} ', 'g') ELSE y END), chr(10)) ELSE x END AS x FROM low),
 plain AS (SELECT doc_id, regexp_replace(x, '[.!?:][ \t]+|\r\n?', chr(10), 'g') AS x FROM spdx),
 f AS (SELECT doc_id, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(regexp_replace(y, '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F{CURLY}]+', ' ', 'g'), ' ')), lambda y: y <> '') AS fs FROM plain),
 p AS (SELECT doc_id, fs, unnest(fs) AS fragment, unnest(range(len(fs))) AS i FROM f),
 q AS (SELECT doc_id, i, split_part(fragment, ' ', 1) AS word, array_to_string(fs[i + 1 : i + {_longest_wrap(SENTENCES)}], chr(10)) AS run FROM p WHERE split_part(fragment, ' ', 1) IN (SELECT split_part(s, ' ', 1) FROM known)),
 hit AS (SELECT doc_id, i, id, length(s) AS size FROM q JOIN known ON split_part(s, ' ', 1) = word AND replace(substr(run, 1, length(s)), chr(10), ' ') = s AND substr(run, length(s) + 1, 1) IN ('', chr(10))),
 ids AS (SELECT doc_id, string_agg(id, ',' ORDER BY i, size) AS sentence_ids FROM hit GROUP BY doc_id),
 lic AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM ids JOIN rules ON regexp_replace(',' || replace(sentence_ids, ',', ',,') || ',', take, leave, 'g') LIKE pattern GROUP BY doc_id)
SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(licences, '') AS licences FROM documents LEFT JOIN ids USING (doc_id) LEFT JOIN lic USING (doc_id)
"""
