"""License scans by sentence rules.

A text is cut into sentences; each is normalised (letters and digits only, lower case, single
spaces) and looked up among known licence sentences, which gives its identifier.  The sequence
of identifiers is then matched against ordered rules: a rule is a run of identifiers, the first
rules are the most specific, and what a rule matches is used up.  What no rule explains is
reported too.

A sentence ends at a stop before white space; between stops, any run of whole lines may be one, so
titles without a stop and sentences wrapped over lines, with or without blank lines, are known
side by side.  At each place the longest known run counts, in the order of the text.

All in DataFrame functions, map only: the tables are a few hundred constants of this module, so
nothing is shuffled and nothing is broadcast but the plan.  Texts without any trigger word (every
known sentence has one) aren't cut at all.

Defined results: null, empty or blank texts have no sentences; repeated rows are scanned again;
a sentence that occurs several times counts each time; ties can't occur, as rules are ordered;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import let

# Names by which texts refer to a licence.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "MIT": ["MIT License", "MIT licence", "terms of the MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
# What comes before such a name in a sentence.
LEADS = [
    "Licensed under",
    "Released under",
    "Distributed under",
    "This work is licensed under",
    "This project is licensed under",
    "This software is licensed under",
    "This file is licensed under",
    "This program is licensed under",
    "This content is licensed under",
]
# Sentences of licence texts and headers, by identifier.
SENTENCES = {
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mit-liable": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
    ],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache-header": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-no-use": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl2-or-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"],
    "gpl3-or-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "public-domain": ["This is free and unencumbered software released into the public domain"],
    "all-rights": ["All rights reserved", "Copyright all rights reserved"],
}
# Runs of identifiers and what they mean; earlier rules win.
RULES = [
    ("Apache-2.0", ["apache-header", "apache-no-use", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-header", "apache-no-use", "apache-copy"]),
    ("Apache-2.0", ["apache-header"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0-or-later", ["gpl3-or-later", "gpl-warranty", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl3-or-later", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-or-later"]),
    ("GPL-2.0-or-later", ["gpl2-or-later", "gpl-warranty", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-or-later", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-or-later"]),
    ("Unlicense", ["public-domain"]),
]
#: A known sentence has one of these.
TRIGGERS = ["licen", "copyright", "permi", "warrant", "redistribut", "public domain", "gpl", "mpl", "cc by", "cc-by", "cc0", "apache", "rights reserved", "liable"]


def normal(sentence: str) -> str:
    return re.sub("[^A-Za-z0-9]+", " ", sentence).strip().lower()


def known_sentences() -> dict[str, str]:
    """Identifier of each normalised known sentence: the listed ones, and leads with names."""
    found = {normal(s): i for i, ss in SENTENCES.items() for s in ss}
    for licence, names in NAMES.items():
        for lead in LEADS:
            for name in names:
                for article in ("", "a ", "the "):
                    for tail in ("", " license"):
                        found.setdefault(normal(f"{lead} {article}{name}{tail}"), f"named:{licence}")
    return found


def rules() -> list[tuple[str, str]]:
    """``(licence, run)`` in order, a run written as ``;a;b;``."""
    return [(k, f";{';'.join(ids)};") for k, ids in RULES] + [(k, f";named:{k};") for k in NAMES]


def _identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of ``text``, in its order."""
    known = known_sentences()
    table = F.str_to_map(F.lit("\n".join(f"{s}\t{i}" for s, i in known.items())), F.lit("\n"), F.lit("\t"))  # constant: folded
    # what no known sentence can be isn't looked up: another first word, more lines than words, more letters
    first = f"^(?:{'|'.join(sorted({s.split(' ')[0] for s in known}))})(?: |$)"
    most_lines, most_chars = max(len(s.split(" ")) for s in known), max(map(len, known))
    none = F.array().cast("array<string>")

    def runs(lines: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.rlike(F.get(lines, i), F.lit(first)))
        begin = F.struct(F.lit(0).alias("next"), none.alias("ids"))
        found = F.aggregate(begins, begin, lambda acc, i: F.when(i < acc["next"], acc).otherwise(let(longest(lines, i), lambda x: F.when(x.isNull(), acc).otherwise(F.struct(x["end"].alias("next"), F.array_append(acc["ids"], x["id"]).alias("ids"))))))
        return F.when(F.size(lines) > 0, found["ids"]).otherwise(none)

    def longest(lines: Column, i: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.size(lines) - i, F.lit(most_lines)))
        told = F.transform(sizes, lambda k: let(F.array_join(F.slice(lines, i + 1, k), " "), lambda s: F.struct((i + k).alias("end"), F.when(F.length(s) <= most_chars, F.try_element_at(table, s)).alias("id"))))
        return F.try_element_at(F.filter(told, lambda x: x["id"].isNotNull()), F.lit(-1))

    def lines_of(part: Column) -> Column:
        return F.filter(F.transform(F.split(part, "\n"), lambda s: F.lower(F.trim(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))), lambda s: s != "")

    parts = F.split(F.regexp_replace(F.translate(text, "\x01", " "), r"[.!?:;](?=[ \t\r\n])", "\x01"), "\x01")
    return F.flatten(F.transform(parts, lambda p: let(lines_of(p), runs)))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_known, sentence_ids, licenses, unexplained)`` of each row of ``docs``.

    ``licenses`` are joined with commas in the order of the rules, each once a matching rule;
    empty where nothing is known.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # blanks of a trigger may be anything that normalises to one, line ends too
    spaced = "|".join(x.replace(" ", "[^a-z0-9]+") for x in TRIGGERS if " " in x)
    triggered = let(F.lower(text), lambda t: reduce(or_, (F.contains(t, F.lit(x)) for x in TRIGGERS if " " not in x)) | F.rlike(t, F.lit(spaced)))
    found = F.when(triggered, _identifiers(text)).otherwise(F.array().cast("array<string>"))

    rule_rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(run).alias("run")) for k, run in rules()])
    begin = F.struct(F.concat(F.lit(";"), F.array_join("found", ";"), F.lit(";")).alias("left"), F.array().cast("array<string>").alias("got"))
    matched = F.aggregate(
        rule_rows,
        begin,
        lambda acc, r: F.struct(
            F.replace(acc["left"], r["run"], F.lit(";")).alias("left"),
            F.when(F.contains(acc["left"], r["run"]), F.array_append(acc["got"], r["k"])).otherwise(acc["got"]).alias("got"),
        ),
    )
    none = F.struct(F.lit(";").alias("left"), F.array().cast("array<string>").alias("got"))
    return (
        docs.select(F.col(id_col).alias("doc_id"), found.alias("found"))
        .select("doc_id", "found", F.when(F.size("found") > 0, matched).otherwise(none).alias("m"))
        .select(
            "doc_id",
            F.size("found").cast("long").alias("n_known"),
            F.array_join("found", ";").alias("sentence_ids"),
            F.array_join(F.array_distinct("m.got"), ",").alias("licenses"),
            F.array_join(F.filter(F.split("m.left", ";"), lambda x: x != ""), ";").alias("unexplained"),
        )
    )
