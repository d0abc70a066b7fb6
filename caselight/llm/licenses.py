"""Licence statements in texts by sentence rules, with column functions only.

A text's sentences are normalised and looked up among known licence sentences; the identifiers
found, in order, are matched against rules, each an ordered run of identifiers. A rule that is
part of a longer one only counts where the longer one doesn't match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences as written; they are compared in normal form.
SENTENCES = {
    "mit-ref": "Released under the MIT License.",
    "mit-ref2": "Licensed under the MIT License.",
    "mit-ref3": "This project is licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "mit-liable": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-ref2": "Released under the Apache License, Version 2.0.",
    "apache-head": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl2-ref": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl3-ref": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl3-ref": "This work is licensed under the GNU Affero General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-merchant": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "cc-by-ref": "Licensed under CC BY 4.0.",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-ref": "Licensed under CC BY-ND 4.0.",
    "cc0-ref": "Released under CC0 1.0.",
    "public-domain": "This work is in the public domain.",
    "bsd-head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-ref": "Released under the BSD License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-ref": "Licensed under the Mozilla Public License, Version 2.0.",
    "reserved": "All rights reserved.",
}

#: Ordered rules: licence, and the run of identifiers that shows it.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-asis", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-ref2"]),
    ("MIT", ["mit-ref3"]),
    ("Apache-2.0", ["apache-head", "apache-comply", "apache-copy", "apache-asis", "apache-see"]),
    ("Apache-2.0", ["apache-head", "apache-comply"]),
    ("Apache-2.0", ["apache-ref"]),
    ("Apache-2.0", ["apache-ref2"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-merchant", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0", ["gpl2-ref"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("LGPL-3.0", ["lgpl3-ref"]),
    ("AGPL-3.0", ["agpl3-ref"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("public-domain", ["public-domain"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-ref"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-head"]),
    ("MPL-2.0", ["mpl-ref"]),
    ("proprietary", ["reserved"]),
]
#: Every known sentence, in normal form, holds one of these.
ANCHORS = ("licen", "permi", "warrant", "copyright", "reserved", "public domain", "cc by", "cc0", "redistribut", "liable", "use this file")


#: Where a text is split: behind . ! ? ; or : and white space, and at empty lines.
BREAKS = r"([.!?;:])\s+|\n\s*\n"


def normal(text: str) -> str:
    """Normal form of a sentence: a-z and 0-9 in runs, lower-cased, joined by one space."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def normal_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _lookup(known: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])


def parts_of(sentence: str) -> list[str]:
    """Normal forms of the parts that ``sentence_ids`` splits a sentence into."""
    parts = re.sub(BREAKS, lambda m: f"{m[1] or ''}\u0001", sentence, flags=re.ASCII).split("\u0001")
    return [x for x in map(normal, parts) if x]


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order.

    Sentences end behind . ! ? ; or : and white space, or at an empty line. One that isn't known
    as a whole is looked at line by line, since a statement may follow on unfinished text. A known
    sentence with such an end inside is the run of its parts, with no other words between them.
    """
    numbers: dict[str, str] = {}
    runs: dict[str, str] = {}
    for name, s in sentences.items():
        for own in ([normal(s)], parts_of(s)):
            runs["".join(numbers.setdefault(x, f" {len(numbers)};") for x in own)] = name
    table = _lookup({**numbers, "": ""})
    unknown = F.lit(" -;")
    parts = F.split(F.regexp_replace(text, BREAKS, "$1\u0001"), "\u0001")

    def found(part: Column) -> Column:
        whole = F.get(F.array(F.element_at(table, normal_form(part))), F.lit(0))
        lines = F.transform(F.split(part, "\n"), lambda x: F.coalesce(F.element_at(table, normal_form(x)), unknown))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(lines)

    sequence = F.concat_ws("", F.flatten(F.transform(parts, found)))
    longest = "|".join(sorted(runs, key=lambda r: -r.count(";")))
    names = _lookup(runs)
    return F.transform(F.regexp_extract_all(sequence, F.lit(longest), F.lit(0)), lambda m: F.element_at(names, m))


def scanned(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """The rows of ``docs`` (text, ...) with sentence_ids (known sentences in order), matches
    (runs of identifiers that a rule covers, in order) and licenses (their distinct names,
    sorted), all arrays of strings.

    Rules cover the identifiers from left to right, at each place the longest that fits; covered
    identifiers aren't used again, others are skipped. Null, empty and unlicensed texts have
    empty arrays. Texts without any anchor of a known sentence are passed over at once, which
    changes no result. Every row is scanned by itself: null ids, repeated rows and an empty table
    are fine. Columns of ``docs`` of these names are replaced.
    """
    if odd := [s for s in sentences.values() if not any(a in normal(s) for a in ANCHORS)]:
        raise ValueError(f"no anchor in {odd}")
    docs = docs.drop("sentence_ids", "matches", "licenses")
    none = F.array().cast("array<string>")
    text = F.coalesce(F.col("text"), F.lit(""))
    # anchors may be spread by other characters than a space
    anchored = text.rlike("(?i)" + "|".join(a.replace(" ", "[^a-zA-Z0-9]+") for a in ANCHORS))
    rows = docs.select("*", F.when(anchored, sentence_ids(text, sentences)).otherwise(none).alias("sentence_ids"))
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    runs = "|".join("".join(f" {x};" for x in run) for _, run in ordered)
    names = _lookup({"".join(f" {x};" for x in run): name for name, run in ordered})
    sequence = F.concat_ws("", F.transform("sentence_ids", lambda x: F.concat(F.lit(" "), x, F.lit(";"))))
    rows = rows.select("*", F.regexp_extract_all(sequence, F.lit(runs), F.lit(0)).alias("matches"))
    return rows.select("*", F.array_sort(F.array_distinct(F.transform("matches", lambda m: F.element_at(names, m)))).alias("licenses"))
