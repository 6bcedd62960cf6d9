"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (lower case, runs of other characters than letters and digits
as one space), and known licence sentences are mapped to identifiers. The identifiers of a text, in order and
without the unknown sentences, are matched against ordered rules: a rule names sentences that must follow one
another, anything between them. Within a family the first rule that matches counts, so that a longer licence
stands before the shorter one it contains.

Sentences end at . ! ? ; or : before white space, and at blank lines. As licence lines often stand alone among
other lines, a second reading ends sentences at every line break too; a rule may match in either reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.llm import text

# Licence sentences in normal form, by identifier.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-project": "this project is licensed under the mit license",
    "mit-see": "this software is released under the mit license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-licensed": "licensed under the isc license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-licensed": "licensed under the bsd license",
    "bsd-2-licensed": "licensed under the bsd 2 clause license",
    "bsd-3-licensed": "licensed under the bsd 3 clause license",
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-3-licensed": "licensed under the gnu general public license version 3",
    "gpl-2-licensed": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software",
    "gpl-2-or-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-3-or-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "agpl-3-licensed": "licensed under the gnu affero general public license version 3",
    "lgpl-3-licensed": "licensed under the gnu lesser general public license version 3",
    "lgpl-2-1-licensed": "licensed under the gnu lesser general public license version 2 1",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-licensed": "licensed under the mozilla public license version 2 0",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "cc0-licensed": "licensed under cc0 1 0",
    "cc-by-4-licensed": "licensed under cc by 4 0",
    "cc-by-sa-4-licensed": "licensed under cc by sa 4 0",
    "cc-by-nc-4-licensed": "licensed under cc by nc 4 0",
    "cc-by-nd-4-licensed": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-4-licensed": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd-4-licensed": "licensed under cc by nc nd 4 0",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-bsd-2": "spdx license identifier bsd 2 clause",
    "spdx-bsd-3": "spdx license identifier bsd 3 clause",
    "spdx-gpl-2": "spdx license identifier gpl 2 0 only",
    "spdx-gpl-3": "spdx license identifier gpl 3 0 only",
    "spdx-mpl": "spdx license identifier mpl 2 0",
    "spdx-isc": "spdx license identifier isc",
    "spdx-0bsd": "spdx license identifier 0bsd",
    "spdx-unlicense": "spdx license identifier unlicense",
    "spdx-cc0": "spdx license identifier cc0 1 0",
    "spdx-lgpl-2-1": "spdx license identifier lgpl 2 1 only",
    "spdx-lgpl-3": "spdx license identifier lgpl 3 0 only",
    "spdx-agpl-3": "spdx license identifier agpl 3 0 only",
    "spdx-gpl-2-later": "spdx license identifier gpl 2 0 or later",
    "spdx-gpl-3-later": "spdx license identifier gpl 3 0 or later",
    "spdx-epl-2": "spdx license identifier epl 2 0",
    "spdx-bsl": "spdx license identifier bsl 1 0",
    "spdx-zlib": "spdx license identifier zlib",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "boost-licensed": "distributed under the boost software license version 1 0",
    "epl-1-licensed": "licensed under the eclipse public license version 1 0",
    "epl-2-licensed": "licensed under the eclipse public license version 2 0",
    "epl-2-made": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "artistic-2-licensed": "licensed under the artistic license 2 0",
    "lgpl-library": "this library is free software",
    "lgpl-2-1-or-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-or-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3-or-later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "cc-by-sa-3-licensed": "licensed under cc by sa 3 0",
    "cc-by-3-licensed": "licensed under cc by 3 0",
    "cc0-waived": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "all-rights": "all rights reserved",
}

# Fixed values: (family, licence, sentences in order); the first match within a family counts.
RULES = (
    ("mit", "MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liable")),
    ("mit", "MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("mit", "MIT", ("mit-grant", "mit-notice")),
    ("mit", "MIT", ("mit-released",)),
    ("mit", "MIT", ("mit-licensed",)),
    ("mit", "MIT", ("mit-project",)),
    ("mit", "MIT", ("mit-see",)),
    ("mit", "MIT", ("spdx-mit",)),
    ("isc", "ISC", ("isc-grant",)),
    ("isc", "ISC", ("isc-licensed",)),
    ("isc", "ISC", ("spdx-isc",)),
    ("0bsd", "0BSD", ("0bsd-grant",)),
    ("0bsd", "0BSD", ("spdx-0bsd",)),
    ("zlib", "Zlib", ("zlib-warranty", "zlib-origin", "zlib-altered")),
    ("zlib", "Zlib", ("spdx-zlib",)),
    ("boost", "BSL-1.0", ("boost-licensed",)),
    ("boost", "BSL-1.0", ("spdx-bsl",)),
    ("bsd", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd", "BSD-3-Clause", ("bsd-3-licensed",)),
    ("bsd", "BSD-3-Clause", ("spdx-bsd-3",)),
    ("bsd", "BSD-2-Clause", ("bsd-2-licensed",)),
    ("bsd", "BSD-2-Clause", ("spdx-bsd-2",)),
    ("bsd", "BSD", ("bsd-licensed",)),
    ("apache", "Apache-2.0", ("apache-header", "apache-may-not", "apache-copy")),
    ("apache", "Apache-2.0", ("apache-licensed",)),
    ("apache", "Apache-2.0", ("apache-header",)),
    ("apache", "Apache-2.0", ("spdx-apache",)),
    ("gpl", "GPL-3.0-or-later", ("gpl-free", "gpl-3-or-later")),
    ("gpl", "GPL-2.0-or-later", ("gpl-free", "gpl-2-or-later")),
    ("gpl", "GPL-3.0-only", ("gpl-3-work",)),
    ("gpl", "GPL-3.0-only", ("gpl-3-licensed",)),
    ("gpl", "GPL-3.0-only", ("spdx-gpl-3",)),
    ("gpl", "GPL-2.0-only", ("gpl-2-licensed",)),
    ("gpl", "GPL-2.0-only", ("spdx-gpl-2",)),
    ("gpl", "GPL-3.0-or-later", ("spdx-gpl-3-later",)),
    ("gpl", "GPL-2.0-or-later", ("spdx-gpl-2-later",)),
    ("agpl", "AGPL-3.0-or-later", ("gpl-free", "agpl-3-or-later")),
    ("agpl", "AGPL-3.0-only", ("agpl-3-licensed",)),
    ("agpl", "AGPL-3.0-only", ("spdx-agpl-3",)),
    ("lgpl", "LGPL-3.0-or-later", ("lgpl-library", "lgpl-3-or-later")),
    ("lgpl", "LGPL-2.1-or-later", ("lgpl-library", "lgpl-2-1-or-later")),
    ("lgpl", "LGPL-3.0-only", ("spdx-lgpl-3",)),
    ("lgpl", "LGPL-2.1-only", ("spdx-lgpl-2-1",)),
    ("lgpl", "LGPL-3.0-only", ("lgpl-3-licensed",)),
    ("lgpl", "LGPL-2.1-only", ("lgpl-2-1-licensed",)),
    ("mpl", "MPL-2.0", ("mpl-form", "mpl-copy")),
    ("mpl", "MPL-2.0", ("mpl-form",)),
    ("mpl", "MPL-2.0", ("mpl-licensed",)),
    ("mpl", "MPL-2.0", ("spdx-mpl",)),
    ("epl", "EPL-2.0", ("epl-2-made",)),
    ("epl", "EPL-2.0", ("epl-2-licensed",)),
    ("epl", "EPL-2.0", ("spdx-epl-2",)),
    ("epl", "EPL-1.0", ("epl-1-licensed",)),
    ("artistic", "Artistic-2.0", ("artistic-2-licensed",)),
    ("unlicense", "Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("unlicense", "Unlicense", ("unlicense-domain",)),
    ("unlicense", "Unlicense", ("spdx-unlicense",)),
    ("cc0", "CC0-1.0", ("cc0-licensed",)),
    ("cc0", "CC0-1.0", ("cc0-waived",)),
    ("cc0", "CC0-1.0", ("spdx-cc0",)),
    ("cc-by-3", "CC-BY-3.0", ("cc-by-3-licensed",)),
    ("cc-by-sa-3", "CC-BY-SA-3.0", ("cc-by-sa-3-licensed",)),
    ("cc-by", "CC-BY-4.0", ("cc-by-4-licensed",)),
    ("cc-by", "CC-BY-4.0", ("cc-by-4-work",)),
    ("cc-by-sa", "CC-BY-SA-4.0", ("cc-by-sa-4-licensed",)),
    ("cc-by-sa", "CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("cc-by-nc", "CC-BY-NC-4.0", ("cc-by-nc-4-licensed",)),
    ("cc-by-nc", "CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("cc-by-nd", "CC-BY-ND-4.0", ("cc-by-nd-4-licensed",)),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-licensed",)),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-licensed",)),
    ("reserved", "LicenseRef-all-rights-reserved", ("all-rights",)),
)

#: Every known sentence has one of these words; a text without them has no sentence to look up.
ANCHORS = ("licen", "copyright", "warrant", "permission", "software", "redistribut", "reserved", "mpl", "gnu")

_ENDS = r"[.!?;:]+(?:\s+|$)|\n\s*\n"
_LINES = r"[.!?;:]+(?:\s+|$)|\n"


def identifiers(value: Column, ends: str) -> Column:
    """Identifiers of the known sentences of a text, in order, repeats included."""
    known = F.create_map(*[F.lit(x) for key, sentence in SENTENCES.items() for x in (sentence, key)])
    sentences = F.transform(F.split(value, ends), lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.filter(F.transform(sentences, lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())


def _matches(rule: tuple[str, ...]) -> Column:
    pattern = "%" + "%".join(f"<{i}>" for i in rule) + "%"
    return F.col("by_ends").like(pattern) | F.col("by_lines").like(pattern)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `documents`: id, sentences, licences (both array<string>). No shuffle, no Python.

    sentences: identifiers in text order, from the reading that ends sentences at lines too where it finds
    more, else from the other. licences: by order of RULES, each once. Null and empty texts have neither; repeated
    rows are alike, an empty table gives no rows. An id column named as one of the others gets underscores behind its name.
    """
    name = text.free_name(["sentences", "licences"], id_col)
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    relevant = F.lit(False)
    for anchor in ANCHORS:
        relevant = relevant | F.contains(low, F.lit(anchor))
    none = F.array().cast("array<string>")
    value = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), F.when(relevant, identifiers(value, _ENDS)).otherwise(none).alias("ends"), F.when(relevant, identifiers(value, _LINES)).otherwise(none).alias("lines"))
    shown = lambda column: F.array_join(F.transform(column, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    rows = rows.select("id", F.when(F.size("lines") > F.size("ends"), F.col("lines")).otherwise(F.col("ends")).alias("sentences"), shown("ends").alias("by_ends"), shown("lines").alias("by_lines"))
    families: dict[str, Column] = {}
    for family, licence, rule in reversed(RULES):
        rest = families.get(family, F.lit(None).cast("string"))
        families[family] = F.when(_matches(rule), F.lit(licence)).otherwise(rest)
    in_order = list(dict.fromkeys(family for family, _, _ in RULES))
    found = F.when(F.size("sentences") > 0, F.array_compact(F.array(*[families[f] for f in in_order]))).otherwise(none)
    return rows.select(F.col("id").alias(name), "sentences", found.alias("licences"))
