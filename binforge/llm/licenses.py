"""Licence scans by sentence rules, with DataFrame functions.

Texts are cut into sentences (at blank lines, and after . ; : ! ? before white space, but not in "v. 2") and normalised:
A-Z in lower case, anything but a-z and 0-9 as one space. Lines of a sentence are joined where a known one is wrapped, so
it can be a line or several whole ones. Known licence sentences turn into identifiers; a document's identifiers in
order of position are its sequence. A rule is a sequence of identifiers; it matches where its identifiers follow each
other in the document's sequence, whatever unknown text stands between. The first matching rule decides; all are listed.

Null and empty texts have no sentences and no licence. Texts are scanned whole however long. Rows that share an id are
scanned each by its own text; repeated rows get equal results. Other columns are dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Identifier of each known sentence, in its normal form.
SENTENCES = {
    "apache2-notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache2-title": ["apache license version 2 0 january 2004"],
    "apache2-compliance": ["you may not use this file except in compliance with the license"],
    "apache2-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-notice": ["released under the mit license", "licensed under the mit license", "distributed under the mit license"],
    "mit-title": ["the mit license", "mit license", "the mit license mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl-free": ["this program is free software"],
    "gpl-grant3": ["either version 3 of the license or at your option any later version"],
    "gpl-grant2": ["either version 2 of the license or at your option any later version"],
    "gpl-terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl-terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "gpl-terms3": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl-terms3": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "ccby4-notice": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "ccbync4-notice": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccbysa4-notice": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0-notice": ["cc0 1 0 universal", "this work is dedicated to the public domain"],
    "rights": ["all rights reserved"],
    "isc-title": ["isc license", "the isc license", "isc license isc"],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "unlicense-grant": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "boost-title": ["boost software license version 1 0 august 17th 2003"],
    "boost-notice": ["distributed under the boost software license version 1 0"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "gpl-title": ["gnu general public license"],
    "lgpl-title": ["gnu lesser general public license"],
    "agpl-title": ["gnu affero general public license"],
    "gpl2-date": ["version 2 june 1991"],
    "gpl3-date": ["version 3 29 june 2007"],
    "lgpl21-date": ["version 2 1 february 1999"],
    "agpl3-date": ["version 3 19 november 2007"],
    "library-free": ["this library is free software"],
    "gpl-grant21": ["either version 2 1 of the license or at your option any later version"],
    "gpl2-terms": ["you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", "you can redistribute it and or modify it under the terms of the gnu general public license version 2 only as published by the free software foundation"],
    "agpl-terms": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "agpl-terms3": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "epl2-notice": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "mit-short": ["licensed under mit", "licensed under the mit license see license file in the project root for full license information"],
    "ccby4-file": ["licensed under cc by 4 0 see file", "licensed under cc by 4 0 see license file"],
    "spdx": ["spdx license identifier"],
}

#: Identifiers that may follow "SPDX-License-Identifier:", each a sentence of its own there.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
SENTENCES |= {f"id-{x}": [" ".join(re.findall("[a-z0-9]+", x.lower()))] for x in SPDX}


@dataclass(frozen=True)
class Rule:
    licence: str
    sequence: tuple[str, ...]


#: In order: long sequences before the single notices that they may hold.
RULES = [
    Rule("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-as-is")),
    Rule("MIT", ("mit-grant", "mit-condition")),
    Rule("LGPL-3.0-or-later", ("gpl-free", "lgpl-terms", "gpl-grant3")),
    Rule("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl-grant3")),
    Rule("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl-grant2")),
    Rule("LGPL-3.0-or-later", ("gpl-free", "lgpl-terms3")),
    Rule("GPL-3.0-or-later", ("gpl-free", "gpl-terms3")),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-endorse")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source")),
    *(Rule(x, ("spdx", f"id-{x}")) for x in SPDX),
    Rule("AGPL-3.0-or-later", ("gpl-free", "agpl-terms", "gpl-grant3")),
    Rule("AGPL-3.0-or-later", ("gpl-free", "agpl-terms3")),
    Rule("LGPL-2.1-or-later", ("library-free", "lgpl-terms", "gpl-grant21")),
    Rule("GPL-2.0-only", ("gpl-free", "gpl2-terms")),
    Rule("AGPL-3.0-only", ("agpl-title", "agpl3-date")),
    Rule("LGPL-3.0-only", ("lgpl-title", "gpl3-date")),
    Rule("LGPL-2.1-only", ("lgpl-title", "lgpl21-date")),
    Rule("GPL-3.0-only", ("gpl-title", "gpl3-date")),
    Rule("GPL-2.0-only", ("gpl-title", "gpl2-date")),
    Rule("BSL-1.0", ("boost-title", "boost-grant")),
    Rule("Zlib", ("zlib-as-is", "zlib-grant")),
    Rule("Unlicense", ("unlicense-free", "unlicense-grant")),
    Rule("GPL-3.0-only", ("gpl3-notice",)),
    Rule("MPL-2.0", ("mpl2-notice",)),
    Rule("CC-BY-NC-4.0", ("ccbync4-notice",)),
    Rule("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    Rule("CC-BY-4.0", ("ccby4-notice",)),
    Rule("Apache-2.0", ("apache2-notice",)),
    Rule("Apache-2.0", ("apache2-title",)),
    Rule("MIT", ("mit-notice",)),
    Rule("MIT", ("mit-title",)),
    Rule("CC0-1.0", ("cc0-notice",)),
    Rule("ISC", ("isc-grant",)),
    Rule("ISC", ("isc-title",)),
    Rule("0BSD", ("0bsd-grant",)),
    Rule("BSL-1.0", ("boost-notice",)),
    Rule("BSL-1.0", ("boost-title",)),
    Rule("Unlicense", ("unlicense-free",)),
    Rule("EPL-2.0", ("epl2-notice",)),
    Rule("MIT", ("mit-short",)),
    Rule("CC-BY-4.0", ("ccby4-file",)),
    Rule("all-rights-reserved", ("rights",)),
]


def sentences(text: Column) -> Column:
    """The text in normal form: a line feed at each line's end and a blank line at each sentence's."""
    text = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    text = F.regexp_replace(text, r"(?<![a-z0-9])(v|ver)\.(?=[ \t\r]*[ \t\r\n][ \t]*[0-9])", "$1")
    text = F.regexp_replace(text, r"[.;:!?]+(?:[ \t\r]*\n|[ \t]+)", "\n\n")
    # Characters one by one: Java matches a class of several ranges some twenty times slower.
    text = F.regexp_replace(text, rf"[^{_LOWER}0123456789\n]+", " ")
    return F.trim(F.regexp_replace(text, r" *\n *", "\n"))


def _pattern(known: dict[str, list[str]]) -> str:
    """A known sentence on one line or wrapped over several, from a line's beginning to a line's end; long ones first."""
    forms = sorted((f for own in known.values() for f in own), key=len, reverse=True)
    return "(?md)^(?:" + "|".join(f.replace(" ", "[ \n]") for f in forms) + ")$"


def scan(docs: DataFrame, known: dict[str, list[str]] | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_known (known sentences), sequence (their identifiers), rules (numbers of those that match), licence."""
    known, rules = SENTENCES if known is None else known, RULES if rules is None else rules
    idents = F.create_map(*[F.lit(x) for k, forms in known.items() for s in forms for x in (s, k)])
    found = F.regexp_extract_all(sentences(F.col("text")), F.lit(_pattern(known)), F.lit(0))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found"))
    out = out.select("doc_id", F.transform("found", lambda s: F.element_at(idents, F.translate(s, "\n", " "))).alias("sequence"))
    text = F.concat(F.lit("|"), F.array_join("sequence", "|"), F.lit("|"))
    hits = [F.when(F.contains(text, F.lit("|" + "|".join(r.sequence) + "|")), F.lit(i)) for i, r in enumerate(rules)]
    out = out.withColumn("rules", F.array_compact(F.array(*hits)))
    names = F.array(*[F.lit(r.licence) for r in rules])
    return out.select("doc_id", F.size("sequence").cast("long").alias("n_known"), "sequence", "rules", F.when(F.size("rules") > 0, F.element_at(names, F.element_at("rules", 1) + 1)).alias("licence"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_known", F.array_join("sequence", ",").alias("sequence"), F.array_join(F.col("rules").cast("array<string>"), ",").alias("rules"), "licence")


def op1_sql() -> str:
    known = ", ".join(f"('{s}', '{k}')" for k, forms in SENTENCES.items() for s in forms)
    rules = ", ".join(f"({i}, '{r.licence}', '|{'|'.join(r.sequence)}|')" for i, r in enumerate(RULES))
    return rf"""
WITH known(sentence, ident) AS (VALUES {known}), rules(rule, licence, pattern) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
s AS (
  SELECT r, unnest(parts) AS sentence, unnest(range(len(parts))) AS pos FROM (
    SELECT r, string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.;:!?]+[ \t]+', chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS parts FROM d)
), q AS (
  SELECT r, count(*) AS n_known, string_agg(ident, ',' ORDER BY pos) AS sequence, '|' || string_agg(ident, '|' ORDER BY pos) || '|' AS p
  FROM s JOIN known ON trim(s.sentence) = known.sentence GROUP BY r
), m AS (SELECT r, string_agg(CAST(rule AS VARCHAR), ',' ORDER BY rule) AS rules, arg_min(licence, rule) AS licence FROM q JOIN rules ON contains(p, pattern) GROUP BY r)
SELECT doc_id, coalesce(n_known, 0) AS n_known, coalesce(sequence, '') AS sequence, coalesce(m.rules, '') AS rules, licence
FROM d LEFT JOIN q USING (r) LEFT JOIN m USING (r)
"""
