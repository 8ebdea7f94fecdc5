"""Licence recognition by sentences, with DataFrame functions only.

Wrapped lines are joined and a text is cut into sentences, at sentence ends, blank lines, list and comment markers and
around lines that say all of a known sentence; sentences with a cue word are normalised (ASCII lower case, runs of other characters
than letters and digits become one space) and mapped to the identifier of a known licence sentence. The identifiers
of a text, in order, are matched against ordered rules: the longest statements first, each match replaced by
its licence, so that a sentence counts for one licence. Everything happens inside a row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words one of which every known sentence has.
CUES = ("licen[cs]e", "licensing", "copyright", "permission", "rights reserved", "public domain", "redistribut", "warrant", "spdx")
SPLIT = r"[.!?;]+(?:\s+|$)|\n+"

# Normalised sentences of public licences and notices, by identifier.
SENTENCES: dict[str, str] = {
    "released under the mit license": "mit-line",
    "licensed under the mit license": "mit-line",
    "this project is licensed under the mit license": "mit-line",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "licensed under the apache license version 2 0": "apache2-line",
    "licensed under the apache license version 2 0 the license": "apache2-line",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-line",
    "licensed under the gnu general public license version 3": "gpl3-line",
    "licensed under the gnu general public license version 2": "gpl2-line",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-line",
    "licensed under cc by 4 0": "ccby4-line",
    "licensed under cc by sa 4 0": "ccbysa4-line",
    "licensed under cc by nc 4 0": "ccbync4-line",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-line",
    "this is free and unencumbered software released into the public domain": "unlicense-line",
    "all rights reserved": "reserved",
}

# Sentences with open places, tried in this order when no known sentence is equal.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("spdx license identifier [a-z0-9]+( [a-z0-9]+)*", "spdx"),
    ("copyright( c)?( [0-9]{4})+( [a-z0-9]+)*", "copyright"),
)

# Ordered rules, identifiers in sequence to licence; earlier rules take their sentences first.
RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("mit-title", "copyright", "mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("mit-grant", "mit-notice", "mit-as-is"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("apache2-line", "apache-compliance", "apache-copy", "apache-see"), "Apache-2.0"),
    (("apache2-line", "apache-compliance"), "Apache-2.0"),
    (("gpl3-later", "gpl-warranty", "gpl-see"), "GPL-3.0-or-later"),
    (("gpl2-later", "gpl-warranty", "gpl-see"), "GPL-2.0-or-later"),
    (("gpl3-later",), "GPL-3.0-or-later"),
    (("gpl2-later",), "GPL-2.0-or-later"),
    (("copyright", "reserved"), "Proprietary"),
    (("isc-grant",), "ISC"),
    (("mit-line",), "MIT"),
    (("mit-title",), "MIT"),
    (("apache2-line",), "Apache-2.0"),
    (("gpl3-line",), "GPL-3.0-only"),
    (("gpl2-line",), "GPL-2.0-only"),
    (("mpl2-line",), "MPL-2.0"),
    (("ccby4-line",), "CC-BY-4.0"),
    (("ccbysa4-line",), "CC-BY-SA-4.0"),
    (("ccbync4-line",), "CC-BY-NC-4.0"),
    (("unlicense-line",), "Unlicense"),
    (("reserved",), "Proprietary"),
)
# Further sentences in the forms licence texts have, and line notices with an open subject. The scan
# knows them besides the tables above; the SQL twin has the tables above only.
MORE_SENTENCES: dict[str, str] = {
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-grant",
    "isc license": "isc-title",
    "the isc license": "isc-title",
    "the isc license isc": "isc-title",
} | {
    f"this {thing} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation either version {v} of the license or at your option any later version": f"{name}{v.replace(' ', '-').removesuffix('-0')}-later"
    for thing in ("program", "library", "software") for kind, name, versions in (("", "gpl", ("2", "3")), ("lesser ", "lgpl", ("2 1", "3")), ("affero ", "agpl", ("3",))) for v in versions
} | {
    f"this {thing} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty"
    for thing in ("library", "software")
} | {f"see the gnu {kind} general public license for more details": f"{name}-see" for kind, name in (("lesser", "lgpl"), ("affero", "agpl"))}
_OPEN = "(.*[a-z0-9]{2} )?(licensed|released|distributed|available|published) under (the )?(terms of )?(the )?"
_V = "( license)?( as published by the free software foundation)?,?( version| v)? ?"
MORE_PATTERNS: tuple[tuple[str, str], ...] = tuple((_OPEN + body, name) for body, name in (
    ("mit( open source)? license( mit)?", "mit-line"), ("isc license", "isc-line"),
    ("apache( software)? license( version| v)? ?2( 0)?( the license)?", "apache2-line"),
    ("(new |revised |modified )?bsd 3 clause( new or revised)?( license)?", "bsd3-line"), ("(simplified )?bsd 2 clause( simplified)?( license)?", "bsd2-line"),
    *((f"(gnu )?{full}{_V}{v}( only)?", f"{name}{v.split()[0] if v != '2 1' else '2-1'}-line")
      for full, name, versions in (("(affero general public license|agpl)", "agpl", ("3",)), ("(lesser general public license|lgpl)", "lgpl", ("2 1", "3")), ("(general public license|gpl)", "gpl", ("2", "3"))) for v in versions),
    ("mozilla public license( version| v)? ?2 0", "mpl2-line"),
    ("(a )?(cc by 4 0|creative commons attribution 4 0)( international)?( license)?", "ccby4-line"),
    ("(a )?(cc by sa 4 0|creative commons attribution sharealike 4 0)( international)?( license)?", "ccbysa4-line"),
    ("(a )?(cc by nc 4 0|creative commons attribution noncommercial 4 0)( international)?( license)?", "ccbync4-line"),
    ("(eclipse public license|epl)( version| v)? ?2 0", "epl2-line"), ("boost software license( version| v)? ?1 0", "bsl1-line"),
)) + (("this source code form is subject to the terms of the mozilla public license( version| v) 2 0", "mpl2-line"),)
# SPDX identifiers as written; their sentences keep the value.
SPDX = tuple("""MIT ISC Apache-2.0 BSD-2-Clause BSD-3-Clause 0BSD GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later GPL-2.0 GPL-3.0 GPL-2.0+ GPL-3.0+
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LGPL-2.1 LGPL-3.0 LGPL-2.1+ LGPL-3.0+ AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 AGPL-3.0+ MPL-2.0 EPL-2.0
BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0""".split())
_OLD = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
MORE_RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("lgpl2-1-later", "gpl-warranty", "lgpl-see"), "LGPL-2.1-or-later"), (("lgpl3-later", "gpl-warranty", "lgpl-see"), "LGPL-3.0-or-later"),
    (("agpl3-later", "gpl-warranty", "agpl-see"), "AGPL-3.0-or-later"),
    (("isc-title", "copyright", "isc-grant"), "ISC"), (("isc-title", "isc-grant"), "ISC"),
    (("lgpl2-1-later",), "LGPL-2.1-or-later"), (("lgpl3-later",), "LGPL-3.0-or-later"), (("agpl3-later",), "AGPL-3.0-or-later"),
    (("isc-title",), "ISC"), (("isc-line",), "ISC"), (("bsd3-line",), "BSD-3-Clause"), (("bsd2-line",), "BSD-2-Clause"),
    (("epl2-line",), "EPL-2.0"), (("bsl1-line",), "BSL-1.0"),
    (("lgpl2-1-line",), "LGPL-2.1-only"), (("lgpl3-line",), "LGPL-3.0-only"), (("agpl3-line",), "AGPL-3.0-only"),
)
# Line starts that begin a sentence of their own: list marks, of which "(c)" is none.
_MARK = r"(?:[-*•]|\((?:[0-9]{1,2}|[abd-z])\)|(?:[0-9]{1,2}|[a-z])[.)])[ \t]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _cue() -> str:
    return "(?i)" + "|".join(CUES)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def spdx_id(value: str) -> str:
    return "spdx-" + value.lower().replace("+", "-or-later").replace(".", "-")


def identifier(sentence: Column) -> Column:
    """Identifier of a normalised sentence, null if it is not known."""
    known = F.create_map(*[F.lit(x) for pair in (SENTENCES | MORE_SENTENCES).items() for x in pair])
    out = F.element_at(known, sentence)
    spdx = "^spdx license identifier "
    value = F.concat(F.lit("spdx-"), F.regexp_replace(F.regexp_replace(sentence, spdx, ""), " ", "-"))
    out = F.coalesce(out, F.when(sentence.rlike(spdx), value))
    for pattern, name in (*MORE_PATTERNS, *(p for p in PATTERNS if p[1] != "spdx")):
        out = F.coalesce(out, F.when(sentence.rlike(f"^{pattern}$"), name))
    return out


def sentences_of(text: Column) -> Column:
    """Sentences of a text whose lines may be wrapped or commented: comment marks go, and a line is joined to the one
    before unless that ends a sentence, one of them is blank, the line has a list mark, or one of them is known by itself."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)^[ \t]*(?://+|/\*+|\*+/|#+|;+|--+|\*(?=[ \t]|$)|(?i:rem)(?=[ \t]))?[ \t]*|[ \t]*\*+/[ \t]*$", "")
    t = F.regexp_replace(t, r"(?m)^SPDX-License-Identifier:(.*)$", "\n\nSPDX-License-Identifier:$1\n\n")
    t = F.regexp_replace(t, r"(?m)(SPDX-License-Identifier:[^\n]*?)\+", "$1-or-later")
    lines = F.split(t, r"\n")
    alone = F.transform(lines, lambda x: F.when(x.rlike(_cue()) & identifier(normalised(x)).isNotNull(), F.concat(F.lit("\n\n"), x, F.lit("\n\n"))).otherwise(x))
    t = F.regexp_replace(F.array_join(alone, "\n"), r"\n(?=" + _MARK + ")", "\n\n")
    t = F.regexp_replace(t, r"(?m)^" + _MARK, "")
    t = F.regexp_replace(t, r"(?<!\n)\n(?!\n)", " ")
    return F.split(t, r"[.!?;]+(?:\s+|$)|\n+")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, sentence_ids, licences, n_unmatched) per row: identifiers of known sentences in order, licences in order of
    their first statement, and known sentences that no rule took.

    Null and empty texts have empty lists. Rows with null or repeated keys are kept as they are; other columns are not read.
    Whole texts are scanned; a text without any cue word is only searched for cues.
    """
    t = F.col(f"`{text}`").cast("string")
    sentences = F.filter(sentences_of(t), lambda s: s.rlike(_cue()))
    ids = F.filter(F.transform(F.transform(sentences, normalised), identifier), lambda x: x.isNotNull())
    ids = F.when(t.rlike(_cue()), ids).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(f"`{key}`").alias(key), ids.alias("sentence_ids"))
    # Each identifier stands between its own commas, so that neighbours do not share one.
    left = F.concat(F.lit(","), F.array_join("sentence_ids", ",,"), F.lit(","))
    spdx = tuple(((spdx_id(x),), _OLD.get(x, _OLD.get(x[:-1], x).replace("-only", "-or-later") if x.endswith("+") else x)) for x in SPDX)
    for names, licence in (*(r for r in MORE_RULES if len(r[0]) > 1), *RULES, *(r for r in MORE_RULES if len(r[0]) == 1), *dict(spdx).items()):
        left = F.replace(left, F.lit(",".join(f",{n}" for n in names) + ","), F.lit(f",={licence},"))
    rows = rows.withColumn("left", F.when(F.size("sentence_ids") > 0, F.filter(F.split(left, ",+"), lambda x: x != ""))
                           .otherwise(F.array().cast("array<string>")))
    licences = F.array_distinct(F.transform(F.filter("left", lambda x: x.startswith("=")), lambda x: F.substr(x, F.lit(2))))
    return rows.select(key, "sentence_ids", licences.alias("licences"), F.size(F.filter("left", lambda x: ~x.startswith("="))).cast("long").alias("n_unmatched"))


def twin() -> str:
    """The scan of ``documents`` as one SQL query, from the same tables of sentences and rules."""
    cue = "|".join(CUES)
    known = "map {" + ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items()) + "}"
    name = f"{known}[s]"
    for pattern, value in PATTERNS:
        name = f"coalesce({name}, case when regexp_full_match(s, '{pattern}') then '{value}' end)"
    left = "',' || array_to_string(sentence_ids, ',,') || ','"
    for names, licence in RULES:
        left = f"replace({left}, '{','.join(f',{n}' for n in names)},', ',={licence},')"
    return rf"""
with s as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[.!?;]+(?:\s+|$)|\n+'), lambda x: regexp_matches(x, '(?i){cue}')) as s from documents),
n as (select doc_id, list_transform(s, lambda x: trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))) as s from s),
i as (select doc_id, list_filter(list_transform(s, lambda s: {name}), lambda x: x is not null) as sentence_ids from n),
l as (select *, case when len(sentence_ids) > 0 then list_filter(string_split_regex({left}, ',+'), lambda x: x <> '') else [] end as l from i),
e as (select *, list_transform(list_filter(l, lambda x: x[1] = '='), lambda x: x[2:]) as found from l)
select doc_id, sentence_ids, list_filter(found, lambda x, i: list_position(found, x) = i) as licences,
  cast(len(list_filter(l, lambda x: x[1] <> '=')) as bigint) as n_unmatched from e"""
