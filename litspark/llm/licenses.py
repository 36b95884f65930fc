"""Licence scan by sentence rules.

A text is cut into sentences (wrapped lines are joined first), each sentence is
normalised to lower-case words, and a table of known licence sentences gives it
an identifier. The identifiers, in the order of the text and without the other
sentences, are matched against an ordered list of rules: each rule names a
sequence of identifiers and the licence it means; longer and more specific
rules come first, and what a rule has matched is not matched again.

The long sentences of the official licence texts and headers are also found as
runs of words wherever they stand: over line ends, comment leaders, bullets and
quotes, next to ';' or ':', and inside a longer sentence. Each is replaced by a
mark on a line of its own before the text is cut. Wrapped lines of one comment
are joined without their leaders.

``oracle_sql`` states the cut by sentences alone, with the tables of fixed
values; the two agree on texts that hold none of the official texts.

Everything is Spark SQL expressions on one row at a time: texts without any of
the trigger words are not cut at all, and nothing is shuffled.

Defined cases: null and empty texts and texts without a known sentence give no
row; repeated sentences are matched each time, licences are reported once;
identifiers that no rule uses are reported as ``unmatched``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: sentences of public licence texts, normalised ----
SENTENCES = {
    # references by name
    "licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheRef",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this software is released under the mit license": "MitRef",
    "distributed under the terms of the bsd license": "BsdRef",
    "licensed under the bsd 3 clause license": "Bsd3Ref",
    "licensed under the bsd 2 clause license": "Bsd2Ref",
    "licensed under the isc license": "IscRef",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu lesser general public license version 3": "Lgpl3Ref",
    "licensed under the gnu affero general public license version 3": "Agpl3Ref",
    "licensed under the mozilla public license version 2 0": "Mpl2Ref",
    "licensed under the eclipse public license version 2 0": "Epl2Ref",
    "all rights reserved": "AllRights",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this work is in the public domain": "PublicDomain",
    # MIT and ISC
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software": "MitNotice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    # BSD
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    # Apache
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    # GPL
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 2 of the license or at your option any later "
    "version": "Gpl2Plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version": "Gpl3Plus",
    # disclaimers
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "AsIs",
}
CC_KINDS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: In order; (licence, identifiers).
RULES = [
    ("MIT", ("MitGrant", "MitNotice", "AsIs")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("Apache-2.0", ("ApacheRef", "ApacheUse", "ApacheCopy")),
    ("Apache-2.0", ("ApacheRef", "ApacheUse")),
    ("ISC", ("IscGrant",)),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MitRef",)),
    ("BSD-3-Clause", ("Bsd3Ref",)),
    ("BSD-2-Clause", ("Bsd2Ref",)),
    ("BSD", ("BsdRef",)),
    ("ISC", ("IscRef",)),
    ("GPL-2.0-or-later", ("Gpl2Plus",)),
    ("GPL-3.0-or-later", ("Gpl3Plus",)),
    ("GPL-2.0-only", ("Gpl2Ref",)),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("LGPL-3.0-only", ("Lgpl3Ref",)),
    ("AGPL-3.0-only", ("Agpl3Ref",)),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("EPL-2.0", ("Epl2Ref",)),
    ("Unlicense", ("Unlicense",)),
    ("public-domain", ("PublicDomain",)),
    ("all-rights-reserved", ("AllRights",)),
]
# ---- end of fixed values ----

#: Further sentences of official texts, found as runs of words only; normalised.
OFFICIAL = {
    "licensed under the apache license version 2 0 the license": "ApacheRef",
    "licensed to the apache software foundation asf under one or more contributor license agreements": "ApacheAsf",
    "the asf licenses this file to you under the apache license version 2 0 the license": "ApacheRef",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission": "BsdNames",
    "the name of * may not be used to endorse or promote products derived from this software without specific prior "
    "written permission": "BsdNames",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
    "public license as published by the free software foundation either version 2 1 of the license or at your option "
    "any later version": "Lgpl21Plus",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Ref",
} | {
    f"{name} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public "
    f"license as published by the free software foundation either version {version} of the license or at your option "
    "any later version": found
    for name in ("this program", "this library")
    for kind, version, found in (("", "2", "Gpl2Plus"), ("", "3", "Gpl3Plus"), ("lesser ", "3", "Lgpl3Plus"), ("affero ", "3", "Agpl3Plus"))
}
#: Titles of whole licence texts, and headers that name one version only.
OFFICIAL |= {
    "apache license version 2 0 january 2004": "Apache2Title",
    "gnu general public license version 2 june 1991": "Gpl2Title",
    "gnu general public license version 3 29 june 2007": "Gpl3Title",
    "gnu lesser general public license version 2 1 february 1999": "Lgpl21Title",
    "gnu lesser general public license version 3 29 june 2007": "Lgpl3Title",
    "gnu affero general public license version 3 19 november 2007": "Agpl3Title",
    "mozilla public license version 2 0 1 definitions": "Mpl2Title",
    "eclipse public license v 2 0 the accompanying program is provided": "Epl2Title",
} | {
    f"{lead} as published by the free software foundation": f"Gpl{v}Only" for v in (2, 3)
    for lead in (f"the gnu general public license version {v} only", f"the gnu general public license version {v}",
                 f"version {v} of the gnu general public license", f"the gnu general public license version {v} of the license only")
}
#: Before ``RULES``.
OFFICIAL_RULES = [
    ("Apache-2.0", ("Apache2Title",)),
    ("GPL-2.0-only", ("Gpl2Title",)),
    ("GPL-3.0-only", ("Gpl3Title",)),
    ("LGPL-2.1-only", ("Lgpl21Title",)),
    ("LGPL-3.0-only", ("Lgpl3Title",)),
    ("AGPL-3.0-only", ("Agpl3Title",)),
    ("MPL-2.0", ("Mpl2Title",)),
    ("EPL-2.0", ("Epl2Title",)),
    ("GPL-2.0-only", ("Gpl2Only",)),
    ("GPL-3.0-only", ("Gpl3Only",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "AllRights", "BsdNames")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")),
    ("Apache-2.0", ("ApacheAsf", "ApacheRef", "ApacheUse", "ApacheCopy")),
    ("Apache-2.0", ("ApacheAsf", "ApacheRef", "ApacheUse")),
    ("LGPL-2.1-or-later", ("Lgpl21Plus",)),
    ("LGPL-3.0-or-later", ("Lgpl3Plus",)),
    ("AGPL-3.0-or-later", ("Agpl3Plus",)),
]
#: Sentences of the table from this many words on are found as runs of words too.
RUN_WORDS = 10
#: A ``*`` in a run stands for one to this many words.
ANY_WORDS = 15
SPDX = r"(?i)\bSPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"
#: What may stand between two words of a run.
BETWEEN = r"[^\p{L}\p{N}]{1,80}"
#: A comment's leader at the start of a line, and a line of a comment that goes on in the next.
LEADER = r"(?m)^[ \t]*(?:/\*+|//+!?|#+|\*+(?!/)|--+|;+|%+|<!--)[ \t]*"
COMMENT_WRAPPED = r"(?m)(^\x01|(?!\A)\G)([^\n]*[a-z,;])[ \t]*\n\x01(?=[a-z(])"
COMMENT_CAPITALS = r"(?m)(^\x01|(?!\A)\G)([^\n]*[A-Z,])[ \t]*\n\x01(?=[A-Z][A-Z])"

#: One of these words is in every known sentence, in any case.
TRIGGERS = "licen[cs]e|permi|copyright|redistribut|warrant|public domain|rights reserved|free software"
#: A line that goes on: a lower-case word, or a capital word after a capital one.
WRAPPED = r"([a-z,;])[ \t]*\n[ \t]*([a-z(])"
WRAPPED_CAPITALS = r"([A-Z,])[ \t]*\n[ \t]*([A-Z][A-Z])"
SENTENCE_END = r"\n|[.!?:]+(?:[ \t\n]+|$)"


def sentence_table() -> dict[str, str]:
    """Normalised sentence → identifier, Creative Commons references built by rule."""
    out = dict(SENTENCES)
    for kind in CC_KINDS:
        for version in CC_VERSIONS:
            words = f"{kind} {version}".lower().replace("-", " ").replace(".", " ")
            for lead in ("licensed under cc", "licensed under creative commons", "this work is licensed under cc"):
                out[f"{lead} {words}"] = f"CC-{kind}-{version}"
    return out


def rules() -> list[tuple[str, tuple[str, ...]]]:
    return RULES + [(f"CC-{k}-{v}", (f"CC-{k}-{v}",)) for k in CC_KINDS for v in CC_VERSIONS]


def runs() -> dict[str, str]:
    """Normalised sentence → identifier of those found as runs of words, longest first."""
    both = {s: i for s, i in SENTENCES.items() if len(s.split()) >= RUN_WORDS} | OFFICIAL
    both |= {"you may obtain a copy of the license at": "ApacheCopy"}
    return dict(sorted(both.items(), key=lambda x: -len(x[0])))


ANY = rf"[\p{{L}}\p{{N}}]+(?:{BETWEEN}[\p{{L}}\p{{N}}]+){{0,{ANY_WORDS - 1}}}?"


def spdx_sentence(licence: str) -> str:
    return "run of words spdx " + re.sub("[^a-z0-9]+", " ", licence.lower()).strip()


def marked_text(text: Column) -> Column:
    """The text with every known run of words and SPDX identifier as a line of its own, and wrapped comments joined."""
    out = F.regexp_replace(text, SPDX, ".\nrun of words spdx $1\n")
    for sentence, found in runs().items():
        words = [ANY if w == "*" else w for w in sentence.split()]
        pattern = r"(?i)(?<![\p{L}\p{N}])" + BETWEEN.join(words) + r"(?![\p{L}\p{N}])"
        out = F.regexp_replace(out, pattern, f".\nrun of words {found.lower()}.\n")
    out = F.regexp_replace(out, LEADER, "\x01")
    for pattern in (COMMENT_WRAPPED, COMMENT_CAPITALS):
        out = F.regexp_replace(out, pattern, "$1$2 ")
    return F.replace(out, F.lit("\x01"), F.lit(""))


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, in order."""
    joined = F.regexp_replace(F.regexp_replace(text, WRAPPED, "$1 $2"), WRAPPED_CAPITALS, "$1 $2")
    return F.transform(F.split(joined, SENTENCE_END, -1),
                       lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences, unmatched) of every document with a known sentence."""
    named = dict.fromkeys(licence for licence, _ in OFFICIAL_RULES + rules() if licence[0].isupper())
    table = sentence_table() | {f"run of words {i.lower()}": i for i in runs().values()} | {spdx_sentence(x): f"Spdx{x}" for x in named}
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    text = F.col(text_col).cast("string")
    found = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
             .where(F.lower("text").rlike(TRIGGERS))
             .select("doc_id", F.filter(F.transform(sentences(marked_text(F.col("text"))), lambda s: F.try_element_at(known, s)),
                                        lambda x: x.isNotNull()).alias("ids"))
             .where(F.size("ids") > 0))
    rest = F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))
    for licence, ids in OFFICIAL_RULES + rules() + [(x, (f"Spdx{x}",)) for x in named]:
        rest = F.replace(rest, F.lit("<" + "><".join(ids) + ">"), F.lit(f"[{licence}]"))
    marked = found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
                          rest.alias("rest"))

    def names(pattern: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("rest", F.lit(pattern), F.lit(1)))), ",")

    return marked.select("doc_id", "n_sentences", "sentence_ids", names(r"\[([^\]]*)\]").alias("licences"),
                         names("<([^>]*)>").alias("unmatched"))


def oracle_sql() -> str:
    """The registered query in DuckDB SQL."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in sentence_table().items())
    rest = "'<' || string_agg(id, '><' ORDER BY place) || '>'"
    for licence, ids in rules():
        rest = f"replace({rest}, '<{'><'.join(ids)}>', '[{licence}]')"
    end = SENTENCE_END.replace("\\n", "\n").replace("\\t", "\t")
    joins = "text"
    for pattern in (WRAPPED, WRAPPED_CAPITALS):
        joins = f"regexp_replace({joins}, '{pattern}', '\\1 \\2', 'g')"
    names = lambda pattern: (f"coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(rest, '{pattern}', 1))), ','), '')")
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
cut AS (SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS raw
        FROM (SELECT doc_id, string_split_regex({joins}, '{end}') AS parts FROM documents
              WHERE regexp_matches(lower(text), '{TRIGGERS}'))),
hit AS (SELECT doc_id, place, id FROM cut JOIN known ON trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) = sentence),
done AS (SELECT doc_id, count(*) AS n_sentences, string_agg(id, ',' ORDER BY place) AS sentence_ids, {rest} AS rest
         FROM hit GROUP BY doc_id)
SELECT doc_id, n_sentences, sentence_ids, {names(r'\[([^\]]*)\]')} AS licences, {names('<([^>]*)>')} AS unmatched FROM done
"""
