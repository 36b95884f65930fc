from litspark.llm import licenses as L

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in L.scan(df).collect()}


def test_wrapped_texts_and_rule_order(spark):
    apache = ("Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. "
              "You may obtain a copy of the License at:\nhttp://example.com")
    got = scan(spark, [MIT, "intro.\n" + MIT + "\noutro. Licensed under CC BY-NC 4.0.", apache, "Released under the MIT License.",
                       "Released under the MIT License, or not.", "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.",
                       "You may obtain a copy of the License at:", None, "", "no such words", "licence of another kind"])
    assert got[0]["licences"] == "MIT" and got[0]["sentence_ids"] == "MitGrant,MitNotice,AsIs" and got[0]["unmatched"] == ""
    assert got[1]["licences"] == "CC-BY-NC-4.0,MIT"
    assert got[2]["licences"] == "Apache-2.0" and got[2]["unmatched"] == ""
    assert got[3]["licences"] == "MIT" and 4 not in got
    assert got[5]["licences"] == "GPL-3.0-only"
    assert got[6]["licences"] == "" and got[6]["unmatched"] == "ApacheCopy"
    assert set(got) == {0, 1, 2, 3, 5, 6}


def test_repeats_and_messy_rows(spark, messy, nothing):
    got = scan(spark, ["All rights reserved. " * 3000 + "Released under the MIT License."])
    assert got[0]["n_sentences"] == 3001 and got[0]["licences"] == "MIT,all-rights-reserved"
    assert L.scan(messy).count() == 0 and L.scan(nothing).count() == 0


def test_tables_are_normalised():
    import re
    trigger = re.compile(L.TRIGGERS)
    for sentence in L.sentence_table():
        assert sentence == re.sub("[^a-z0-9]+", " ", sentence.lower()).strip() and trigger.search(sentence), sentence
    assert {i for _, ids in L.rules() for i in ids} <= set(L.sentence_table().values())


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

GPL = """This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{mark2} either version {version} of the License, or
(at your option) any later version."""

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0}Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{1}Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{2}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""

BSD_NAMES = """
{}Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

OFFICIAL = {
    "Apache-2.0": APACHE,
    "MIT": MIT,
    "GPL-3.0-or-later": GPL.format(mark=":", mark2=",", version=3),
    "GPL-2.0-or-later": GPL.format(mark=";", mark2=";", version=2),
    "BSD-2-Clause": BSD.format("1. ", "2. ", ""),
    "BSD-3-Clause": BSD.format("1. ", "2. ", BSD_NAMES.format("3. ")),
}


def commented(text, leader, first="", last=""):
    return first + "\n".join((leader + line).rstrip() for line in text.split("\n")) + last


def test_official_headers_plain_and_in_comments(spark):
    forms = [lambda t: t, lambda t: commented(t, "# "), lambda t: commented(t, "// "), lambda t: commented(t, " * ", "/*\n", "\n */"),
             lambda t: commented(t, "-- "), lambda t: commented(t, "    "), lambda t: t.replace("\n", "\r\n"), lambda t: t.replace("\n", " ")]
    cases = [(name, form(text)) for name, text in OFFICIAL.items() for form in forms]
    cases.append(("BSD-3-Clause", BSD.format("* ", "* ", BSD_NAMES.format("* "))))
    cases.append(("GPL-3.0-only", "# This work is licensed under\n# the GNU General Public License,\n# version 3.\nimport os"))
    got = scan(spark, [text for _, text in cases])
    assert {i: (got[i]["licences"], got[i]["unmatched"]) if i in got else None for i in range(len(cases))} == {
        i: (name, "") for i, (name, _) in enumerate(cases)}


def test_a_run_of_words_keeps_its_place_and_its_bounds(spark):
    got = scan(spark, ["All rights reserved.\n" + APACHE + "\nReleased under the MIT License.", "word " + GPL.format(mark=":", mark2=",", version=30)])
    assert got[0]["sentence_ids"] == "AllRights,ApacheRef,ApacheUse,ApacheCopy,MitRef" and 1 not in got


def owned(owner):
    return BSD.format("1. ", "2. ", BSD_NAMES.format("3. ").replace("the copyright holder", owner))


def test_owners_titles_identifiers_and_single_versions(spark):
    only = "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation."
    cases = [("BSD-3-Clause", owned("Google Inc.")), ("BSD-3-Clause", owned("the <organization>")), ("BSD-3-Clause", commented(owned("Ábc, Ltd."), "# ")),
             ("BSD-3-Clause", BSD.format("1. ", "2. ", "3. The name of the author may not be used to endorse or promote products\n   derived from this "
                                         "software without specific prior written permission.\n")),
             ("MIT", "// SPDX-License-Identifier: MIT\nint main() { return 0; }"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
             ("GPL-2.0-only", "/* SPDX-License-Identifier: GPL-2.0-only */"), ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
             ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n"
                            "                        http://www.apache.org/licenses/\n"),
             ("GPL-3.0-only", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n"),
             ("GPL-2.0-only", "\t\t    GNU GENERAL PUBLIC LICENSE\n\t\t       Version 2, June 1991\n"),
             ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007\n"),
             ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n"),
             ("GPL-2.0-only", "/*\n * This program is free software; " + only + "\n */")]
    got = scan(spark, [text for _, text in cases])
    assert {i: (got[i]["licences"], got[i]["unmatched"]) if i in got else None for i in range(len(cases))} == {
        i: (name, "") for i, (name, _) in enumerate(cases)}


def test_a_name_far_away_is_no_owner(spark):
    far = BSD_NAMES.format("").replace("the copyright holder", " ".join(f"w{i}" for i in range(30)))
    assert scan(spark, [BSD.format("", "", far)])[0]["licences"] == "BSD-2-Clause"
    assert 0 not in scan(spark, ["SPDX-License-Identifier: Unknown-1.0"])
