"""Genuine licence notices, wrapped and unwrapped, bare and in comments."""

import textwrap

from quillspark.llm import license_scan

from .data import frame, texts

MIT = [
    "MIT License",
    "Copyright (c) 2020 A. Body",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
]
BSD = [
    "Copyright (c) 2020, A. Body. All rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.',
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
]
FREE = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
NOTICES = {
    "MIT": MIT,
    "BSD-3-Clause": BSD,
    "Apache-2.0": APACHE,
    "GPL-3.0-or-later": GPL,
    "BSD-2-Clause": [*BSD[:4], BSD[5]],
    "BSD-4-Clause": [*BSD[:4], "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University of Somewhere and its contributors.", BSD[4].replace("3.", "4.").replace("the copyright holder", "the University"), BSD[5]],
    "GPL-2.0-or-later": [FREE.format("program", ";", "", ";", "2"), GPL[1]],
    "LGPL-2.1-or-later": [FREE.format("library", ";", "Lesser ", ";", "2.1"), GPL[1].replace("program", "library").replace("GNU", "GNU Lesser")],
    "LGPL-3.0-or-later": [FREE.format("program", ":", "Lesser ", ",", "3")],
    "AGPL-3.0-or-later": [FREE.format("program", ":", "Affero ", ",", "3"), GPL[1].replace("GNU", "GNU Affero")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Copyright (c) 1999, A. Body", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.'],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "EPL-2.0": ["Copyright (c) 2018 A. Body and others", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "SPDX-License-Identifier: EPL-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
}


def written(paragraphs, width, leader, end, gap):
    lines = []
    for p in paragraphs:
        lines += [*(textwrap.wrap(p, width) if width else [p]), *[""] * gap]
    return "code();" + end + end.join(leader + x for x in ["", *lines, ""]) + end + "more code();"


def test_genuine_notices(spark):
    forms = [(w, leader, end, 1) for w in (None, 40, 60, 72, 78, 100) for leader, end in (("", "\n"), (" * ", "\n"), ("# ", "\r\n"), ("// ", "\n"), ("REM ", "\r\n"))]
    given, want = [], []
    for names, paragraphs in NOTICES.items():
        # a notice's list may stand without blank lines
        for form in forms + ([(72, " * ", "\n", 0), (None, "", "\n", 0)] if paragraphs is BSD else []):
            given.append(written(paragraphs, *form))
            want.append(names)
        given.append(" ".join(paragraphs) if names.startswith(("BSD-", "GPL", "LGPL")) else "\n\n".join(paragraphs))
        want.append(names)
    given += [*texts(), "x();\n// SPDX-License-Identifier: MIT\n#include <a>", "Permission is hereby granted, free of charge, to nobody at all.", None]
    want += [*[""] * len(texts()), "MIT", "", ""]
    got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, given)).collect()}
    assert [(i, got[i]["licences"]) for i in range(len(given))] == list(enumerate(want))


def test_lines_that_are_known_stay_known(spark):
    given = [f"before\n{s}\nafter" for s in license_scan.SENTENCES]
    got = {r["doc_id"]: r["sequence"] for r in license_scan.scan(frame(spark, given)).collect()}
    assert got == {i: f" {i + 1} " for i in range(len(given))}


def test_large_tables_are_joined(spark, monkeypatch):
    """The same results where sentences and rules are tables, too many for the plan."""
    given = [*(written(p, 60, " * ", "\n", 1) for p in NOTICES.values()), *texts(), None, "", *(f"before\n{s}\nafter" for s in license_scan.SENTENCES), written(MIT, 60, " * ", "\n", 1)]
    ids = [*range(len(given) - 2), 3, None]
    results = lambda df: sorted(map(str, df.select("doc_id", "n_sentences", "n_known", "sequence", "licences").collect()))
    want = results(license_scan.scan(frame(spark, given, ids)))
    monkeypatch.setattr(license_scan, "MOST_IN_PLAN", 0)
    assert results(license_scan.scan(frame(spark, given, ids))) == want and len(want) == len(given)
    assert license_scan.scan(frame(spark, given, ids).limit(0)).count() == 0


def test_first_rule_wins_and_names_have_places(spark):
    holder = "the copyright holder"
    given = ["\n".join(BSD).replace(holder, name) for name in ("Google Inc.", "the Regents of the University of Nowhere", "A. Body, nor B. Body,", "X")] + ["\n".join(BSD).replace(holder, "x" * 500), "\n".join(BSD).replace(f"of {holder}", "of")]
    given += ["\n\n".join(["\n".join(BSD), "\n".join(MIT), "\n".join(NOTICES["BSD-2-Clause"])])]
    got = {r["doc_id"]: r["licences"] for r in license_scan.scan(frame(spark, given)).collect()}
    assert [got[i] for i in range(len(given))] == ["BSD-3-Clause"] * 4 + ["BSD-2-Clause"] * 2 + ["BSD-2-Clause,BSD-3-Clause,MIT"]
    # of rules of one size the first listed wins, from left to right
    rules, sentences = [("later", [2, 3]), ("pair", [1, 2]), ("again", [1, 2]), ("one", [3])], ["one is here", "two is here", "three is here"]
    text = "One is here. Two is here. Three is here. Two is here. Three is here."
    for most in (1000, 0):
        license_scan.MOST_IN_PLAN, kept = most, license_scan.MOST_IN_PLAN
        try:
            assert license_scan.scan(frame(spark, [text, "Three is here. " * 2]), sentences, rules).orderBy("doc_id").select("licences").collect() == [("later,one,pair",), ("one",)]
        finally:
            license_scan.MOST_IN_PLAN = kept
