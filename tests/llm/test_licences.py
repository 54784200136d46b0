"""Licence texts as they stand in files: wrapped, behind comment marks, inside other text."""

import textwrap

import pytest

from segspark.llm import licences

MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.\n\nYou may obtain '
    "a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law, no warranty.")
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n{}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
         "software without specific prior written permission.\n\n")
GNU = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free "
    "Software Foundation{3} either version {4} of the License, or (at your option) any later version.\n\nThis {0} is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")
MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
       "can obtain one at http://mozilla.org/MPL/2.0/.")
ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
       'copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
       "REGARD TO THIS SOFTWARE.")
TEXTS = {
    "MIT": MIT, "Apache-2.0": APACHE, "BSD-2-Clause": BSD.format(""), "BSD-3-Clause": BSD.format(THIRD), "MPL-2.0": MPL, "ISC": ISC,
    "GPL-3.0-or-later": GNU.format("program", ":", "", ",", "3"), "GPL-2.0-or-later": GNU.format("program", ";", "", ";", "2"),
    "LGPL-2.1-or-later": GNU.format("library", ";", "Lesser ", ";", "2.1"), "LGPL-3.0-or-later": GNU.format("library", ":", "Lesser ", ",", "3"),
    "AGPL-3.0-or-later": GNU.format("program", ":", "Affero ", ",", "3")}


def wrap(text, width, mark=""):
    return "\n".join(mark + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_licence_texts(spark, name):
    text = TEXTS[name]
    shapes = [text, wrap(text, 76), wrap(text, 70, "# "), wrap(text, 60, " * "), wrap(text, 72, "// ").replace("\n", "\r\n"),
              "/*\n" + wrap(text, 66, " * ") + "\n */\nint main() { return 0; }", "Some words before it: " + text + " And some after it.", text.upper()]
    rows = licences.scan_licences(spark.createDataFrame(list(enumerate(shapes)), "doc_id long, text string")).collect()
    assert [(r["licences"], r["n_unmatched"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(name, 0)] * len(shapes)


def test_notices_inside_text(spark):
    texts = ["see: Released under the MIT License.", "not thereleased under the MIT License", "Released under\nthe MIT License and All rights reserved",
             "# SPDX-License-Identifier: GPL-3.0-or-later\n", "x" * 5 + " word" * 500 + " Released under CC0 1.0 " + "word " * 500, None, "", "licence é",
             TEXTS["MIT"] + " word" * 300 + " " + TEXTS["BSD-2-Clause"], "Permission is granted."]
    docs = spark.createDataFrame([(i, t, "own", 7) for i, t in enumerate(texts)], "doc_id long, text string, licences string, n_unmatched int")
    got = licences.scan_licences(docs)
    assert sorted(got.columns) == ["doc_id", "licences", "n_sentences", "n_unmatched", "sentence_ids", "text"]
    assert [r["licences"] for r in sorted(got.collect(), key=lambda r: r["doc_id"])] == [
        "MIT", "", "MIT,all-rights-reserved", "GPL-3.0-or-later", "CC0-1.0", "", "", "", "BSD-2-Clause,MIT", ""]


def test_sentences_far_apart(spark):
    """Two sentences of a rule with other words between them, up to the gap, belong together; beyond it they do not."""
    head, tail = MIT.split("\n\n")[:2]
    docs = spark.createDataFrame([(n, head + " " + "x" * n + " " + tail) for n in (1, licences.GAP, licences.GAP + 1)], "doc_id long, text string")
    assert [r["licences"] for r in licences.scan_licences(docs).orderBy("doc_id").collect()] == ["MIT", "MIT", "MIT-incomplete"]
