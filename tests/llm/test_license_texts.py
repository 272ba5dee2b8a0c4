"""The licence scan on genuine texts, wrapped and unwrapped."""

from __future__ import annotations

import re

from sparkloom.llm import license_scan
from sparkloom.llm.license_phrases import PHRASES, WORDS
from tests.conftest import rows

MIT = """MIT License

Copyright (c) 2020 A. Person

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
ISC = """Copyright (c) 2020 A. Person
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.
"""
BSD_3 = BSD_2.replace("\nTHIS SOFTWARE", """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE""")  # fmt: skip
APACHE = """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {} as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
CC = """This work is licensed under a Creative Commons
Attribution-ShareAlike 4.0 International License.
"""
TEXTS = [
    (MIT, "MIT"), (ISC, "ISC"), (BSD_2, "BSD-2-Clause"), (BSD_3, "BSD-3-Clause"), (APACHE, "Apache-2.0|Apache-2.0-header"), (MPL, "MPL-2.0"), (CC, "CC-BY-SA-4.0"),
    (GNU.format("General Public License", 3), "GPL-3.0"), (GNU.format("General Public License", 2), "GPL-2.0"), (GNU.format("Lesser General Public License", "2.1"), "LGPL-2.1"), (GNU.format("Lesser General Public License", 3), "LGPL-3.0"),
]


def forms(text: str) -> list[str]:
    """Wrapped; a line for each paragraph; one line; as a comment, and with other line ends."""
    paragraphs = [re.sub(r"\s+", " ", p).strip() for p in text.split("\n\n")]
    return [text, "\n\n".join(paragraphs), "\n".join(paragraphs), " ".join(paragraphs), "\n".join(f"# {x}".rstrip() for x in text.split("\n")), text.replace("\n", "\r\n")]


def test_genuine_texts(spark):
    data = [(100 * i + k, "Some code.\n\n" + f + "\n\nmore text", want) for i, (t, want) in enumerate(TEXTS) for k, f in enumerate(forms(t))]
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(spark.createDataFrame(data, "doc_id bigint, text string, want string")).collect()}
    assert got == {i: want for i, _, want in data}


def test_wrapped_notice_and_order(spark):
    data = [(1, "Licensed under the Apache License,\nVersion 2.0.\nReleased under the MIT License."), (2, "It isn't released under the MIT license here."), (3, "software, license\n\nand permission")]
    got = rows(license_scan.license_scan(spark.createDataFrame(data, "doc_id bigint, text string")), "doc_id", "n_sentences", "sentence_ids", "licenses")
    assert got == [(1, 3, "APACHE_2|MIT_NAME", "MIT|Apache-2.0"), (2, 1, "", ""), (3, 2, "", "")]


def test_words_cover_the_tables():
    assert all(any(w in s for w in WORDS) for s in [*license_scan.SENTENCES.values(), *(p for _, p in PHRASES)])
