"""Licence notices as they stand in files: wrapped, commented and whole."""

import pytest

from momentlens.llm import license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file, stop."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
TEXTS = {"ISC": ISC, "Zlib": ZLIB, "Unlicense": UNLICENSE, "LGPL-2.1": LGPL, "MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + BSD3, "GPL-3.0": GPL, "Apache-2.0": APACHE, "MPL-2.0": MPL}
FORMS = {"plain": "{}", "star": " * {}", "hash": "# {}", "slashes": "// {}", "crlf": "{}\r"}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{n}/{form}", "some code before\n\n" + "\n".join(f.format(x) for x in t.split("\n")) + "\n\nafter") for n, t in TEXTS.items() for form, f in FORMS.items()]
    rows += [(f"{n}/one line", t.replace("\n\n", "\x00").replace("\n", " ").replace("\x00", "\n\n").replace(": 1.", ":\n1.")) for n, t in TEXTS.items()]
    rows += [("none", MIT.replace("free of charge", "for money")), ("/lines", "Released under the MIT License\nand more words\n\x01\nLicensed under CC BY 4.0"), ("empty", None)]
    return {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}


def test_wrapped_and_commented_notices_are_found(found):
    assert {k: r.licenses for k, r in found.items() if k.count("/") == 1 and k != "/lines"} == {k: k.split("/")[0] for k in found if k.count("/") == 1 and k != "/lines"}


def test_single_lines_are_still_found_in_order(found):
    assert found["none"].licenses == "" and found["empty"].n_sentences == 0
    r = found["/lines"]
    assert (r.n_sentences, r.n_known, r.sentence_ids, r.licenses) == (3, 2, "mit_release,cc_by4", "CC-BY-4.0,MIT")


def test_every_licence_is_found_by_its_names_and_its_tag(spark):
    rows = [(f"{x}/{n}", f"// {say} the {n.title()}.\n// more words") for x, names in license_scan.NAMES.items() for n in names for say in ("This program is licensed under", "Distributed under")]
    rows += [(f"{x}/tag", f"# SPDX-License-Identifier: {x}\nimport this") for x in license_scan.NAMES]
    rows += [("GPL-2.0/later", "SPDX-License-Identifier: GPL-2.0-or-later"), ("CC-BY-4.0/a", "This work is licensed under a Creative Commons Attribution 4.0 International License.")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(license_scan.NAMES) >= 50 and [(r.doc_id, r.licenses) for r in got if r.licenses != r.doc_id.split("/")[0]] == []


BSD3_NAMED = BSD + """3. Neither the name of Google Inc. nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission.
"""
BSD3_AUTHOR = BSD + """3. The name of the author may not be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.
"""
CC0 = """To the extent possible under law, the author(s) have dedicated all
copyright and related and neighboring rights to this software to the
public domain worldwide. This software is distributed without any warranty.
"""
MORE = {
    BSD3_NAMED: "BSD-3-Clause",
    BSD3_AUTHOR: "BSD-3-Clause",
    ASF: "Apache-2.0",
    GPL2_ONLY: "GPL-2.0",
    CC0: "CC0-1.0",
    "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
    "The software is released under the terms of the Apache License, Version 2.0.": "Apache-2.0",
    "License: MIT": "MIT",
    "Licence: Apache-2.0": "Apache-2.0",
    "Software License: BSD 3-Clause License": "BSD-3-Clause",
    "SPDX-License-Identifier: Apache-2.0 OR MIT": "Apache-2.0,MIT",
    "SPDX-License-Identifier: (MIT AND Zlib)": "MIT,Zlib",
    "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MPL-2.0": "GPL-2.0,MPL-2.0",
    "License terms vary with the licensee.": "",
    "They met under the MIT dome.": "",
    "SPDX-License-Identifier: Unknown-1.0": "",
}


@pytest.mark.parametrize("shape", ["plain", "commented", "hashed", "one line"])
def test_common_notices(spark, shape):
    """Each as it stands, behind two kinds of comment marks, and with all its lines joined."""
    def shaped(text):
        if shape == "one line":
            return " ".join(text.split())
        mark = {"plain": "", "commented": " * ", "hashed": "# "}[shape]
        return "\n".join(f"{mark}{line}".rstrip() for line in text.split("\n"))

    texts = list(MORE)
    rows = [(i, f"some code\n\n{shaped(t)}\n\nmore code here") for i, t in enumerate(texts)]
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == MORE


def test_very_long_texts_are_scanned_whole(spark):
    rows = [(1, "plain words here. " * 120_000 + "\n\nLicense: MIT\n"), (2, "a line of words\n" * 100_000 + ASF)]
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("MIT", 120_001) and got[2][0] == "Apache-2.0"
