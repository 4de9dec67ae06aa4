"""Licence notices as they stand in files, and texts that only resemble one."""

import pytest

from binforge.llm import jaccard, licenses
from tests.llm.util import SCHEMA

NOTICES = {
    "// SPDX-License-Identifier: MIT\nint main() {}": "MIT",
    "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0-or-later",
    "# SPDX-License-Identifier: BSD-3-Clause\r\nimport os": "BSD-3-Clause",
    "ISC License\n\nCopyright (c) 2020 Someone\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n": "ISC",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "0BSD",
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute\nthis software, either in source code form or as a compiled binary, for any\npurpose, commercial or non-commercial, and by any means.": "Unlicense",
    "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\") to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished to\ndo so, all subject to the following:\n": "BSL-1.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.": "GPL-3.0-only",
    "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "AGPL-3.0-only",
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": "LGPL-2.1-or-later",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "AGPL-3.0-or-later",
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.": "GPL-2.0-only",
    "licensed under CC BY 4.0, see file": "CC-BY-4.0",
    "This software is provided 'as-is', without any express or implied warranty. In no event\nwill the authors be liable.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "Zlib",
    "MIT\nis a university": None,
    "The identifier of SPDX licenses is MIT or ISC.": None,
    "We discussed the GNU General Public License, version 3, at length.": None,
    "Permission to use the gym is hereby granted, provided that this notice appears on all doors.": None,
    "Version 3, 29 June 2007\nGNU GENERAL PUBLIC LICENSE": None,
    "": None,
}


def test_notices(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(NOTICES)], SCHEMA)
    got = {r["doc_id"]: r["licence"] for r in licenses.scan(docs).collect()}
    assert {t: got[i] for i, t in enumerate(NOTICES)} == NOTICES


def test_sentences_are_in_normal_form_and_known_once():
    forms = [f for own in licenses.SENTENCES.values() for f in own]
    assert len(forms) == len(set(forms)) and all(f == " ".join(f.split()) and f.replace(" ", "").isalnum() and f == f.lower() for f in forms)
    assert {s for r in licenses.RULES for s in r.sequence} <= set(licenses.SENTENCES)


@pytest.mark.parametrize("gb,least", [(0, 1), (0.1, 12), (30, 12), (3000, 200)])
def test_counting_groups_follow_the_input(gb, least):
    n = jaccard.census_groups(int(gb * 1e9), least)
    assert n >= least and gb * 1e9 / 12 / n <= jaccard.GROUP
