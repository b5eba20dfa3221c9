import pytest

from loomspark.llm import license_scan as L

SAID = [
    ("Released under the MIT License.", "mit"), ("RELEASED UNDER THE MIT LICENSE", "mit"), ("All rights reserved.", "proprietary"),
    ("Copyright 2019 Acme. All rights reserved.", "proprietary"), ("Licensed under CC BY-NC 3.0", "cc-by-nc"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl"), ("licensed under the apache license, version 2.0", "apache"),
    ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "lgpl"),
]
NOT_SAID = ["You need a driver license to rent the car.", "The rights of all workers are reserved for later days", "The general public works", "GNU", "", "  ", "license"]


@pytest.mark.parametrize("text,family", SAID)
def test_notices(text, family):
    n, found = L.scanner().scan(f"Some prose here.\n{text}\n\nMore prose.")
    assert n == 3 and [(k, f) for k, f, _, _ in found] == [(1, family)]


@pytest.mark.parametrize("text", NOT_SAID)
def test_prose(text):
    assert not L.scanner().scan(text)[1]


def test_held_out_accuracy():
    import random

    s = L.scanner()
    rows = s._variants(random.Random(99))
    right = sum((s.families[k] if k < len(s.families) else None) == s.classify(w)[0] for w, k in rows)
    fooled = sum(k == len(s.families) and s.classify(w)[0] is not None for w, k in rows)
    assert right > 0.8 * len(rows) and fooled <= L.FALSE_RATE * len(rows)


#: Written by hand as projects state them, not made from the notices; what no family explains is unknown.
HELD_OUT = [
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "mit"), ("Code released under the MIT license, docs elsewhere.", "mit"),
    ("SPDX-License-Identifier: MIT", "mit"), ("Source is available under the Apache License 2.0 from our site.", "apache"), ("Licensed under Apache License, Version 2.0, January 2004", "apache"),
    ("You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "apache"), ("The kernel is distributed under the GNU General Public License v2.", "gpl"),
    ("it is provided under the GPL version 2 only", "gpl"), ("This library is distributed under the GNU Lesser General Public License, version 3.", "lgpl"),
    ("The server is under the terms of the GNU Affero General Public License, as published by the Free Software Foundation, version 3.", "agpl"),
    ("Use is permitted under the BSD License.", "bsd"), ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions hold:", "bsd"),
    ("This file is subject to the terms of the Mozilla Public License, v. 2.0", "mpl"), ("Photos are licensed under CC BY 4.0", "cc-by"), ("Text licensed under CC BY-SA 3.0 unless noted", "cc-by-sa"),
    ("This image is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"), ("Music licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"),
    ("Copyright (c) 2011 by the authors. All rights reserved.", "proprietary"), ("To the extent possible under law, the person who associated CC0 has waived all copyright and related or neighboring rights to this work.", "cc0"),
    ("made available under the terms of the Eclipse Public License v1.0", "epl"), ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "boost"),
    ("This software is released under the Fair Harbour License, version 7.", "unknown"), ("Licensed under the Quokka Community Licence.", "unknown"),
    ("Its use is subject to the terms of the Tulip Game Licence agreement.", "unknown"), ("This document is distributed under the Verbatim Press licence.", "unknown"),
    ("The committee agreed on the terms of the meeting.", ""), ("Fish was available under the bridge.", ""), ("The album was released under a new name in May.", ""),
    ("She has a licence to teach.", ""), ("The rights of way are shown on the map.", ""), ("Free of charge for any person over sixty.", ""), ("Version 2.0 of the story is better.", ""),
    ("Permission to land was granted at noon.", ""), ("The software is good and the public likes it.", ""), ("A general lesser known to the public", ""),
]


def test_held_out_statements():
    got = [(t, f, ",".join(sorted({x[1] for x in L.scanner().scan(t)[1]}))) for t, f in HELD_OUT]
    wrong = [x for x in got if x[1] != x[2]]
    assert len(wrong) <= len(got) // 12, wrong
    assert not [x for x in wrong if not x[1]], wrong  # prose is never a licence


def test_scan_equals_search(spark):
    """Whole notices of each family between plain words, found by a search for their text."""
    import random

    rng, rows = random.Random(2), []
    lines = [(f, t) for f in L.NOTICES for t in L.NOTICES[f] if not t.startswith(("under", "it under", "you can"))]
    for k in range(150):
        said = rng.sample(lines, rng.randrange(0, 4))
        body = [" ".join(rng.choices(["river", "stone", "walks", "green", "early"], k=rng.randrange(1, 60))) + "." for _ in range(rng.randrange(1, 6))]
        for _, t in said:
            body.insert(rng.randrange(len(body) + 1), t)
        rows.append((k, "\n\n".join(body), ",".join(sorted({f for f, _ in said}))))
    rows.append((149, *rows[-1][1:]))  # a repeated row
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, families string")).collect()
    assert sorted((r.doc_id, r.families) for r in got) == sorted((k, f) for k, _, f in rows)


def test_leaving_out_unscored_paragraphs_changes_nothing():
    s = L.scanner()
    for text in [t for t, _ in SAID] + NOT_SAID + ["all rights", "under the version of the work", "the public domain"]:
        w = L.words(text)
        if s.peculiar.isdisjoint(w) or s.pairs.isdisjoint(zip(w, w[1:], strict=False)):
            assert not w or s.classify(w)[0] is None


def test_documents(spark):
    rows = [(1, "a b c\nReleased under the MIT License.\nAll rights reserved.", "x"), (1, None, "x"), (2, "", None), (None, "plain\n\ntext", "x"), (3, "word " * 50_000 + "ends. Released under the MIT License.", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    got = sorted(L.scan_licenses(frame).collect(), key=str)
    assert [(r.doc_id, r.n_paragraphs, r.families) for r in got] == [(1, 0, ""), (1, 3, "mit,proprietary"), (2, 0, ""), (3, 2, "mit"), (None, 2, "")]
    assert L.scan_licenses(frame.limit(0)).count() == 0


GPL = """{0} This program is free software{1} you can redistribute it and/or modify
{0} it under the terms of the GNU General Public License as published by
{0} the Free Software Foundation{2} either version {3} of the License, or
{0} (at your option) any later version.
{0}
{0} This program is distributed in the hope that it will be useful,
{0} but WITHOUT ANY WARRANTY; without even the implied warranty of
{0} MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
{0} GNU General Public License for more details.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""


@pytest.mark.parametrize("lead", ["", "#", " *", "//"])
@pytest.mark.parametrize("signs", [(":", ",", 3), (";", ";", 2)])
def test_wrapped_header_is_one_hit(lead, signs):
    for before, at in (("", (0, 1)), ("{0} thing - does a thing\n{0} Written by Some One\n", (2, 3))):
        n, found = L.scanner().scan((before + GPL).format(lead, *signs))
        assert n == 8 + 2 * bool(before) + bool(lead) and {f for _, f, _, _ in found} == {"gpl"} and found[0][0] in at and len(found) == 1


def test_other_wrapped_notices():
    s = L.scanner()
    assert [(k, f) for k, f, _, _ in s.scan("title\n\n" + MIT)[1]] == [(1, "mit")]
    lesser = GPL.replace("GNU General", "GNU Lesser General").replace("program", "library").format("", ";", ";", 2)
    assert {f for _, f, _, _ in s.scan(lesser)[1]} == {"lgpl"}
    affero = GPL.replace("GNU General", "GNU Affero General").format("", ":", ",", 3)
    assert {f for _, f, _, _ in s.scan(affero)[1]} == {"agpl"}


@pytest.mark.parametrize("n", [1, 5, 11, 23, 34, 39, 80, 400])
def test_notice_inside_a_line(n):
    prose = " ".join(["river", "stone", "walks", "over", "green"][k % 5] for k in range(n))
    for text in (f"{prose}. Released under the MIT License.", f"{prose}, released under the MIT License, {prose}", f"{prose}. Released under the MIT License. {prose}."):
        assert [f for _, f, _, _ in L.scanner().scan(text)[1]] == ["mit"]
    both = L.scanner().scan(f"{prose}. Released under the MIT License. All rights reserved.")[1]
    assert [f for _, f, _, _ in both] == ["mit", "proprietary"]
