import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stratalog.llm import licenses, queries_free

TEXTS = [
    None,
    "",
    "The MIT License",
    "mit\nLICENSE mit-license; General public license, general-public-license apache  license",
    "MIT Licenses and mitlicense and émit license",
    "Released under the MIT License.",
    "x " * 40000 + "Apache License",
    "Licensed under CC BY-NC 4.0.\nAll rights reserved.",
    "This work is licensed under the GNU General Public License, version 3.",
]


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", ["mit"]),
        ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", ["lgpl-2.1"]),
        ('"license": "BSD-3-Clause"', ["bsd-3-clause"]),
        ("see https://www.mozilla.org/en-US/MPL/2.0/ ok", ["mpl-2.0"]),
        ("Creative Commons Attribution-ShareAlike 4.0 International", ["cc-by-sa-4.0"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", ["mit"]),
        ("All rights reserved.", ["all-rights-reserved"]),
        ("Copyright (c) 2019-2021 Someone. GNU Affero General Public License v3", ["agpl-3.0", "copyright"]),
        ("a license to drive, summit licenses, my accommodation", []),
        ("the gpl", []),
    ],
)
def test_rules(text, labels):
    assert sorted({d.label for d in licenses.detect(text)}) == labels


def test_there_are_hundreds_of_rules_and_each_keyword_is_in_its_matches():
    assert len(licenses.rules()) > 300
    for text in filter(None, TEXTS):
        low = licenses.lowered(text)
        for rule in licenses.rules():
            for m in rule.pattern.finditer(low):
                assert rule.keyword in low, (rule.pattern.pattern, m[0])


def test_contained_detections_are_suppressed_and_ordered_ones_stay():
    text = "GNU General Public License, version 2 and the MIT License and GNU General Public License"
    found = licenses.detect(text)
    assert [d.label for d in found] == ["gpl-2.0", "mit", "gpl"]
    assert not any(a is not b and b.start <= a.start and a.end <= b.end for a in found for b in found)


def test_query_digests(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("found", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries_free.op9_licenses(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries_free.op9_licenses(spark, str(tmp_path)).count() == 0


WRAPPED = (
    "GNU General Public License, version 2", "Python Software Foundation License", "SIL Open Font License", "Open Database License", "Open Data Commons Attribution License",
    "Open Data Commons Public Domain Dedication and License", "Business Source License", "Server Side Public License", "Universal Permissive License", "Academic Free License", "Open Software License",
    "Blue Oak Model License", "CC BY 4.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", "released into the public domain", "All rights reserved",
    "You may not copy it without prior written permission", "licensed under the Foo Bar License",
)


@pytest.mark.parametrize("space", ["\n", "\t"])
def test_keywords_of_several_words_are_found_over_line_ends(space):
    many = {rule.keyword for rule in licenses.rules() if " " in rule.keyword} - {"cc by"}
    assert all(any(k in t.lower() for t in WRAPPED) for k in many)
    for text in WRAPPED:
        want = {d.label for d in licenses.detect(text)}
        assert want and {d.label for d in licenses.detect(text.replace(" ", space, 2 if "Foo" in text else -1))} == want, text  # that name is on one line
    assert [d.label for d in licenses.detect("GNU General\r\n  Public License, version 2")] == ["gpl-2.0"]


def test_suppression_equals_comparing_all_and_is_no_square():
    parts = ["MIT License", "Licensed under the MIT License", "GNU General Public License, version 3", "the Apache License, Version 2.0", "All rights reserved", "CC BY 4.0", "x"]
    rnd = random.Random(3)
    for _ in range(60):
        text = rnd.choice((" ", ", ", "\n")).join(rnd.choice(parts) for _ in range(rnd.randrange(1, 30)))
        low, table = licenses.lowered(text), licenses.rules()
        every = sorted((-r.priority, m.start() - m.end(), m.start(), i, m.end()) for i, r in enumerate(table) if r.keyword in " ".join(low.split()) for m in r.pattern.finditer(low))
        kept = []
        for _, _, start, i, end in every:
            if not any(k.start <= start and end <= k.end for k in kept):
                kept.append(licenses.Detection(start, end, table[i].label, table[i].confidence))
        assert licenses.detect(text) == sorted(kept)
    began = time.time()
    assert len(licenses.detect("Licensed under the MIT License and GNU General Public License, version 2.\n" * 14_000)) == 28_000
    assert time.time() - began < 30
