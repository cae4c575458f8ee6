"""License scans by ordered signature rules.

A rule is a hand-written regular expression over the text with A-Z lower-cased, with the label it gives, a priority, a
confidence and a keyword that every match holds. One Aho-Corasick pass over a text finds its keywords, and only their rules
run. Detections are taken in order of priority, then length, then place; one whose interval lies within a detection taken
before is suppressed, so that "gnu general public license, version 3" yields gpl-3.0-only once, and not the bare family too.

The rules of a license come from its names: the tag, the license field of a manifest, the address, the notice ("licensed
under ...") and the bare name each become one expression, after further ones for whole texts and special notices.

Defined cases: a null text is empty. Empty texts have no words, no labels and score 0. Whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import slices

#: Characters that words do not have, in lower-cased text; all others, every one beyond ASCII too, belong to words.
_NO_WORD = bytes((*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))
_TO_SPACE = bytes.maketrans(_NO_WORD, b" " * len(_NO_WORD))
PHRASES = (((b"mit", b"license"), "mit"), ((b"apache", b"license"), "apache"), ((b"general", b"public", b"license"), "gpl"))

#: (label, keyword, expression of the name in running text, tags, addresses), the more special before the more general.
LICENSES = (
    ("apache-2.0", "apache", r"(?:the )?apache(?: software)? licen[cs]e,?(?: \(?version| v\.?)? ?2(?:\.0)?\)?", ("apache-2.0", "apache 2.0"), ("apache.org/licenses/license-2.0",)),
    ("apache-1.1", "apache", r"(?:the )?apache software licen[cs]e,? version 1\.1", ("apache-1.1",), ("apache.org/licenses/license-1.1",)),
    ("mit", "mit", r"(?:the )?mit licen[cs]e", ("mit",), ("opensource.org/licenses/mit", "opensource.org/license/mit")),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", ("mit-0",), ("opensource.org/licenses/mit-0",)),
    ("x11", "x11", r"(?:the )?x11 licen[cs]e", ("x11",), ()),
    ("isc", "isc", r"(?:the )?isc licen[cs]e", ("isc",), ("opensource.org/licenses/isc",)),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:simplified bsd|bsd[ -]2[ -]clause|freebsd)(?: licen[cs]e)?", ("bsd-2-clause",), ("opensource.org/licenses/bsd-2-clause",)),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:new bsd|modified bsd|bsd[ -]3[ -]clause|3-clause bsd)(?: licen[cs]e)?", ("bsd-3-clause",), ("opensource.org/licenses/bsd-3-clause",)),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:original bsd|bsd[ -]4[ -]clause|4-clause bsd)(?: licen[cs]e)?", ("bsd-4-clause",), ()),
    ("0bsd", "bsd", r"(?:zero[- ]clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?", ("0bsd",), ("opensource.org/licenses/0bsd",)),
    ("bsd", "bsd", r"(?:the )?bsd(?:-style)? licen[cs]e", ("bsd",), ()),
    ("agpl-3.0", "affero", r"gnu affero general public licen[cs]e,?(?: \(?version| v\.?) ?3(?:\.0)?\)?", ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "agplv3"), ("gnu.org/licenses/agpl", "opensource.org/licenses/agpl-3.0")),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", ("agpl",), ()),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[cs]e,?(?: \(?version| v\.?) ?2\.1\)?", ("lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgplv2.1"), ("gnu.org/licenses/lgpl-2.1", "gnu.org/licenses/old-licenses/lgpl-2.1")),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[cs]e,?(?: \(?version| v\.?) ?3(?:\.0)?\)?", ("lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later", "lgplv3"), ("gnu.org/licenses/lgpl-3.0", "opensource.org/licenses/lgpl-3.0")),
    ("lgpl-2.0", "library", r"gnu library general public licen[cs]e", ("lgpl-2.0", "lgpl-2.0-only", "lgpl-2.0-or-later"), ("gnu.org/licenses/old-licenses/lgpl-2.0",)),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e", ("lgpl",), ("gnu.org/licenses/lgpl.html",)),
    ("gpl-3.0", "general public", r"(?:the )?(?:gnu )?general public licen[cs]e,?(?: \(?version| v\.?) ?3(?:\.0)?\)?", ("gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gplv3", "gpl v3"), ("gnu.org/licenses/gpl-3.0", "opensource.org/licenses/gpl-3.0")),
    ("gpl-2.0", "general public", r"(?:the )?(?:gnu )?general public licen[cs]e,?(?: \(?version| v\.?) ?2(?:\.0)?\)?", ("gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gplv2", "gpl v2"), ("gnu.org/licenses/gpl-2.0", "gnu.org/licenses/old-licenses/gpl-2.0")),
    ("gpl-1.0", "general public", r"(?:the )?(?:gnu )?general public licen[cs]e,?(?: \(?version| v\.?) ?1(?:\.0)?\)?", ("gpl-1.0", "gpl-1.0-only", "gpl-1.0-or-later"), ()),
    ("gpl", "general public", r"(?:the )?(?:gnu )?general public licen[cs]e", ("gpl", "gnu gpl"), ("gnu.org/licenses/gpl.html", "gnu.org/copyleft/gpl")),
    ("gfdl", "documentation", r"(?:the )?gnu free documentation licen[cs]e", ("gfdl", "gfdl-1.3", "gfdl-1.2"), ("gnu.org/licenses/fdl", "gnu.org/copyleft/fdl")),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public licen[cs]e,?(?: \(?version| v\.?)? ?1\.1\)?", ("mpl-1.1",), ("mozilla.org/mpl/1.1",)),
    ("mpl-2.0", "mozilla", r"(?:the )?mozilla public licen[cs]e,?(?: \(?version| v\.?)? ?2(?:\.0)?\)?", ("mpl-2.0",), ("mozilla.org/mpl/2.0", "mozilla.org/en-us/mpl/2.0")),
    ("mpl", "mozilla", r"(?:the )?mozilla public licen[cs]e", ("mpl",), ("mozilla.org/mpl",)),
    ("epl-1.0", "eclipse", r"(?:the )?eclipse public licen[cs]e,?(?: -)?(?: \(?version| v\.?)? ?1(?:\.0)?\)?", ("epl-1.0",), ("eclipse.org/legal/epl-v10",)),
    ("epl-2.0", "eclipse", r"(?:the )?eclipse public licen[cs]e,?(?: -)?(?: \(?version| v\.?)? ?2(?:\.0)?\)?", ("epl-2.0",), ("eclipse.org/legal/epl-2.0", "eclipse.org/legal/epl-v20")),
    ("cddl-1.0", "cddl", r"(?:common development and distribution licen[cs]e )?\(?cddl\)?(?:[ -]1\.0)?", ("cddl-1.0", "cddl"), ("opensource.org/licenses/cddl-1.0",)),
    ("eupl", "european", r"(?:the )?european union public licen[cs]e", ("eupl-1.1", "eupl-1.2"), ("joinup.ec.europa.eu/collection/eupl",)),
    ("artistic", "artistic", r"(?:the )?artistic licen[cs]e(?:,? ?(?:version )?[12]\.0)?", ("artistic-2.0", "artistic-1.0"), ("opensource.org/licenses/artistic-2.0",)),
    ("zlib", "zlib", r"(?:the )?zlib(?:/libpng)? licen[cs]e", ("zlib",), ("opensource.org/licenses/zlib",)),
    ("bsl-1.0", "boost", r"(?:the )?boost software licen[cs]e(?:,? version 1\.0)?", ("bsl-1.0",), ("boost.org/license_1_0",)),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ("unlicense",), ("unlicense.org",)),
    ("wtfpl", "wtfpl", r"wtfpl", ("wtfpl",), ("wtfpl.net",)),
    ("python-2.0", "python software", r"(?:the )?python software foundation licen[cs]e", ("python-2.0", "psf-2.0"), ("docs.python.org/license",)),
    ("postgresql", "postgresql", r"(?:the )?postgresql licen[cs]e", ("postgresql",), ("opensource.org/licenses/postgresql",)),
    ("openssl", "openssl", r"(?:the )?openssl licen[cs]e", ("openssl",), ()),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", ("ms-pl",), ("opensource.org/licenses/ms-pl",)),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", ("ms-rl",), ()),
    ("ofl-1.1", "open font", r"(?:the )?(?:sil )?open font licen[cs]e(?:,? version 1\.1)?", ("ofl-1.1",), ("scripts.sil.org/ofl", "openfontlicense.org")),
    ("odbl-1.0", "open database", r"open (?:data commons open )?database licen[cs]e", ("odbl-1.0",), ("opendatacommons.org/licenses/odbl",)),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e", ("odc-by-1.0",), ("opendatacommons.org/licenses/by",)),
    ("pddl-1.0", "public domain dedication", r"open data commons public domain dedication(?: and licen[cs]e)?", ("pddl-1.0",), ("opendatacommons.org/licenses/pddl",)),
    ("bigscience-rail", "rail", r"(?:bigscience )?(?:open)?rail(?:-[ms])? licen[cs]e", ("bigscience-openrail-m", "openrail"), ()),
    ("busl-1.1", "business source", r"(?:the )?business source licen[cs]e(?: 1\.1)?", ("busl-1.1",), ("mariadb.com/bsl11",)),
    ("sspl-1.0", "server side", r"(?:the )?server side public licen[cs]e", ("sspl-1.0",), ("mongodb.com/licensing/server-side-public-license",)),
    ("elastic-2.0", "elastic", r"(?:the )?elastic licen[cs]e(?: 2\.0)?", ("elastic-2.0",), ("elastic.co/licensing/elastic-license",)),
    ("upl-1.0", "universal permissive", r"(?:the )?universal permissive licen[cs]e", ("upl-1.0",), ()),
    ("afl-3.0", "academic free", r"(?:the )?academic free licen[cs]e", ("afl-3.0",), ()),
    ("osl-3.0", "open software", r"(?:the )?open software licen[cs]e", ("osl-3.0",), ()),
    ("cecill", "cecill", r"cecill(?:-[abc])?(?: licen[cs]e)?", ("cecill-2.1", "cecill-b", "cecill-c"), ("cecill.info",)),
    ("vim", "vim", r"(?:the )?vim licen[cs]e", ("vim",), ()),
    ("ruby", "ruby", r"(?:the )?ruby licen[cs]e", ("ruby",), ()),
    ("php-3.01", "php", r"(?:the )?php licen[cs]e", ("php-3.01", "php-3.0"), ("php.net/license",)),
    ("w3c", "w3c", r"(?:the )?w3c(?: software)?(?: notice and)? licen[cs]e", ("w3c",), ("w3.org/consortium/legal",)),
    ("blueoak-1.0.0", "blue oak", r"(?:the )?blue oak model licen[cs]e", ("blueoak-1.0.0",), ("blueoakcouncil.org/license",)),
)
#: Creative Commons: elements of the short name, with their words in the long one.
CREATIVE = (("by-nc-nd", "attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s"), ("by-nc-sa", "attribution[- ]non-?commercial[- ]share-?alike"), ("by-nc", "attribution[- ]non-?commercial"), ("by-nd", "attribution[- ]no-?deriv(?:ative)?s"), ("by-sa", "attribution[- ]share-?alike"), ("by", "attribution"))
#: Notices and passages of whole license texts: (label, keyword, expression, confidence).
PASSAGES = (
    ("mit", "free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted", 0.9),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote", 0.95),
    ("apache-2.0", "apache", r"licensed under the apache license, version 2\.0 \(the .{0,3}license.{0,3}\)", 1.0),
    ("gpl", "free software", r"this program is free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public license", 1.0),
    ("lgpl", "free software", r"this library is free software[:;] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license", 1.0),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0", 1.0),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty\. in no event will the authors be held liable", 1.0),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 1.0),
    ("bsl-1.0", "boost", r"distributed under the boost software license, version 1\.0", 1.0),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1\.0)?(?: universal)?", 0.9),
    ("cc0-1.0", "public domain dedication", r"cc0 1\.0 universal(?: \(cc0 1\.0\))? public domain dedication", 1.0),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|in|is) (?:in|to|into)? ?the public domain", 0.8),
    ("all-rights-reserved", "all rights", r"all rights reserved", 0.7),
    ("proprietary", "proprietary", r"proprietary and confidential", 0.8),
    ("proprietary", "confidential", r"unauthorized (?:copying|use|reproduction) of this (?:file|document|material).{0,60}? is strictly prohibited", 0.9),
    ("proprietary", "may not", r"you may not (?:copy|reproduce|redistribute|modify)[^.]{0,80}without (?:prior )?written permission", 0.8),
    ("copyright", "copyright", r"copyright (?:\(c\) |© )?(?:19|20)\d\d(?:\s*[-,–]\s*(?:19|20)?\d\d)*", 0.5),
    ("copyright", "©", r"© ?(?:19|20)\d\d", 0.5),
    ("unknown-license", "licensed under", r"licensed under (?:the |a )?[a-z0-9][^.\n]{2,60}? licen[cs]e", 0.4),
    ("unknown-license", "license", r"see (?:the )?(?:accompanying )?license(?:\.txt|\.md)? (?:file )?for (?:details|terms|more)", 0.4),
)


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    confidence: float


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    confidence: float


def _spaced(expression: str) -> str:
    """Blanks of an expression stand for any white space."""
    return expression.replace(" ", r"\s+").replace(r"\s+?", r"\s*")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules; those that stand earlier win between detections of one interval."""
    table = list(LICENSES)
    for short, long in CREATIVE:
        dashed = short.replace("-", "[- ]")
        for version in ("4.0", "3.0", "2.5", "2.0"):
            at = re.escape(version)
            for gap in " -":
                table.append((f"cc-{short}-{version}", f"cc{gap}by", rf"cc{gap}{dashed}[- ]{at}", (f"cc-{short}-{version}",) * (gap == "-"), ()))
            table.append((f"cc-{short}-{version}", "creative", rf"creative commons {long} {at}(?: international| unported| generic)?", (), (f"creativecommons.org/licenses/{short}/{version}",)))
        table.append((f"cc-{short}", "creative", rf"creative commons {long}(?: licen[cs]e)?", (), (f"creativecommons.org/licenses/{short}/",)))
        table += [(f"cc-{short}", f"cc{gap}by", rf"cc{gap}{dashed}(?![-\w])", (), ()) for gap in " -"]
    out = [Rule(label, keyword, re.compile(r"(?<![a-z0-9])" * keyword[:1].isalpha() + _spaced(e)), 90, sure) for label, keyword, e, sure in PASSAGES if sure >= 0.9]
    for label, keyword, name, tags, places in table:
        if tags:
            tag = "|".join(re.escape(t) for t in sorted(tags, key=len, reverse=True))
            out.append(Rule(label, "spdx", re.compile(rf"spdx-license-identifier:\s*(?:{tag})(?![\w.-])"), 100, 1.0))
            out.append(Rule(label, "licen", re.compile(rf"[\"']?licen[cs]e[\"']?\s*[:=]\s*[\"']?(?:{tag})(?![\w.-])"), 80, 0.95))
        out += [Rule(label, p.split("/")[0].removeprefix("www."), re.compile(re.escape(p) + r"(?![\w-])"), 70, 0.95) for p in places]
        out.append(Rule(label, keyword, re.compile(_spaced(rf"(?:licensed|released|distributed|available|published|provided) under (?:the terms of )?(?:the |an? )?{name}")), 60, 0.95))
        out.append(Rule(label, keyword, re.compile(r"(?<![a-z0-9-])" + _spaced(name) + r"(?![a-z0-9])"), 50, 0.8))
    out += [Rule(label, keyword, re.compile(r"(?<![a-z0-9])" * keyword[:1].isalpha() + _spaced(e)), 20, sure) for label, keyword, e, sure in PASSAGES if sure < 0.9]
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def _gate():
    import ahocorasick

    machine, by_keyword = ahocorasick.Automaton(), {}
    for i, rule in enumerate(rules()):
        by_keyword.setdefault(rule.keyword, []).append(i)
    for keyword, own in by_keyword.items():
        machine.add_word(keyword, tuple(own))
    machine.make_automaton()
    return machine


def lowered(text: str) -> str:
    """A-Z lower-cased, nothing else, so that places stay."""
    return text.encode().lower().decode()


def detect(text: str | None) -> list[Detection]:
    """The detections that stay, by place; intervals are code points of the text."""
    if not text:
        return []
    low = lowered(text)
    # The rules take any white space where a keyword has a blank.
    active = sorted({i for _, own in _gate().iter(" ".join(low.split())) for i in own})
    if not active:
        return []
    table = rules()
    found = [(-table[i].priority, m.start() - m.end(), m.start(), i, m.end()) for i in active for m in table[i].pattern.finditer(low) if m.end() > m.start()]
    # The furthest end of the kept ones that begin at or before a place, in a tree over the places.
    place = {start: at for at, start in enumerate(sorted({f[2] for f in found}), 1)}
    furthest, kept = [0] * (len(place) + 1), []
    for _, _, start, i, end in sorted(found):
        at, most = place[start], 0
        while at:
            most = max(most, furthest[at])
            at &= at - 1
        if most < end:
            kept.append(Detection(start, end, table[i].label, table[i].confidence))
            at = place[start]
            while at < len(furthest):
                furthest[at] = max(furthest[at], end)
                at += at & -at
    return sorted(kept)


def phrase_places(text: bytes) -> tuple[int, list[tuple[int, str]]]:
    """The number of words, and (place, label) of each run of a phrase's words, from UTF-8."""
    words = text.lower().translate(_TO_SPACE).split()
    found: list[tuple[int, str]] = []
    if b"license" in text.lower():
        at = -1
        while True:
            try:
                at = words.index(b"license", at + 1)
            except ValueError:
                break
            found += [(at + 1 - len(p), label) for p, label in PHRASES if at + 1 >= len(p) and tuple(words[at + 1 - len(p) : at + 1]) == p]
    return len(words), found


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, places, found): the phrases' (word, label), and the rules' (start, end, label, confidence)."""
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    hit = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                base = [phrase_places(t.encode()) if t else (0, []) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([n for n, _ in base], pa.int64()),
                        pa.array([[{"word": w, "label": x} for w, x in places] for _, places in base], place),
                        pa.array([[d._asdict() for d in detect(t)] for t in texts], hit),
                    ],
                    ["key", "n_words", "places", "found"],
                )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    kinds = "key long, n_words long, places array<struct<word:long,label:string>>, found array<struct<start:long,end:long,label:string,confidence:double>>"
    return rows.mapInArrow(run, kinds).withColumnRenamed("key", key)
