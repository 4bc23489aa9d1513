"""License scans: ordered signature rules, gated by keywords, with priorities and containment.

Every text is reduced to its words: A-Z lower-cased, maximal runs of 0-9, a-z and characters beyond
ASCII. A signature is a regular expression over the words joined by single spaces, with a label, a
priority and a confidence. A text is searched for a signature only if one of its words begins with
one of the signature's keywords, which cover all its alternatives. Of overlapping detections the one
of higher priority wins, then the longer, then the earlier; a detection inside a kept one is
suppressed.

The three base phrases are counted at all their places, whatever the other rules find. Null and
empty texts have no words and no detections; texts are searched whole. Rows are judged alone, so
repeated rows agree; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common

BATCH_BYTES = 4 << 20

#: The base phrases and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: A word that every text with the base phrase has, by label.
BASE_KEYWORDS = [("mit", "mit"), ("apache-2", "apache"), ("cc-by-nc", "cc")]

#: Label, keywords of which a text must hold one, and how the license is named, over words joined by spaces.
LICENSES = [
    ("mit", "mit", r"(?:the )?(?:expat )?mit(?: x11)?"),
    ("apache-2", "apache", r"(?:the )?apache(?: software)?(?: license)? (?:version |v)?2(?: 0)?"),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)?(?: license)? (?:version |v)?1 1"),
    ("gpl-3.0", "gpl", r"(?:the )?(?:gnu )?gpl ?(?:version |v)?3(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:the )?(?:gnu )?gpl ?(?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:the )?gnu general public license(?: as published by the free software foundation)? (?:either )?(?:version |v)3"),
    ("gpl-2.0", "general", r"(?:the )?gnu general public license(?: as published by the free software foundation)? (?:either )?(?:version |v)2"),
    ("lgpl-3.0", "lgpl", r"(?:the )?(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:the )?(?:gnu )?lgpl ?(?:version |v)?2 1"),
    ("lgpl-2.1", "lesser", r"(?:the )?gnu lesser general public license (?:version |v)2 1"),
    ("lgpl-3.0", "lesser", r"(?:the )?gnu lesser general public license (?:version |v)3"),
    ("agpl-3.0", "agpl", r"(?:the )?(?:gnu )?agpl ?(?:version |v)?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:the )?gnu affero general public license"),
    ("bsd-2-clause", "bsd freebsd", r"(?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)"),
    ("0bsd", "bsd 0bsd", r"(?:the )?(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("bsd", "bsd", r"(?:the )?bsd"),
    ("isc", "isc", r"(?:the )?isc"),
    ("mpl-2.0", "mpl", r"(?:the )?mpl ?(?:version |v)?2(?: 0)?"),
    ("mpl-2.0", "mozilla", r"(?:the )?mozilla public license (?:version |v)?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public license (?:version |v)?1 1"),
    ("epl-2.0", "eclipse", r"(?:the )?eclipse public license (?:version |v)?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"(?:the )?eclipse public license (?:version |v)?1(?: 0)?"),
    ("cddl-1.0", "cddl", r"(?:the )?cddl(?: (?:version |v)?1(?: 0)?)?"),
    ("eupl-1.2", "eupl", r"(?:the )?eupl(?: (?:version |v)?1 2)?"),
    ("artistic-2.0", "artistic", r"(?:the )?artistic license(?: (?:version |v)?2(?: 0)?)?"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?"),
    ("bsl-1.0", "boost", r"(?:the )?boost software license(?: (?:version |v)?1(?: 0)?)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc creative", r"(?:creative commons|cc) by nc nd(?: \d 0)?"),
    ("cc-by-nc-sa", "cc creative", r"(?:creative commons|cc) by nc sa(?: \d 0)?"),
    ("cc-by-nc", "cc creative", r"(?:creative commons|cc) by nc(?: \d 0)?"),
    ("cc-by-nd", "cc creative", r"(?:creative commons|cc) by nd(?: \d 0)?"),
    ("cc-by-sa", "cc creative", r"(?:creative commons|cc) by sa(?: \d 0)?"),
    ("cc-by", "cc creative", r"(?:creative commons|cc) by(?: \d 0)?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: \d 0)?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: \d 0)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: \d 0)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: \d 0)?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: \d 0)?"),
    ("cc-by", "creative", r"creative commons attribution(?: \d 0)?"),
    ("odbl-1.0", "odbl", r"(?:the )?odbl(?: 1 0)?"),
    ("ofl-1.1", "sil", r"(?:the )?sil open font license(?: (?:version |v)?1 1)?"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public license"),
    ("postgresql", "postgresql", r"(?:the )?postgresql license"),
    ("python-2.0", "psf python", r"(?:the )?(?:psf license|python software foundation license)"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)?"),
]

#: Ways to say that something is licensed: name, pattern around the license's name, priority, confidence.
PHRASINGS = [
    ("spdx", r"spdx license identifier {}", 90, 1.0),
    ("grant", r"(?:is |are |be )?(?:licensed|distributed|released|published|available|provided|made available) under (?:the terms of )?{}(?: (?:public )?licen[sc]e)?", 80, 0.95),
    ("terms", r"(?:under|subject to) (?:the )?(?:terms|conditions)(?: and conditions)? of {}(?: licen[sc]e)?", 70, 0.9),
    ("field", r"licen[sc]e (?:is )?{}(?: licen[sc]e)?", 60, 0.85),
    ("named", r"{} licen[sc]e", 50, 0.8),
    ("under", r"under {}", 40, 0.6),
]

#: Single signatures that name no license by title: label, keywords, pattern, priority, confidence.
TEXTS = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 95, 1.0),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 95, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 95, 0.95),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", 95, 0.95),
    ("all-rights-reserved", "rights", r"all rights reserved", 20, 0.5),
    ("proprietary", "proprietary", r"(?:this (?:software|document|work) is |strictly )?proprietary and confidential", 30, 0.7),
    ("public-domain", "domain", r"(?:released |dedicated |placed )?(?:in|into|to) the public domain", 30, 0.7),
    ("no-commercial-use", "commercial", r"(?:not for|no) commercial use", 30, 0.6),
    ("mit", "copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 94, 0.95),
    ("mit", "provided", r"the software is provided as is without warranty of any kind express or implied", 60, 0.7),
    ("apache-2", "apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0", 96, 1.0),
    ("apache-2", "apache", r"https? www apache org licenses license 2 0(?: txt| html)?", 92, 0.95),
    ("apache-2", "distributed", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", 91, 0.9),
    ("apache-2", "contributor", r"licensed to the apache software foundation asf under one or more contributor license agreements", 95, 1.0),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission", 94, 0.95),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledgement", 96, 1.0),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 93, 0.95),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 93, 0.9),
    ("gpl-3.0", "gnu", r"gnu general public license version 3 29 june 2007", 97, 1.0),
    ("gpl-2.0", "gnu", r"gnu general public license version 2 june 1991", 97, 1.0),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public license along with this (?:program|library|software|file)", 94, 0.95),
    ("lgpl", "gnu", r"you should have received a copy of the gnu lesser general public license along with this (?:program|library|software|file)", 94, 0.95),
    ("agpl-3.0", "gnu", r"you should have received a copy of the gnu affero general public license along with this (?:program|library|software|file)", 94, 0.95),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 90, 0.9),
    ("lgpl-2.1", "gnu", r"gnu lesser general public license version 2 1 february 1999", 97, 1.0),
    ("agpl-3.0", "gnu", r"gnu affero general public license version 3 19 november 2007", 97, 1.0),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 96, 1.0),
    ("mpl-2.0", "mozilla", r"if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0", 96, 1.0),
    ("epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 96, 1.0),
    ("epl-1.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 96, 1.0),
    ("cddl-1.0", "common", r"the contents of this file are subject to the terms of the common development and distribution license(?: the license)?(?: cddl)?", 96, 1.0),
    ("bsl-1.0", "boost", r"distributed under the boost software license version 1 0 see accompanying file license 1 0 txt", 96, 1.0),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 95, 1.0),
    ("zlib", "origin", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 95, 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 96, 1.0),
    ("unlicense", "unlicense", r"for more information please refer to https? unlicense org", 92, 0.95),
    ("wtfpl", "fuck", r"do what the fuck you want to public license", 96, 1.0),
    ("wtfpl", "fuck", r"you just do what the fuck you want to", 95, 0.95),
    ("cc0-1.0", "waived", r"has waived all copyright and related or neighboring rights to this work", 95, 1.0),
    ("cc-by", "creativecommons", r"https? creativecommons org licenses by \d 0", 92, 0.95),
    ("cc-by-sa", "creativecommons", r"https? creativecommons org licenses by sa \d 0", 92, 0.95),
    ("cc-by-nc", "creativecommons", r"https? creativecommons org licenses by nc \d 0", 92, 0.95),
    ("cc-by-nd", "creativecommons", r"https? creativecommons org licenses by nd \d 0", 92, 0.95),
    ("cc-by-nc-sa", "creativecommons", r"https? creativecommons org licenses by nc sa \d 0", 92, 0.95),
    ("cc-by-nc-nd", "creativecommons", r"https? creativecommons org licenses by nc nd \d 0", 92, 0.95),
    ("cc0-1.0", "creativecommons", r"https? creativecommons org publicdomain zero 1 0", 92, 0.95),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1", 96, 1.0),
    ("artistic-2.0", "artistic", r"you may redistribute it and or modify it under the terms of the artistic license 2 0", 95, 0.95),
    ("postgresql", "documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 95, 1.0),
    ("ncsa", "illinois", r"university of illinois ncsa open source license", 95, 1.0),
    ("python-2.0", "python", r"this license agreement is between the python software foundation psf and the individual or organization", 96, 1.0),
    ("ms-pl", "governs", r"this license governs use of the accompanying software if you use the software you accept this license", 70, 0.6),
    ("public-domain", "copyright", r"the authors? disclaims? copyright to this source code", 90, 0.95),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited(?: proprietary and confidential)?", 90, 0.95),
    ("proprietary", "reproduced", r"no part of this (?:publication|document|book|work) may be reproduced stored in a retrieval system or transmitted", 90, 0.9),
    ("no-derivatives", "derivative", r"no derivative works(?: are)? (?:permitted|allowed)", 30, 0.6),
]

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Signature:
    label: str
    keywords: tuple[str, ...]
    name: str
    pattern: re.Pattern
    priority: int
    confidence: float


@lru_cache(maxsize=1)
def signatures() -> tuple[Signature, ...]:
    """The rules in order: every way of saying it for every license, then whole texts."""
    out = [
        Signature(label, tuple(keywords.split(" ")), name, re.compile(rf"(?<= ){around.format(f'(?:{title})')}(?= )"), priority, confidence)
        for name, around, priority, confidence in PHRASINGS
        for label, keywords, title in LICENSES
    ]
    out += [Signature(a, tuple(k.split(" ")), "text", re.compile(rf"(?<= ){p}(?= )"), n, c) for a, k, p, n, c in TEXTS]
    return tuple(sorted(out, key=lambda s: -s.priority))


def places(words: str, phrase: str) -> Iterator[int]:
    """Where a phrase stands in joined words; neighbours may share the space between them."""
    at = words.find(f" {phrase} ")
    while at >= 0:
        yield at
        at = words.find(f" {phrase} ", at + 1)


def joined(text: str) -> str:
    """Words of an already lower-cased text, joined, preceded and followed by single spaces."""
    return f" {_GAP.sub(' ', text).strip(' ')} "


def detections(words: str) -> list[tuple[int, int, Signature]]:
    """Kept (start, end, signature) of all rules over joined words, in order of place."""
    found = [(m.start(), m.end(), s) for s in signatures() if any(f" {k}" in words for k in s.keywords) for m in s.pattern.finditer(words)]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    # Kept detections never overlap, so in order of place only the two neighbours of a new one can.
    kept: list[tuple[int, int, Signature]] = []
    starts: list[int] = []
    for a, b, s in found:
        k = bisect_left(starts, a)
        if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or b <= kept[k][0]):
            starts.insert(k, a)
            kept.insert(k, (a, b, s))
    return kept


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections of every text.

    detections holds (label, rule, first word, words) of each kept detection; score is the highest
    confidence, 1 for a base phrase, 0 without any.
    """
    keywords = sorted({k for s in signatures() for k in s.keywords} | {k for _, k in BASE_KEYWORDS})
    gate = r"(?:^|[\x00-\x2F\x3A-\x60\x7B-\x7F])(?:" + "|".join(keywords) + ")"
    kind = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", kind),
    ])

    def search(text: str) -> tuple:
        words = joined(text)
        more = detections(words)
        base = sorted((at, label) for phrase, label in BASE for at in places(words, phrase))
        spaces = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), "<u4") == 32) if base or more else np.empty(0, np.int64)
        nth = lambda at: int(np.searchsorted(spaces, at))
        own = sorted({label for _, label in base})
        labels = sorted({s.label for _, _, s in more} | set(own))
        score = 1.0 if base else max((s.confidence for _, _, s in more), default=0.0)
        shown = [{"label": s.label, "rule": s.name, "first": nth(a) - 1, "words": nth(b) - nth(a) + 1} for a, b, s in more]
        first, last = (nth(base[0][0]), nth(base[-1][0])) if base else (None, None)
        return len(base), first, last, ",".join(own), ",".join(labels), score, shown

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.batches(stream, BATCH_BYTES):
            texts = common.ascii_lower(common.strings(rows["text"]))
            n_words = pc.count_substring_regex(texts, _WORD).cast(pa.int64())
            hit = np.asarray(pc.match_substring_regex(texts, gate)).astype(bool)
            found = [(0, None, None, "", "", 0.0, [])] * len(texts)
            for k in np.flatnonzero(hit).tolist():
                found[k] = search(texts[k].as_py())
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"].combine_chunks(), n_words, *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:])]], schema=schema
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return common.mapped(rows, run, out + ", detections array<struct<label:string,rule:string,first:bigint,words:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents")).drop("detections")
