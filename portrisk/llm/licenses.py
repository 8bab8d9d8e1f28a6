"""License scan: ordered signature rules behind a keyword test, overlaps settled by priority.

Native: DataFrame functions only, one pass, no shuffle; every text is judged in its own row, whole.
A text with no keyword costs one word count. Other texts become a string of lower-case words with
single spaces. Of the rules, only those whose keywords occur run; marks put around a rule's matches give
all intervals, word by word. A detection goes when another one of the same or a higher priority
contains its interval (equal ones: the rule that comes first stays).

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case. Base phrases are rules too,
and never suppressed in the base columns.

Edge cases: a null or empty text gives no words, zero counts, empty strings and null places; rows
with equal ids stay separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import let

#: What stands between words, before letters become lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Priorities: a full text beats a notice, a notice a tag or address, these a mere mention.
FULL, NOTICE, TAG, MENTION = 4, 3, 2, 1

#: Label; ways to name it, as regexes over words; identifier in tags; address words.
FAMILIES: tuple[tuple[str, str, str, str], ...] = (
    ("mit", r"mit|expat|mit x11", "mit", "opensource org licenses mit"),
    ("apache-2", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version)? 1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("bsd-2", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4", r"(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd 4 clause", "directory fsf org wiki license bsd 4clause"),
    ("gpl-2", r"(?:gnu )?(?:gpl|general public license)(?: version)? v?2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses(?: old licenses)? gpl 2 0"),
    ("gpl-3", r"(?:gnu )?(?:gpl|general public license)(?: version)? v?3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version)? v?2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses(?: old licenses)? lgpl 2 1"),
    ("lgpl-3", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version)? v?3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("agpl-3", r"(?:gnu )?(?:agpl|affero general public license)(?: version)? v?3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("gfdl-1.3", r"(?:gnu )?(?:gfdl|free documentation license)(?: version)? 1 3", "gfdl 1 3", "gnu org licenses fdl 1 3"),
    ("mpl-1.1", r"(?:mpl|mozilla public license)(?: version)? 1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2", r"(?:mpl|mozilla public license)(?: version)? 2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1", r"(?:epl|eclipse public license)(?: version)? v?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2", r"(?:epl|eclipse public license)(?: version)? v?2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl-1", r"(?:cddl|common development and distribution license)(?: version)? 1(?: 0)?", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("isc", r"isc", "isc", "opensource org licenses isc"),
    ("zlib", r"zlib(?: libpng)?", "zlib", "opensource org licenses zlib"),
    ("bsl-1", r"boost software(?: license)?(?: version)? 1(?: 0)?", "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", r"business source license(?: version)? 1 1", "busl 1 1", "mariadb com bsl11"),
    ("unlicense", r"unlicense", "unlicense", "unlicense org"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public license)", "wtfpl", "wtfpl net"),
    ("artistic-2", r"artistic(?: license)?(?: version)? 2(?: 0)?", "artistic 2 0", "opensource org licenses artistic 2 0"),
    ("python-2", r"(?:psf|python software foundation)(?: license)?(?: version)? 2", "psf 2 0", "docs python org 3 license"),
    ("postgresql", r"postgresql", "postgresql", "opensource org licenses postgresql"),
    ("openssl", r"openssl", "openssl", "openssl org source license"),
    ("ofl-1.1", r"(?:sil )?open font license(?: version)? 1 1", "ofl 1 1", "scripts sil org ofl"),
    ("odbl-1", r"(?:odbl|open database license)(?: version)? v?1(?: 0)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1", r"open data commons attribution(?: license)?", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1", r"public domain dedication and license", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("ms-pl", r"(?:ms pl|microsoft public license)", "ms pl", "opensource org licenses ms pl"),
    ("eupl-1.2", r"(?:eupl|european union public license)(?: v)? ?1 2", "eupl 1 2", "joinup ec europa eu collection eupl"),
    ("cecill-2.1", r"cecill(?: version)? 2 1", "cecill 2 1", "cecill info licences"),
    ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", "0bsd", "opensource org licenses 0bsd"),
    ("afl-3", r"academic free license(?: version)? v?3(?: 0)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("osl-3", r"open software license(?: version)? v?3(?: 0)?", "osl 3 0", "opensource org licenses osl 3 0"),
    ("cc0-1", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", "cc by nc sa [1-4] 0", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?)(?: [1-4] [05])?", "cc by nc nd [1-4] 0", "creativecommons org licenses by nc nd"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", "cc by nc [1-4] 0", "creativecommons org licenses by nc"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", "cc by sa [1-4] 0", "creativecommons org licenses by sa"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s(?: works)?)(?: [1-4] [05])?", "cc by nd [1-4] 0", "creativecommons org licenses by nd"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: [1-4] [05])?", "cc by [1-4] 0", "creativecommons org licenses by"),
    ("openrail", r"(?:open ?rail(?: m)?|bigscience rail)", "bigscience openrail m", "licenses ai"),
    ("json", r"json", "json", "json org license"),
)

#: Sentences of license texts and notices that name no license by themselves.
SENTENCES: tuple[tuple[str, str, int], ...] = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", FULL),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", FULL),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", FULL),
    ("bsd-3", r"neither the name of .{1,80} nor the names of its contributors", FULL),
    ("bsd-4", r"all advertising materials mentioning features or use of this software", FULL),
    ("apache-2", r"you may not use this file except in compliance with the license", FULL),
    ("gpl", r"this program is free software you can redistribute it and or modify", FULL),
    ("gpl", r"free software foundation either version [0-9] of the license", FULL),
    ("lgpl", r"this library is free software you can redistribute it and or modify", FULL),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event", FULL),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license", FULL),
    ("unlicense", r"this is free and unencumbered software released into the public domain", FULL),
    ("bsl-1", r"permission is hereby granted free of charge to any person or organization obtaining", FULL),
    ("cc0-1", r"to the extent possible under law .{1,120} waived all copyright", FULL),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", NOTICE),
    ("public-domain", r"this work is in the public domain", NOTICE),
    ("all-rights-reserved", r"all rights reserved", MENTION),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", NOTICE),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|distribution)", NOTICE),
    ("non-commercial", r"for non ?commercial use only", NOTICE),
    ("research-only", r"for research (?:purposes|use) only", NOTICE),
    ("no-derivatives", r"no derivative works", MENTION),
    ("terms-of-use", r"subject to (?:the|our) terms of (?:use|service)", MENTION),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", FULL),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to", FULL),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", FULL),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", FULL),
    ("bsd", r"redistributions of source code must retain the above copyright notice", FULL),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", FULL),
    ("bsd-4", r"this product includes software developed by .{1,80} contributors", NOTICE),
    ("bsd-clear", r"no express or implied licenses to any party s patent rights are granted by this license", FULL),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license", FULL),
    ("apache-2", r"licensed to the apache software foundation asf under one or more contributor license agreements", FULL),
    ("apache-2", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants", FULL),
    ("apache-1.1", r"the names .{1,60} must not be used to endorse or promote products derived from this software without prior written permission", FULL),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document", FULL),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program", FULL),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", FULL),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", FULL),
    ("lgpl", r"this version of the gnu lesser general public license incorporates the terms and conditions", FULL),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with", FULL),
    ("agpl", r"remote network interaction use with the gnu general public license", FULL),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", FULL),
    ("gpl-classpath", r"linking this library statically or dynamically with other modules is making a combined work .{1,160} general public license", FULL),
    ("mpl-2", r"if a copy of the mpl was not distributed with this file you can obtain one at .{0,40}mozilla org", FULL),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", FULL),
    ("mpl-2", r"incompatible with secondary licenses as defined by the mozilla public license", NOTICE),
    ("epl-1", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", FULL),
    ("epl-2", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0", FULL),
    ("cddl-1", r"the contents of this file are subject to the terms of the common development and distribution license", FULL),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone", FULL),
    ("bsl-1", r"boost software license version 1 0 august 17th 2003", FULL),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software .{0,200}copyright", FULL),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", FULL),
    ("artistic-2", r"the artistic license 2 0 copyright c 2000 2006 the perl foundation", FULL),
    ("artistic-1", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder", FULL),
    ("python-2", r"this license agreement is between the python software foundation psf and the individual or organization", FULL),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", FULL),
    ("openssl", r"redistributions of any form whatsoever must retain the following acknowledgment .{0,80}openssl", FULL),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", FULL),
    ("ofl-1.1", r"neither the font software nor any of its individual components .{1,80} may be sold by itself .{0,200}copyright", FULL),
    ("odbl-1", r"this database is made available under the open database license", FULL),
    ("odbl-1", r"any rights in individual contents of the database are licensed under the database contents license", FULL),
    ("odc-by-1", r"made available under the open data commons attribution license", FULL),
    ("pddl-1", r"made available under the public domain dedication and license", FULL),
    ("ms-pl", r"if you use the software you accept this license if you do not accept the license do not use the software", FULL),
    ("eupl-1.2", r"licensed under the eupl version 1 2 or as soon they will be approved by the european commission", FULL),
    ("cecill-2.1", r"this software is governed by the cecill license under french law", FULL),
    ("afl-3", r"licensed under the academic free license version 3 0", FULL),
    ("osl-3", r"licensed under the open software license version 3 0", FULL),
    ("cc0-1", r"the person who associated a work with this deed has dedicated the work to the public domain", FULL),
    ("cc-by-sa", r"text is available under the creative commons attribution share ?alike license", FULL),
    ("cc-by", r"this is an open access article distributed under the terms of the creative commons attribution license", FULL),
    ("cc-by-nc", r"this is an open access article distributed under the terms of the creative commons attribution non ?commercial license", FULL),
    ("cc-by", r"this work is licensed under a creative commons attribution (?:[1-4] [05] )?international license", FULL),
    ("busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", FULL),
    ("elastic-2", r"you may not provide the software to third parties as a hosted or managed service .{0,200}licen[cs]e", FULL),
    ("elastic-2", r"elastic license (?:version )?2 0", NOTICE),
    ("sspl-1", r"server side public license", NOTICE),
    ("commons-clause", r"the license does not grant to you the right to sell the software", FULL),
    ("polyform-nc", r"polyform noncommercial license", NOTICE),
    ("openrail", r"you agree not to use the model or derivatives of the model .{0,200}licen[cs]e", FULL),
    ("llama", r"llama [23](?: [0-9])? community license agreement", FULL),
    ("gemma", r"gemma terms of use", NOTICE),
    ("non-commercial", r"(?:may not|must not|cannot) be used for commercial purposes .{0,80}licen[cs]e", NOTICE),
    ("non-commercial", r"free for (?:personal|academic|educational) use .{0,60}licen[cs]e", NOTICE),
    ("no-redistribution", r"redistribution .{0,60}(?:is|are) (?:strictly )?prohibited", NOTICE),
    ("no-redistribution", r"no part of this (?:publication|book|work|document) may be reproduced .{0,200}permission", FULL),
    ("reprint", r"reprinted (?:here )?(?:with|by) permission", NOTICE),
    ("open-government-3", r"contains public sector information licensed under the open government licence v3 0", FULL),
    ("us-government", r"works? of the (?:united states|u s|us) government .{0,80}copyright", NOTICE),
    ("proprietary", r"this software is the confidential and proprietary information of", FULL),
    ("no-training", r"(?:may not|must not|shall not) be used (?:to train|for training|in the training of) .{0,120}permission", NOTICE),
)


FOUND = "array<struct<n:int,p:int,label:string,a:int,b:int>>"
KEPT = "array<struct<label:string,p:int,a:int,b:int>>"
#: Marks around a match; no word has these characters.
BEGIN, END = "\x01", "\x02"
#: Detections that are judged at a time.
RUN = 512


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    hints: tuple[str, ...] = ()


#: Of these, every rule needs one. In a raw text, the first word that tells stands for a pair.
SINGLE = ("licen", "spdx", "creativecommons", "opendatacommons", "cc0", "redistribution", "permission", "proprietary", "unauthori", "research",
          "contributors", "mozilla", "mariadb", "wtfpl", "scripts sil", "eclipse", "joinup", "cecill", "warranty", "copyright")
PAIRS = {"public domain": "domain", "free software": "software", "rights reserved": "reserved", "commercial use": "commercial", "derivative works": "derivative",
         "terms of": "terms", "released under": "released", "distributed under": "distributed", "available under": "available",
         "advertising materials": "advertising", "cc by": "cc"}
CC_BY = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"

#: Of these by label, the rules of a family need one more.
HINTS = {
    "mit": "mit expat", "apache": "apache", "bsd": "bsd", "gpl": "gpl general", "lgpl": "lgpl lesser", "agpl": "agpl affero", "gfdl": "gfdl documentation fdl",
    "mpl": "mpl mozilla", "epl": "epl eclipse", "cddl": "cddl distribution", "isc": "isc", "zlib": "zlib", "bsl": "boost bsl", "busl": "business busl mariadb",
    "unlicense": "unlicense", "wtfpl": "wtfpl fuck", "artistic": "artistic", "python": "psf python", "postgresql": "postgresql", "openssl": "openssl",
    "ofl": "font ofl", "odbl": "odbl database", "odc": "odc opendatacommons commons", "pddl": "pddl dedication", "ms": "ms microsoft", "eupl": "eupl european",
    "cecill": "cecill", "0bsd": "bsd", "afl": "afl academic", "osl": "osl open", "cc0": "cc0 zero", "cc": "cc creative", "openrail": "rail licenses", "json": "json",
}


def _keyword(pattern: str) -> str:
    return next(k for k in (*SINGLE, *PAIRS) if k in pattern)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules by order: base phrases, sentences, then six forms of each family."""
    out = [Rule(label, "licen" if "license" in phrase else "cc by", phrase, NOTICE) for phrase, label in BASE.items()]
    out += [Rule(label, _keyword(p), p, priority) for label, p, priority in SENTENCES]
    for label, name, tag, address in FAMILIES:
        hints = tuple(HINTS[label.split("-")[0]].split())
        out += [
            Rule(label, "licen", rf"licensed under (?:the |a )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?", NOTICE, hints),
            Rule(label, "released under", rf"released under (?:the |a )?(?:terms of the )?(?:{name})(?: licen[cs]e)?", NOTICE, hints),
            Rule(label, "distributed under", rf"distributed under (?:the |a )?(?:terms of the )?(?:{name})(?: licen[cs]e)?", NOTICE, hints),
            Rule(label, "available under", rf"available under (?:the |a )?(?:terms of the )?(?:{name})(?: licen[cs]e)?", NOTICE, hints),
            Rule(label, "spdx", rf"spdx license identifier {tag}", TAG, hints),
            Rule(label, _keyword(address), rf"(?:https? )?(?:www )?{address}", TAG, hints),
            Rule(label, "licen", rf"(?:{name}) licen[cs]e", MENTION, hints),
        ]
        if "licen" in name:
            out.append(Rule(label, "licen", name, MENTION, hints))
    out += [Rule(label, "cc by", tag, MENTION, ("cc",)) for label, _, tag, _ in FAMILIES if tag.startswith("cc by")]
    return tuple(out)


def _literal(rows: tuple[Rule, ...]) -> Column:
    """The rules as one constant: number, priority, label, keyword, hints, pattern by whole words."""
    own = [{"n": n, "p": r.priority, "label": r.label, "keyword": r.keyword, "hints": r.hints, "pattern": rf"(?<![^ ])(?:{r.pattern})(?![^ ])"} for n, r in enumerate(rows)]
    return F.from_json(F.lit(json.dumps(own)), "array<struct<n:int,p:int,label:string,keyword:string,hints:array<string>,pattern:string>>")


def _places(text: Column, rule: Column) -> Column:
    """First and last word of each match of a rule: the text with its matches between marks, word by word."""
    def at(words: Column, mark: Callable[[Column], Column]) -> Column:
        return F.array_compact(F.transform(words, lambda w, i: F.when(mark(w), i)))

    def intervals(words: Column) -> Column:
        ends = at(words, lambda w: F.endswith(w, F.lit(END)))
        return let(ends, lambda end: F.transform(at(words, lambda w: F.startswith(w, F.lit(BEGIN))), lambda a, k: F.struct(
            rule["n"].alias("n"), rule["p"].alias("p"), rule["label"].alias("label"), a.alias("a"), F.get(end, k).alias("b"))))

    none = F.array().cast(FOUND)
    return let(F.regexp_replace(text, rule["pattern"], F.lit(f"{BEGIN}$0{END}")), lambda marked: F.when(marked == text, none).otherwise(
        let(F.split(marked, " ", -1), intervals)).cast(FOUND))


def _detections(text: Column, table: Column) -> Column:
    """All detections of a text, before suppression."""
    possible = F.filter(table, lambda r: F.contains(text, r["keyword"]) & ((F.size(r["hints"]) == 0) | F.exists(r["hints"], lambda h: F.contains(text, h))))
    return F.flatten(F.transform(possible, lambda r: _places(text, r)))


def _kept(found: Column) -> Column:
    """Detections that no other contains: one pass in order of start keeps the farthest end by priority."""
    order = F.array_sort(F.transform(found, lambda d: F.struct(
        d["a"].alias("a"), (-d["b"]).alias("minus_b"), (-d["p"]).alias("minus_p"), d["n"].alias("n"), d["b"].alias("b"), d["p"].alias("p"), d["label"].alias("label"))))
    levels = range(1, FULL + 1)
    ends = [f"e{p}" for p in levels]

    def step(acc: Column, d: Column) -> Column:
        reach = F.element_at(F.array(*[acc[e] for e in ends]), d["p"])
        keep = F.array(F.struct(d["label"].alias("label"), d["p"].alias("p"), d["a"].alias("a"), d["b"].alias("b")))
        return F.struct(
            *[F.when(d["p"] >= p, F.greatest(acc[e], d["b"])).otherwise(acc[e]).alias(e) for p, e in zip(levels, ends, strict=True)],
            F.when(reach >= d["b"], acc["all"]).otherwise(F.concat(acc["all"], keep)).alias("all"))

    # Arrays grow by copies, so a run of detections gets an array of its own.
    def run(order: Column, acc: Column, k: Column) -> Column:
        own = F.struct(*[acc[e].alias(e) for e in ends], F.array().cast(KEPT).alias("all"))
        return let(F.aggregate(F.slice(order, k * RUN + 1, F.lit(RUN)), own, step), lambda part: F.struct(
            *[part[e].alias(e) for e in ends], F.concat(acc["runs"], F.array(part["all"])).alias("runs")))

    start = F.struct(*[F.lit(-1).alias(e) for e in ends], F.array().cast(f"array<{KEPT}>").alias("runs"))
    return let(order, lambda order: F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(order) - 1) / RUN).cast("int")), start, lambda acc, k: run(order, acc, k), lambda acc: F.flatten(acc["runs"])))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, base places, labels and score, and the kept detections with their word intervals.

    score: 1 minus the product of 1 - w over kept detections by label, w by priority (0.5, 0.8, 0.9, 0.97).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, BETWEEN), "")
    lower = F.col("lower")
    gate = F.contains(lower, F.lit("cc")) & lower.rlike(CC_BY)
    for key in (*(k.split()[0] for k in SINGLE), *(w for w in PAIRS.values() if w != "cc")):
        gate = gate | F.contains(lower, F.lit(key))
    none = F.array().cast(FOUND)
    table = _literal(rules())
    n_base_rules = len(BASE)
    # A-Z only: other capital letters stay as they are.
    joined = F.when(F.col("gate"), F.translate(F.array_join("words", " "), string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lit(""))
    found = (
        docs.select(F.col(id_col).alias("doc_id"), words.alias("words"), F.lower(text).alias("lower"))
        .select("doc_id", "words", gate.alias("gate"))
        .select("doc_id", F.size("words").cast("long").alias("n_words"), joined.alias("joined"))
        .select("doc_id", "n_words", F.when(F.col("joined") == "", none).otherwise(_detections(F.col("joined"), table)).alias("found"))
    )
    base = F.filter("found", lambda d: d["n"] < n_base_rules)
    judged = found.select("doc_id", "n_words", base.alias("base"), F.when(F.size("found") == 0, F.array().cast(KEPT))
                          .otherwise(_kept(F.col("found"))).alias("detections"))
    label_set = lambda *sets: F.array_join(F.array_sort(F.array_distinct(F.concat(*sets))), ",")
    weight = lambda d: F.element_at(F.array(*[F.lit(w) for w in (0.5, 0.8, 0.9, 0.97)]), d["p"])
    return judged.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["a"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["a"])).cast("long").alias("last_word"),
        label_set(F.transform("base", lambda d: d["label"])).alias("base_labels"),
        label_set(F.transform("base", lambda d: d["label"]), F.transform("detections", lambda d: d["label"])).alias("labels"),
        F.round(1 - F.aggregate("detections", F.lit(1.0), lambda acc, d: acc * (1 - weight(d))), 6).alias("score"),
        "detections",
    )
