"""License scans: ordered signature rules, in DataFrame operations only.

A document first passes a keyword prefilter on its text. In those that do, each word
that can begin a rule is an anchor; only the rules filed under that first word are
tried there, as regular expressions over the anchor and the words after it. Every hit
is an interval of words with a label and a priority. A hit goes when another one of
equal or higher priority contains it and is longer, or equally long and earlier in the
order (interval-containment suppression). Base rules are never suppressed. All of it is
one expression per row: no shuffle, and no row is dropped.

Defined results: a null or empty text has no words, no labels and score 0; any length
is scanned whole; repeated rows are each scanned; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import alnum_words

#: The most words a rule may span.
REACH = 32
#: The keyword prefilter: every rule holds at least one of these words, so a text with none of them has no hit.
KEYWORDS = sorted(
    "license licence licensed gpl lgpl agpl gfdl mpl epl cddl cpl eupl osl cecill asl bsd 0bsd wtfpl unlicense spdx cc cc0 "
    "commons psf bsl ofl unencumbered domain reserved confidential copying mit ms "
    "permission permitted redistribution redistributions redistribute warranty warranties copyright proprietary reproduced creativecommons openssl acknowledgement endorse altered disclaims contributor grants anyone package".split()
)


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched at the start of words joined by single spaces; its first word is literal."""

    first: str
    pattern: str
    label: str
    priority: int
    confidence: float
    base: bool = False


def _rule(phrase: str, label: str, priority: int, confidence: float, base: bool = False) -> Rule:
    if not set(re.findall(r"[a-z0-9]+", phrase)) & set(KEYWORDS):
        raise ValueError(f"no keyword leads to the rule {phrase!r}")
    if not re.fullmatch(r"[a-z0-9]+", phrase.split(" ")[0]):
        raise ValueError(f"the first word of {phrase!r} isn't literal")
    return Rule(phrase.split(" ")[0], f"^(?:{phrase})(?= |\\z)", label, priority, confidence, base)


#: Fixed values of the contract: phrase and label.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# The families below spell out rules by hand; versions and grant forms multiply them into some hundreds.
_PERMISSIVE = {
    "mit": ["mit license", "mit licence", "mit expat license", "mit x11 license", "licensed under the mit", "released under the mit"],
    "mit-0": ["mit no attribution", "mit 0 license", "license mit 0"],
    "isc": ["isc license", "isc licence", "licensed under the isc", "license isc"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd license", "simplified bsd license", "freebsd license", "two clause bsd"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd license", "new bsd license", "modified bsd license", "three clause bsd", "revised bsd license"],
    "bsd-4-clause": ["bsd 4 clause", "4 clause bsd license", "original bsd license", "bsd license with advertising"],
    "bsd": ["bsd license", "bsd licence", "bsd style license", "berkeley software distribution license"],
    "0bsd": ["zero clause bsd", "0bsd", "bsd zero clause license"],
    "zlib": ["zlib license", "zlib libpng license", "licensed under the zlib"],
    "libpng": ["libpng license", "png reference library license"],
    "boost": ["boost software license(?: version)?(?: 1 0)?", "licensed under the boost", "bsl 1 0"],
    "unlicense": ["unlicense", "unencumbered software released into the public domain"],
    "wtfpl": ["wtfpl", "what the fuck you want to public license"],
    "public-domain": ["public domain dedication", "released into the public domain", "dedicated to the public domain", "placed in the public domain"],
    "ms-pl": ["microsoft public license", "ms pl"],
    "ms-rl": ["microsoft reciprocal license", "ms rl"],
    "postgresql": ["postgresql license", "postgresql licence"],
    "python": ["python software foundation license", "psf license(?: agreement)?", "python license"],
    "ruby": ["ruby license", "licensed under the ruby license"],
    "php": ["php license(?: version)?(?: \\d)?"],
    "openssl": ["openssl license", "openssl ssleay license"],
    "w3c": ["w3c software license", "w3c software notice and license"],
    "x11": ["x11 license", "x11 licence", "x consortium license"],
    "curl": ["curl license"],
    "ncsa": ["university of illinois open source license", "ncsa open source license", "uiuc license"],
    "artistic": ["artistic license(?: (?:version )?[12](?: 0)?)?", "perl artistic license", "clarified artistic license"],
    "ofl": ["sil open font license(?: version)?(?: 1 [01])?", "open font license", "ofl 1 [01]"],
    "afl": ["academic free license(?: v(?:ersion )?[123](?: \\d)?)?"],
    "ecl": ["educational community license(?: version)?(?: 2 0)?"],
    "upl": ["universal permissive license"],
    "blueoak": ["blue oak model license"],
    "proprietary": ["rights reserved", "proprietary and confidential", "confidential and proprietary", "unauthorized copying", "commercial license", "end user license agreement"],
}
_COPYLEFT = {
    "gpl": ["gnu general public license", "general public license", "gnu gpl", "gpl license", "gnu public license"],
    "lgpl": ["gnu lesser general public license", "lesser general public license", "gnu library general public license", "library general public license", "gnu lgpl", "lgpl license"],
    "agpl": ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl license"],
    "fdl": ["gnu free documentation license", "free documentation license", "gfdl"],
    "mpl": ["mozilla public license", "mpl"],
    "epl": ["eclipse public license", "epl"],
    "cddl": ["common development and distribution license", "cddl"],
    "cpl": ["common public license", "cpl"],
    "eupl": ["european union public license", "eupl"],
    "osl": ["open software license", "osl"],
    "cecill": ["cecill free software license agreement", "cecill"],
    "apache": ["apache license", "apache software license", "licensed under the apache", "apache public license", "asl"],
}
_VERSIONS = {
    "gpl": ["1", "2", "3"], "lgpl": ["2", "2 1", "3"], "agpl": ["1", "3"], "fdl": ["1 1", "1 2", "1 3"],
    "mpl": ["1 0", "1 1", "2 0"], "epl": ["1 0", "2 0"], "cddl": ["1 0", "1 1"], "cpl": ["1 0"],
    "eupl": ["1 0", "1 1", "1 2"], "osl": ["1 0", "2 0", "2 1", "3 0"], "cecill": ["1 0", "2 0", "2 1"],
    "apache": ["1 0", "1 1", "2 0"],
}
_CREATIVE = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
_CREATIVE_NAMES = {
    "by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial",
    "by nd": "attribution no ?deriv(?:ative)?s", "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s",
}


#: Sentences of notices and grants, from a rare word on; ``(?:\\w+ ){a,b}`` stands for names and wordings that vary.
_NOTICES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this (?:software|font|data)",
        "above copyright notice and this permission notice (?:\\w+ ){0,6}shall be included in all copies",
        "copyright notice and this permission notice appear in all copies",
    ],
    "boost": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software"],
    "isc": [
        "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and (?:or )?distribute this software for any purpose without fee is hereby granted",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the (?:above )?copyright notice",
        "redistributions in binary form must reproduce the (?:above )?copyright notice",
    ],
    "bsd-3-clause": [
        "neither the names? of (?:\\w+ ){1,10}nor the names of (?:its|their|any) contributors may be used to endorse or promote",
        "may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission",
    ],
    "bsd-4-clause": ["advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "zlib": [
        "software is provided as is without any express or implied warranty in no event will the authors be held liable",
        "permission is granted to anyone to use this software for any purpose including commercial applications",
        "altered source versions must be plainly marked as such and must not be misrepresented",
    ],
    "unlicense": ["free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"],
    "public-domain": ["has been (?:released|placed|dedicated) (?:in|in to|into|to) the public domain", "disclaims copyright to this source code"],
    "apache-2.0": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance",
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
    ],
    "gpl": [
        "program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        "received a copy of the gnu general public license along with",
    ],
    "lgpl": [
        "library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license",
        "received a copy of the gnu (?:lesser|library) general public license along with",
    ],
    "agpl": ["received a copy of the gnu affero general public license along with", "program is free software you can redistribute it (?:\\w+ ){1,8}gnu affero general public license"],
    "fdl": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"],
    "mpl-2.0": ["source code form is subject to the terms of the mozilla public license v 2 0", "copy of the mpl was not distributed with this file"],
    "mpl-1.1": ["contents of this file are subject to the mozilla public license version 1 1"],
    "epl": ["accompanying materials are made available under the terms of the eclipse public license"],
    "cddl": ["contents of this file are subject to the terms of the common development and distribution license"],
    "ofl": ["font software is licensed under the sil open font license version 1 1"],
    "artistic": ["intent of this document is to state the conditions under which a package may be copied"],
    "python": ["psf hereby grants licensee a nonexclusive royalty free world ?wide license"],
    "openssl": ["product includes software developed by the openssl project"],
    "postgresql": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"],
    "cc0-1.0": ["person who associated a work with this deed has dedicated the work to the public domain", "creativecommons org publicdomain zero 1 0"],
    "proprietary": [
        "part of this (?:publication|document|book|work|software) may be (?:\\w+ ){0,3}reproduced",
        "proprietary (?:and confidential )?information of",
        "redistribution (?:\\w+ ){0,4}(?:is|are) (?:strictly )?(?:prohibited|forbidden|not permitted)",
        "copyright (?:c )?(?:\\d{4} )+(?:\\w+ ){1,8}all rights reserved",
        "licensed not sold",
    ],
    "mit or apache-2.0": [
        "dual licensed under (?:the )?(?:terms of )?(?:the )?mit (?:license )?(?:and|or) (?:the )?apache",
        "licensed under either of (?:the )?apache license version 2 0 (?:\\w+ ){0,8}or (?:the )?mit license",
        "spdx license identifier (?:mit or apache 2 0|apache 2 0 or mit)",
    ],
    "gpl-with-classpath-exception": ["spdx license identifier gpl 2 0 (?:only |or later )?with classpath exception", "gpl version 2 (?:\\w+ ){0,3}with the classpath exception"],
}


def _built() -> list[Rule]:
    rules = [_rule(p, label, 100, 0.9, True) for p, label in BASE]
    # what names several licenses goes before the rules of one
    rules += [_rule(p, label, 96 if re.search(" or |-with-", label) else 92, 0.97) for label, phrases in _NOTICES.items() for p in phrases]
    for v in ("1", "2", "2 1", "3"):
        rules.append(_rule(f"version {v}(?: 0)? of the license or at your option any later version", f"gnu-{v.replace(' ', '.')}-or-later", 70, 0.8))
        rules.append(_rule(f"license as published by the free software foundation (?:either )?version {v}(?: 0)? of the license", f"gnu-{v.replace(' ', '.')}", 65, 0.8))
    for short in _CREATIVE:
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{short.replace(' ', '-')}-{v.replace(' ', '.')}"
            rules.append(_rule(f"creativecommons org licenses {short} {v}", label, 93, 0.99))
            rules.append(_rule(f"licensed under (?:a |the )?creative commons {_CREATIVE_NAMES[short]} {v} (?:international|unported|generic)", label, 94, 0.99))
    for label, phrases in _PERMISSIVE.items():
        rules += [_rule(p, label, 50, 0.85 if " " in p else 0.6) for p in phrases]
        if label not in ("proprietary", "public-domain"):
            rules.append(_rule(f"spdx license identifier {label.replace('-', ' ')}", label, 95, 1.0))
    for label, phrases in _COPYLEFT.items():
        for p in phrases:
            rules.append(_rule(p, label, 50, 0.85 if " " in p else 0.5))
            for v in _VERSIONS[label]:
                number = v if v.endswith(" 0") else f"{v}(?: 0)?"
                tail = f" (?:v(?:ersion)? ?)?{number}"
                rules.append(_rule(f"{p}{tail}", f"{label}-{v.replace(' ', '.')}", 80, 0.95))
                if label in ("gpl", "lgpl", "agpl"):
                    rules.append(_rule(f"{p}{tail} (?:of the license )?or (?:\\w+ ){{0,3}}later(?: version)?", f"{label}-{v.replace(' ', '.')}-or-later", 90, 0.97))
                    rules.append(_rule(f"{p}{tail} only", f"{label}-{v.replace(' ', '.')}-only", 90, 0.97))
        for v in _VERSIONS[label]:
            rules.append(_rule(f"spdx license identifier {label} {v}(?: 0)?", f"{label}-{v.replace(' ', '.')}", 95, 1.0))
    for short in _CREATIVE:
        label = "cc-" + short.replace(" ", "-")
        rules.append(_rule(f"cc {short}", label, 60, 0.8))
        rules.append(_rule(f"creative commons {_CREATIVE_NAMES[short]}", label, 60, 0.9))
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            rules.append(_rule(f"cc {short} {v}", f"{label}-{v.replace(' ', '.')}", 85, 0.97))
            rules.append(_rule(f"creative commons {_CREATIVE_NAMES[short]} {v}", f"{label}-{v.replace(' ', '.')}", 85, 0.97))
    rules += [_rule("cc0", "cc0-1.0", 60, 0.8), _rule("cc0 1 0", "cc0-1.0", 85, 0.97), _rule("creative commons zero", "cc0-1.0", 60, 0.9)]
    return rules


RULES = _built()
def _rules_by_first(rules: list[Rule]) -> Column:
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r.first, []).append(r)
    plain = {k: [{x: getattr(r, x) for x in ("pattern", "label", "priority", "confidence", "base")} for r in own] for k, own in by.items()}
    kind = "map<string,array<struct<pattern:string,label:string,priority:int,confidence:double,base:boolean>>>"
    return F.from_json(F.lit(json.dumps(plain)), kind)  # a literal: folded once, when the plan is optimised


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: id, n_words, base_hits, hits (both arrays of s, e, label, priority, confidence), score."""
    rules = RULES if rules is None else rules
    table = _rules_by_first(rules)
    firsts = F.array(*[F.lit(x) for x in sorted({r.first for r in rules})])
    words = alnum_words(F.col(text_col))
    sized = docs.select(F.col(id_col), words.alias("_w"))
    gated = F.arrays_overlap("_w", F.array(*[F.lit(x) for x in KEYWORDS]))
    anchors = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.array_contains(firsts, F.get("_w", i)))
    anchored = sized.withColumn("_at", F.when((F.size("_w") > 0) & gated, anchors))
    hits = F.transform(
        F.transform("_at", lambda i: F.struct(i.alias("s"), F.array_join(F.slice("_w", i + 1, REACH), " ").alias("ctx"), F.get("_w", i).alias("first"))),
        lambda a: F.transform(
            F.filter(F.element_at(table, a["first"]), lambda r: F.regexp_like(a["ctx"], r["pattern"])),
            lambda r: F.struct(
                a["s"].alias("s"),
                (a["s"] + F.size(F.split(F.regexp_substr(a["ctx"], r["pattern"]), " "))).alias("e"),
                r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), r["base"].alias("base"),
            ),
        ),
    )
    nonempty = F.filter(hits, lambda h: F.size(h) > 0)
    found = anchored.withColumn("_hits", F.coalesce(nonempty, F.array().cast("array<array<struct<s:int,e:int,label:string,priority:int,confidence:double,base:boolean>>>")))

    def beaten(d: Column, k: Column) -> Column:
        """By a hit that starts at one of the REACH anchors before it, or at its own."""
        near = F.flatten(F.slice("_hits", F.greatest(k - (REACH - 1), F.lit(0)) + 1, F.least(k + 1, F.lit(REACH))))
        length = lambda x: x["e"] - x["s"]
        return F.exists(
            near,
            lambda o: (o["s"] <= d["s"])
            & (o["e"] >= d["e"])
            & (o["priority"] >= d["priority"])
            & ((length(o) > length(d)) | ((length(o) == length(d)) & ((o["priority"] > d["priority"]) | (o["label"] < d["label"])))),
        )

    kept = F.flatten(F.transform("_hits", lambda own, k: F.filter(own, lambda d: ~d["base"] & ~beaten(d, k))))
    out = found.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.filter(F.flatten("_hits"), lambda d: d["base"]).alias("base_hits"),
        kept.alias("hits"),
    )
    doubt = F.aggregate(F.concat("base_hits", "hits"), F.lit(1.0), lambda a, d: a * (1.0 - d["confidence"] * 0.5))
    return out.withColumn("score", F.round(1.0 - doubt, 6))
