"""License scans: ordered signature rules with a keyword prefilter and interval-containment suppression.

Texts are reduced to lower-case words joined by one space; rules are regular expressions over that form.
A rule runs only where all its keywords occur. Where detections overlap, one that lies inside another of
higher priority (or of equal priority and greater length) is suppressed.

Defined results: null and empty texts have no words, no places, empty labels and score 0; repeated rows
are scanned each for itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, words

#: Base phrases and their labels (fixed values of the contract).
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Families: label, name expression, versions. A version's words become the label's suffix.
FAMILIES = (
    ("agpl", r"(?:gnu )?affero general public license|agpl", ("1", "3")),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license|lgpl", ("2", "2 1", "3")),
    ("gpl", r"(?:gnu )?general public license|gnu gpl|gpl", ("1", "2", "3")),
    ("gfdl", r"(?:gnu )?free documentation license|gfdl", ("1 1", "1 2", "1 3")),
    ("apache", r"apache (?:software )?license|apache", ("1 0", "1 1", "2", "2 0")),
    ("mpl", r"mozilla public license|mpl", ("1 0", "1 1", "2 0")),
    ("epl", r"eclipse public license|epl", ("1 0", "2 0")),
    ("cddl", r"common development and distribution license|cddl", ("1 0", "1 1")),
    ("eupl", r"european union public licen[cs]e|eupl", ("1 1", "1 2")),
    ("cecill", r"cecill(?: free software)?(?: license)?", ("1", "2", "2 1")),
    ("osl", r"open software license|osl", ("2 1", "3 0")),
    ("afl", r"academic free license|afl", ("2 1", "3 0")),
    ("artistic", r"artistic license", ("1 0", "2 0")),
    ("boost", r"boost software license|bsl", ("1 0",)),
    ("zlib", r"zlib(?: libpng)? license", ()),
    ("isc", r"isc license", ()),
    ("mit", r"mit license|expat license", ()),
    ("bsd", r"bsd license|bsd style license|berkeley software distribution license", ("2 clause", "3 clause", "4 clause")),
    ("unlicense", r"unlicense", ()),
    ("wtfpl", r"do what the fuck you want to public license|wtfpl", ("1", "2")),
    ("psf", r"python software foundation license|psf license", ("2",)),
    ("openssl", r"openssl license", ()),
    ("ms-pl", r"microsoft public license|ms pl", ()),
    ("ofl", r"(?:sil )?open font license", ("1 0", "1 1")),
    ("cc-by", r"creative commons attribution|cc by", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", r"creative commons attribution share ?alike|cc by sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s|cc by nd", ("3 0", "4 0")),
    ("cc-by-nc", r"creative commons attribution non ?commercial|cc by nc", ("2 0", "3 0", "4 0")),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike|cc by nc sa", ("3 0", "4 0")),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd", ("3 0", "4 0")),
    ("cc0", r"creative commons zero|cc0", ("1 0",)),
    ("odbl", r"open database license|odbl", ("1 0",)),
)

#: Phrases around a name: expression with {n} for name and version, score, priority.
FRAMES = (
    (r"(?:is |are )?licen[cs]ed under (?:the )?(?:terms of the )?{n}", 0.98, 5),
    (r"(?:is |are )?(?:released|distributed|published|provided|available) under (?:the )?(?:terms of the )?{n}", 0.96, 5),
    (r"(?:subject to|governed by|covered by) (?:the )?(?:terms of the )?{n}", 0.93, 5),
    (r"under (?:the )?(?:terms of the )?{n}", 0.9, 4),
    (r"spdx license identifier {n}", 0.99, 6),
    (r"(?:the )?{n}(?: or (?:any )?later(?: version)?)? (?:applies|is included|may be found)", 0.85, 4),
    (r"{n}", 0.6, 2),
)

#: Identifiers as words, and their labels; those of the GNU family are made by rule below.
IDENTIFIERS = (
    ("mit", "mit"), ("mit-0", "mit 0"), ("isc", "isc"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"), ("bsd-0-clause", "0bsd"),
    ("apache-1.1", "apache 1 1"), ("apache-2.0", "apache 2 0"), ("mpl-1.1", "mpl 1 1"), ("mpl-2.0", "mpl 2 0"), ("epl-1.0", "epl 1 0"), ("epl-2.0", "epl 2 0"), ("cddl-1.0", "cddl 1 0"), ("eupl-1.2", "eupl 1 2"),
    ("boost-1.0", "bsl 1 0"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("artistic-2.0", "artistic 2 0"), ("ofl-1.1", "ofl 1 1"), ("ms-pl", "ms pl"), ("openssl", "openssl"), ("psf-2", "psf 2 0"), ("postgresql", "postgresql"),
    ("ncsa", "ncsa"), ("x11", "x11"), ("afl-3.0", "afl 3 0"), ("osl-3.0", "osl 3 0"), ("cecill-2.1", "cecill 2 1"), ("cc0-1.0", "cc0 1 0"), ("odbl-1.0", "odbl 1 0"), ("busl-1.1", "busl 1 1"), ("sspl-1.0", "sspl 1 0"),
    ("cc-by-4.0", "cc by 4 0"), ("cc-by-3.0", "cc by 3 0"), ("cc-by-sa-4.0", "cc by sa 4 0"), ("cc-by-sa-3.0", "cc by sa 3 0"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-nd-4.0", "cc by nd 4 0"), ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"), ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
)
#: GNU licenses and versions; each with no suffix, "only" and "or later", written with a blank, as one word with v, or with a hyphen.
GNU = (("gpl", ("1.0", "2.0", "3.0")), ("lgpl", ("2.0", "2.1", "3.0")), ("agpl", ("1.0", "3.0")))

#: Phrases around an identifier: expression, score, priority, and whether an identifier of one word, or without a figure, will do.
ID_FRAMES = (
    (r"spdx license identifier (?:\S+ (?:and|or|with) )?{n}", 0.99, 8, True),
    (r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{n}(?: licen[cs]e)?", 0.97, 7, True),
    (r"licen[cs]e {n}", 0.9, 6, True),
    (r"{n} licen[cs]ed?", 0.88, 6, True),
    (r"{n}", 0.75, 5, False),
)

#: Texts of licenses and notices that name no license: label, expression, keywords, score, priority.
NOTICES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", ("hereby", "granted", "obtaining"), 0.97, 6),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", ("permission", "distribute", "purpose"), 0.95, 6),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", ("redistribution", "binary", "permitted"), 0.95, 6),
    ("bsd-3-clause", r"neither the name of .{0,80}? nor the names of its contributors", ("neither", "contributors"), 0.95, 6),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event", ("express", "implied", "warranty"), 0.7, 3),
    ("gpl", r"this program is free software you can redistribute it and or modify it", ("program", "redistribute", "modify"), 0.9, 5),
    ("gpl-3.0", r"gnu general public license version 3 29 june 2007", ("gnu", "june", "2007"), 0.98, 8),
    ("gpl-2.0", r"gnu general public license version 2 june 1991", ("gnu", "june", "1991"), 0.98, 8),
    ("gpl", r"free software foundation either version \d(?: \d)? of the license or at your option any later version", ("foundation", "option", "later"), 0.93, 6),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", ("library", "redistribute", "modify"), 0.9, 5),
    ("apache-2.0", r"you may not use this file except in compliance with the license", ("compliance", "except"), 0.9, 6),
    ("apache-2.0", r"apache license version 2 0 january 2004", ("apache", "january", "2004"), 0.98, 8),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla", "source", "form"), 0.98, 8),
    ("boost-1.0", r"boost software license version 1 0 17(?:th)? august 2003|boost software license version 1 0 august 17th 2003", ("boost", "august", "2003"), 0.98, 8),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", ("verbatim", "changing"), 0.95, 6),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered",), 0.98, 8),
    ("cc0", r"to the extent possible under law .{0,80}? has waived all copyright", ("extent", "waived"), 0.95, 6),
    ("zlib", r"altered source versions must be plainly marked as such", ("altered", "plainly"), 0.95, 6),
    ("public-domain", r"(?:released into|dedicated to|placed in) the public domain", ("public", "domain"), 0.9, 5),
    ("all-rights-reserved", r"all rights reserved", ("rights", "reserved"), 0.5, 1),
    ("proprietary", r"(?:confidential and proprietary|unauthorized copying of this file)", ("proprietary",), 0.6, 1),
    ("proprietary", r"unauthorized copying of this file", ("unauthorized", "copying"), 0.6, 1),
)


@dataclass(frozen=True)
class Rule:
    """keywords: alternatives, each a set of words that must all occur."""

    label: str
    pattern: re.Pattern
    keywords: tuple[frozenset[str], ...]
    score: float
    priority: int


def _split(expression: str) -> list[str]:
    """Top-level alternatives of an expression."""
    out, depth = [""], 0
    for ch in expression:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def _plain(expression: str) -> str:
    """An alternative without its groups."""
    while re.search(r"\([^()]*\)", expression):
        expression = re.sub(r"\([^()]*\)\??", " ", expression)
    return expression


def _gnu() -> list[tuple[str, str]]:
    """(label, expression) of the GNU identifiers."""
    out = []
    for name, versions in GNU:
        for version in versions:
            major, minor = version.split(".")
            figures = f"{major} {minor}" if minor != "0" else f"{major}(?: 0)?"
            for suffix in ("", "only", "or later"):
                tail = f" {suffix}" if suffix else ""
                for shown in (f"{name} {figures}{tail}", f"{name}v{figures}{tail}", f"{name} v{figures}{tail}"):
                    out.append((f"{name}-{version}" + ("-" + suffix.replace(" ", "-") if suffix else ""), shown))
    return out


@cache
def rules() -> tuple[Rule, ...]:
    """Every family and version in every frame, then the notices; highest priority first."""
    out = []
    for label, name, versions in FAMILIES:
        for version in ("", *versions):
            suffix = rf"(?: license)?(?: version| v)? ?{version}(?: license)?" if version else "(?: license)?"
            for frame, score, priority in FRAMES:
                shown = name
                if frame == "{n}" and not version:  # a short name alone says nothing
                    shown = "|".join(x for x in _split(name) if " " in x and x not in ("cc by", "ms pl"))
                    if not shown:
                        continue
                keys = tuple(frozenset(re.findall(r"\b[a-z0-9]{2,}\b", re.sub(r"\w*\[\w+\]\w*|\w+ \?\w+", " ", _plain(x)))) for x in _split(shown))
                out.append(
                    Rule(
                        label + ("-" + version.replace(" ", ".").replace(".clause", "-clause") if version else ""),
                        re.compile(r"(?<= )" + frame.format(n=f"(?:{shown}){suffix}") + r"(?= )"),
                        keys,
                        score,
                        priority + bool(version),
                    )
                )
    for label, shown in (*IDENTIFIERS, *_gnu()):
        keys = (frozenset(x for x in re.sub(r"\(.*?\)\??", " ", shown).split() if len(x) > 1 and x.isalnum()),)
        for frame, score, priority, plain in ID_FRAMES:
            if plain or (re.search(r"\d", shown) and (" " in shown or shown.startswith(("gplv", "lgplv", "agplv")))):
                out.append(Rule(label, re.compile(r"(?<= )" + frame.format(n=shown) + r"(?= )"), keys, score, priority))
    out += [Rule(n, re.compile(rf"(?<= ){x}(?= )"), (frozenset(k),), s, p) for n, x, k, s, p in NOTICES]
    return tuple(sorted(out, key=lambda r: -r.priority))


@cache
def _gates() -> tuple[frozenset[str], dict[frozenset[str], list[Rule]]]:
    by_key: dict[frozenset[str], list[Rule]] = {}
    for rule in rules():
        for key in rule.keywords:
            by_key.setdefault(key, []).append(rule)
    return frozenset(w.encode() for key in by_key for w in key), by_key


def detect(found_words: set[bytes], joined: str) -> list[tuple[int, int, Rule]]:
    """Detections that survive suppression, by start; ``joined`` has a space at both ends."""
    _, by_key = _gates()
    have = {w.decode() for w in found_words}
    hits = {(m.start(), m.end(), rule) for key, gated in by_key.items() if key <= have for rule in gated for m in rule.pattern.finditer(joined)}
    return sorted(suppressed(hits), key=lambda h: (h[0], h[1], h[2].label))


def suppressed(hits: Iterable[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Hits that lie inside no other of higher priority, nor of equal priority and greater length; of equal places, the first label.

    A sweep by start for every priority, beside the kept intervals' largest end up to each start: n log n."""
    kept: list[tuple[int, int, Rule]] = []
    by_priority: dict[int, list[tuple[int, int, Rule]]] = {}
    for h in hits:
        by_priority.setdefault(h[2].priority, []).append(h)
    for priority in sorted(by_priority, reverse=True):
        starts = [h[0] for h in kept]
        reach = list(accumulate((h[1] for h in kept), max))
        most = -1
        new = []
        for h in sorted(by_priority[priority], key=lambda h: (h[0], -h[1], h[2].label)):
            k = bisect_right(starts, h[0])
            if h[1] > most and not (k and reach[k - 1] >= h[1]):
                new.append(h)
            most = max(most, h[1])
        kept = sorted(kept + new, key=lambda h: h[0])
    return kept


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand; ``joined`` has a space at both ends."""
    out, at, target = [], 0, b" " + phrase + b" "
    word, since = 0, 0
    while (at := joined.find(target, at)) >= 0:
        word += joined.count(b" ", since, at)
        since = at
        out.append(word)
        at += 1
    return out


SCAN = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<start:int,end:int,label:string,score:double>>"
)


def scan_text(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of one text."""
    w = words(text)
    keywords, _ = _gates()
    joined = b" " + b" ".join(w) + b" "
    base = {label: found for phrase, label in BASE if (found := places(joined, phrase.encode()))}
    at = [x for found in base.values() for x in found]
    here = keywords.intersection(w)
    found = detect(here, joined.decode("utf-8", "replace")) if here else []
    labels = {*base, *(r.label for _, _, r in found)}
    score = max([0.95 if base else 0.0, *(r.score for _, _, r in found)])
    return (
        len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score,
        [{"start": a, "end": b, "label": r.label, "score": r.score} for a, b, r in found],
    )


def scan(docs: DataFrame) -> DataFrame:
    """Per document the base phrases' places, the labels, and all detections in the reduced text."""
    names = [x.split()[0] for x in SCAN.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [scan_text(t) for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0)} | {n: [r[k] for r in rows] for k, n in enumerate(names[1:])}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCAN)
