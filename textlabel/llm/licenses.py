"""License detection: ordered signature rules behind a keyword prefilter; overlaps settled by priority and containment."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textlabel.llm.names import column

# Bytes of words: ASCII digits and letters, A-Z in lower case, and everything beyond ASCII. All others part words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SPDX, GRANT, TEXT, LINK, NAME = range(5)  # priorities, strongest first
CONFIDENCE = {SPDX: 0.99, GRANT: 0.95, TEXT: 0.9, LINK: 0.85, NAME: 0.6}
_UNDER = r"(?:licen[sc]ed|released|distributed|published|provided|available|covered|shared|offered) (?:to you )?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
_TAG = r"spdx licen[sc]e identifier (?:\w+ (?:or|and) )?"

# Fixed values. label | keyword that any text of it holds | its names | its SPDX ids | its pages. All patterns meet
# words in lower case with one blank between them, so "GPL-3.0" reads "gpl 3 0".
FAMILIES = r"""
mit|mit|(?:mit|expat)(?: x11)? licen[sc]e|mit|opensource org licen[sc]es mit
mit-0|mit|mit (?:no attribution|0)(?: licen[sc]e)?|mit 0|opensource org licen[sc]es mit 0
apache-1.1|apache|apache (?:software )?licen[sc]e (?:version |v )?1 1|apache 1 1|apache org licen[sc]es licen[sc]e 1 1
apache-2|apache|apache(?: software)?(?: licen[sc]e)? (?:version |v ?)?2(?: 0)?(?: licen[sc]e)?|apache 2(?: 0)?|apache org licen[sc]es licen[sc]e 2 0
gpl-1|general public|gnu general public licen[sc]e (?:version |v ?)1(?: 0)?|gpl 1 0(?: only| or later)?|gnu org licen[sc]es (?:old licen[sc]es )?gpl 1 0
gpl-2|general public|gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2(?: 0)?|gpl 2 0(?: only| or later)?|gnu org licen[sc]es (?:old licen[sc]es )?gpl 2 0
gpl-3|general public|gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?|gpl 3 0(?: only| or later)?|gnu org licen[sc]es gpl 3 0
gpl-2|gpl|gplv2|gpl v2|gnu org licen[sc]es gpl2
gpl-3|gpl|gplv3|gpl v3|gnu org licen[sc]es gplv3
lgpl-2|lesser|gnu (?:library|lesser) general public licen[sc]e (?:version |v ?)2(?: 0)?|lgpl 2 0(?: only| or later)?|gnu org licen[sc]es (?:old licen[sc]es )?lgpl 2 0
lgpl-2.1|lesser|gnu lesser general public licen[sc]e (?:version |v ?)2 1|lgpl 2 1(?: only| or later)?|gnu org licen[sc]es (?:old licen[sc]es )?lgpl 2 1
lgpl-3|lesser|gnu lesser general public licen[sc]e (?:version |v ?)3(?: 0)?|lgpl 3 0(?: only| or later)?|gnu org licen[sc]es lgpl 3 0
agpl-3|affero|gnu affero general public licen[sc]e(?: (?:version |v ?)3(?: 0)?)?|agpl 3 0(?: only| or later)?|gnu org licen[sc]es agpl 3 0
gfdl-1.1|documentation|gnu free documentation licen[sc]e (?:version )?1 1|gfdl 1 1|gnu org licen[sc]es (?:old licen[sc]es )?fdl 1 1
gfdl-1.2|documentation|gnu free documentation licen[sc]e (?:version )?1 2|gfdl 1 2|gnu org licen[sc]es (?:old licen[sc]es )?fdl 1 2
gfdl-1.3|documentation|gnu free documentation licen[sc]e (?:version )?1 3|gfdl 1 3|gnu org licen[sc]es fdl 1 3
bsd-2-clause|bsd|(?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e|bsd 2 clause|opensource org licen[sc]es bsd 2 clause
bsd-3-clause|bsd|(?:new|revised|modified|3 clause|three clause) bsd licen[sc]e|bsd 3 clause|opensource org licen[sc]es bsd 3 clause
bsd-4-clause|bsd|(?:original|4 clause|four clause) bsd licen[sc]e|bsd 4 clause|spdx org licen[sc]es bsd 4 clause
0bsd|bsd|(?:zero clause|0 clause) bsd licen[sc]e|0bsd|opensource org licen[sc]es 0bsd
isc|isc|isc licen[sc]e|isc|opensource org licen[sc]es isc
mpl-1.1|mozilla|mozilla public licen[sc]e (?:version |v ?)?1 1|mpl 1 1|mozilla org mpl 1 1
mpl-2|mozilla|mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?|mpl 2 0|mozilla org mpl 2 0
epl-1|eclipse|eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?|epl 1 0|eclipse org legal epl v10
epl-2|eclipse|eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?|epl 2 0|eclipse org legal epl 2 0
edl-1|eclipse|eclipse distribution licen[sc]e (?:version |v ?)?1(?: 0)?|edl 1 0|eclipse org org documents edl v10
cddl-1|development and distribution|common development and distribution licen[sc]e(?: (?:version |v ?)?1 0)?|cddl 1 0|opensource org licen[sc]es cddl 1 0
cddl-1.1|development and distribution|common development and distribution licen[sc]e (?:version |v ?)?1 1|cddl 1 1|glassfish java net public cddl
cpl-1|common public|common public licen[sc]e(?: (?:version |v ?)?1 0)?|cpl 1 0|opensource org licen[sc]es cpl1 0
cpal-1|attribution|common public attribution licen[sc]e(?: (?:version |v ?)?1 0)?|cpal 1 0|opensource org licen[sc]es cpal 1 0
eupl-1.1|european union|european union public licen[sc]e (?:version |v ?)?1 1|eupl 1 1|joinup ec europa eu software page eupl
eupl-1.2|european union|european union public licen[sc]e (?:version |v ?)?1 2|eupl 1 2|joinup ec europa eu collection eupl
artistic-1|artistic|(?:perl )?artistic licen[sc]e (?:version )?1(?: 0)?|artistic 1 0|opensource org licen[sc]es artistic 1 0
artistic-2|artistic|(?:perl )?artistic licen[sc]e (?:version )?2(?: 0)?|artistic 2 0|opensource org licen[sc]es artistic 2 0
bsl-1|boost|boost software licen[sc]e(?: (?:version )?1 0)?|bsl 1 0|boost org licen[sc]e 1 0
zlib|zlib|zlib(?: libpng)? licen[sc]e|zlib|zlib net zlib licen[sc]e
libpng|libpng|libpng licen[sc]e|libpng(?: 2 0)?|libpng org pub png src libpng licen[sc]e
unlicense|unlicense|the unlicense|unlicense|unlicense org
wtfpl|public licen|do what the \w+ you want to public licen[sc]e|wtfpl|wtfpl net
ms-pl|microsoft public|microsoft public licen[sc]e|ms pl|opensource org licen[sc]es ms pl
ms-rl|microsoft reciprocal|microsoft reciprocal licen[sc]e|ms rl|opensource org licen[sc]es ms rl
afl-3|academic|academic free licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?|afl 3 0|opensource org licen[sc]es afl 3 0
osl-3|open software|open software licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?|osl 3 0|opensource org licen[sc]es osl 3 0
ecl-2|educational|educational community licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?|ecl 2 0|opensource org licen[sc]es ecl 2 0
ncsa|ncsa|(?:university of illinois )?ncsa (?:open source )?licen[sc]e|ncsa|opensource org licen[sc]es ncsa
postgresql|postgresql|postgresql licen[sc]e|postgresql|opensource org licen[sc]es postgresql
psf-2|python|python software foundation licen[sc]e(?: (?:version )?2)?|psf 2 0|docs python org 3 licen[sc]e
ruby|ruby|ruby licen[sc]e|ruby|ruby lang org en about licen[sc]e
php-3|php|php licen[sc]e (?:version )?3 01?|php 3 01?|php net licen[sc]e 3 01
openssl|openssl|openssl licen[sc]e|openssl|openssl org source licen[sc]e
w3c|w3c|w3c software (?:notice and )?licen[sc]e|w3c(?: 20150513)?|w3 org consortium legal
x11|x11|x11 licen[sc]e|x11|xfree86 org 3 3 6 copyright2
ofl-1.1|open font|sil open font licen[sc]e(?: (?:version )?1 1)?|ofl 1 1|scripts sil org ofl
odbl-1|database|open (?:data commons (?:open )?)?database licen[sc]e(?: (?:odbl )?(?:v ?)?1 0)?|odbl 1 0|opendatacommons org licen[sc]es odbl
odc-by-1|attribution|open data commons attribution licen[sc]e(?: (?:v ?)?1 0)?|odc by 1 0|opendatacommons org licen[sc]es by
pddl-1|public domain|(?:open data commons )?public domain dedication and licen[sc]e(?: (?:v ?)?1 0)?|pddl 1 0|opendatacommons org licen[sc]es pddl
cc0|cc0|cc0(?: 1 0)?(?: universal)?|cc0 1 0|creativecommons org publicdomain zero
cc-pdm|public domain mark|public domain mark(?: 1 0)?|cc pdm 1 0|creativecommons org publicdomain mark
cc-by|cc by|cc by(?: [1-4] [05])?(?! n[cd]| sa)|cc by [1-4] [05]|creativecommons org licen[sc]es by(?! n[cd]| sa)
cc-by-sa|cc by sa|cc by sa(?: [1-4] [05])?|cc by sa [1-4] [05]|creativecommons org licen[sc]es by sa
cc-by-nd|cc by nd|cc by nd(?: [1-4] [05])?|cc by nd [1-4] [05]|creativecommons org licen[sc]es by nd
cc-by-nc|cc by nc|cc by nc(?: [1-4] [05])?(?! (?:nd|sa)\b)|cc by nc [1-4] [05]|creativecommons org licen[sc]es by nc(?! nd| sa)
cc-by-nc-sa|cc by nc sa|cc by nc sa(?: [1-4] [05])?|cc by nc sa [1-4] [05]|creativecommons org licen[sc]es by nc sa
cc-by-nc-nd|cc by nc nd|cc by nc nd(?: [1-4] [05])?|cc by nc nd [1-4] [05]|creativecommons org licen[sc]es by nc nd
cc-by|creative commons|creative commons attribution(?: [1-4] [05])?(?: international| unported)? licen[sc]e|cc by|creativecommons org licen[sc]es by [1-4]
cc-by-sa|creative commons|creative commons attribution share ?alike(?: [1-4] [05])?|cc by sa|creativecommons org licen[sc]es by sa [1-4]
cc-by-nd|creative commons|creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?|cc by nd|creativecommons org licen[sc]es by nd [1-4]
cc-by-nc|creative commons|creative commons attribution non ?commercial(?: [1-4] [05])?(?! share| no)|cc by nc|creativecommons org licen[sc]es by nc [1-4]
cc-by-nc-sa|creative commons|creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?|cc by nc sa|creativecommons org licen[sc]es by nc sa [1-4]
cc-by-nc-nd|creative commons|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?|cc by nc nd|creativecommons org licen[sc]es by nc nd [1-4]
sspl-1|server side|server side public licen[sc]e(?: (?:version |v ?)?1)?|sspl 1 0|mongodb com licensing server side public licen[sc]e
busl-1.1|business source|business source licen[sc]e(?: 1 1)?|busl 1 1|mariadb com bsl11
elastic-2|elastic|elastic licen[sc]e (?:version )?2(?: 0)?|elastic 2 0|elastic co licensing elastic licen[sc]e
upl-1|universal permissive|universal permissive licen[sc]e(?: (?:v ?)?1 0)?|upl 1 0|opensource org licen[sc]es upl
blueoak-1|blue oak|blue oak model licen[sc]e(?: 1 0 0)?|blueoak 1 0 0|blueoakcouncil org licen[sc]e
mulanpsl-2|mulan|mulan (?:permissive software licen[sc]e|psl) ?(?:version |v ?)?2|mulanpsl 2 0|licen[sc]e coscl org cn mulanpsl2
openrail|openrail|(?:creativeml |bigscience )?(?:bloom )?open ?rail(?: ?m)?(?: licen[sc]e)?|openrail|huggingface co spaces bigscience licen[sc]e
llama-community|community licen|llama (?:2|3) community licen[sc]e(?: agreement)?|llama[23]|ai meta com llama licen[sc]e
vim|vim|vim licen[sc]e|vim|vimhelp org uganda
curl|curl|curl licen[sc]e|curl|curl se docs copyright
ijg|jpeg|independent jpeg group licen[sc]e|ijg|ijg org files readme
hpnd|historical permission|historical permission notice and disclaimer|hpnd|opensource org licen[sc]es hpnd
lppl-1.3|latex|latex project public licen[sc]e(?: (?:version )?1 3[ac]?)?|lppl 1 3[ac]?|latex project org lppl
qpl-1|q public|q public licen[sc]e(?: (?:version )?1 0)?|qpl 1 0|opensource org licen[sc]es qpl 1 0
zpl-2|zope|zope public licen[sc]e(?: (?:version )?2 [01])?|zpl 2 [01]|opensource org licen[sc]es zpl 2 0
ipl-1|ibm public|ibm public licen[sc]e(?: (?:version )?1 0)?|ipl 1 0|opensource org licen[sc]es ipl 1 0
spl-1|sun public|sun public licen[sc]e(?: (?:version )?1 0)?|spl 1 0|opensource org licen[sc]es spl 1 0
npl-1|netscape|netscape public licen[sc]e(?: (?:version )?1 [01])?|npl 1 [01]|mozilla org mpl npl
apsl-2|apple|apple public source licen[sc]e(?: (?:version )?2 0)?|apsl 2 0|opensource apple com apsl
nasa-1.3|nasa|nasa open source agreement(?: (?:version )?1 3)?|nasa 1 3|opensource org licen[sc]es nasa 1 3
cecill-2.1|cecill|cecill (?:free software licen[sc]e agreement|licen[sc]e)(?: (?:v|version )?2 1)?|cecill 2 1|cecill info licences
"""
# Fixed values. label | keywords | sentences that only the licence's own text has.
SENTENCES = """
mit|merge publish distribute|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|the above copyright notice|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
bsd-3-clause|endorse or promote|neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-2-clause|redistribution and use|redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-4-clause|advertising materials|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2|compliance with the license|you may not use this file except in compliance with the license
isc|with or without fee|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
gpl|redistribute it and or modify|is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl|redistribute it and or modify|is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl-3|redistribute it and or modify|is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
mpl-2|subject to the terms|this source code form is subject to the terms of the mozilla public license v 2 0
zlib|as is without any express|this software is provided as is without any express or implied warranty in no event will the authors be held liable
unlicense|released into the public domain|this is free and unencumbered software released into the public domain
gfdl-1.3|invariant sections|with no invariant sections no front cover texts and no back cover texts
bsl-1|machine executable|machine executable object code generated by a source language processor
ofl-1.1|reserved font|with reserved font name
cc0|copyright and related|waived all copyright and related or neighboring rights
proprietary|all rights reserved|all rights reserved
proprietary|confidential|proprietary and confidential
gpl|general public|gnu general public licen[sc]e
lgpl|lesser general|gnu lesser general public licen[sc]e
bsd|bsd licen|bsd licen[sc]e
apache|apache licen|apache licen[sc]e
cc|creative commons|creative commons licen[sc]e
public-domain|public domain|(?:in|into|to) the public domain
"""
GENERAL = {"gpl", "lgpl", "bsd", "apache", "cc", "public-domain", "proprietary"}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]  # the prefilter: all must occur
    pattern: str
    base: bool = False  # a detection of it stays whatever contains it


def phrase_rules(phrases: Sequence[tuple[str, str]]) -> list[Rule]:
    """Rules for plain phrases (phrase, label), whose places always stay."""
    return [Rule(label, SPDX, (phrase,), re.escape(phrase).replace(r"\ ", " "), True) for phrase, label in phrases]


def signature_rules() -> list[Rule]:
    """Four rules for each family (tag, grant, page, bare name) and one for each sentence."""
    rules = []
    for line in FAMILIES.strip().split("\n"):
        label, keyword, name, tags, page = _columns(line)
        fixed = re.match(r"[a-z0-9]+(?: [a-z0-9]+)*(?= )", page)
        rules += [
            Rule(label, SPDX, ("spdx",), _TAG + f"(?:{tags})"),
            Rule(label, GRANT, (keyword,), _UNDER + f"(?:{name})"),
            Rule(label, LINK, (fixed[0] if fixed else page.split()[0],), f"(?:https? )?(?:www )?(?:{page})"),
            Rule(label, NAME, (keyword,), f"(?:{name})"),
        ]
    for line in SENTENCES.strip().split("\n"):
        label, keyword, body = line.split("|", 2)
        rules.append(Rule(label, NAME if label in GENERAL else TEXT, (keyword,), body))
    return rules


def _columns(line: str) -> list[str]:
    """Parts between the bars of a line; bars inside brackets belong to a pattern."""
    depth, out = 0, [""]
    for c in line:
        depth += (c in "([") - (c in ")]")
        if c == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]) -> tuple[object, list[tuple[int, ...]], list[re.Pattern]]:
    keys = {k: i for i, k in enumerate(dict.fromkeys(k for r in rules for k in r.keywords))}
    machine = ahocorasick.Automaton()
    for k, i in keys.items():
        machine.add_word(k, i)
    if keys:
        machine.make_automaton()
    return machine, [tuple(keys[k] for k in r.keywords) for r in rules], [
        re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in rules
    ]


def suppress(found: Sequence[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of detections (priority, start, end, rule) those that no stronger one contains: one of a lower priority number,
    or of the same that is longer, or equal and of an earlier rule. Each level is one sweep, by start."""
    kept: list[tuple[int, int, int, int]] = []
    levels: list[tuple[list[int], list[int]]] = []
    for priority in sorted({f[0] for f in found}):
        starts, ends = [], []
        for f in sorted((f for f in found if f[0] == priority), key=lambda f: (f[1], -f[2], f[3])):
            if ends and ends[-1] >= f[2]:
                continue
            starts.append(f[1])
            ends.append(f[2])
            if not any((i := bisect_right(s, f[1])) and e[i - 1] >= f[2] for s, e in levels):
                kept.append(f)
        levels.append((starts, ends))
    return sorted(kept, key=lambda f: (f[1], f[2], f[3]))


def _places(pattern: re.Pattern, flat: str, overlapping: bool) -> Iterator[tuple[int, int]]:
    m = pattern.search(flat)
    while m:
        yield m.span()
        m = pattern.search(flat, m.start() + 1 if overlapping else m.end())


def detect(text: str | None, rules: tuple[Rule, ...]) -> tuple[int, list[tuple[int, int, int, int]]]:
    """(number of words, detections (priority, first word, word after the last, rule)) of a text."""
    words = (text or "").encode().translate(_TABLE).split()
    flat = b" ".join(words).decode()
    machine, needs, patterns = _compiled(rules)
    if not len(machine):
        return len(words), []
    present = {i for _, i in machine.iter(flat)}
    found: list[tuple[int, int, int, int]] = []
    for k, need in enumerate(needs):
        if present.issuperset(need):
            found += [(rules[k].priority, *span, k) for span in _places(patterns[k], flat, rules[k].base)]
    if not found:
        return len(words), []
    base = [f for f in found if rules[f[3]].base]
    kept = base + [f for f in suppress(found) if not rules[f[3]].base]
    # Character offsets become word numbers in one walk over the starts.
    at, count, numbers = 0, 0, {}
    for place in sorted({f[1] for f in kept}):
        count += flat.count(" ", at, place)
        at = place
        numbers[place] = count
    return len(words), [(p, numbers[s], numbers[s] + flat.count(" ", s, e) + 1, k) for p, s, e, k in sorted(kept, key=lambda f: (f[1], f[2], f[3]))]


def find_licenses(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", prefix: str = "license_") -> DataFrame:
    """`docs` without its text, with `license_words` (number of words), `license_found` (label, priority, base, first
    word, word after the last; by place) and `license_score`, the confidence of the strongest detection (0 if none).

    Words are lower-cased and only blanks stand between them, so line breaks, markup and punctuation inside a notice do
    not matter. A rule runs on a text only if all its keywords occur, which one Aho-Corasick pass tells. A detection
    that lies within a stronger one goes; overlaps without containment and all base phrases stay.

    Row by row, no shuffle. NULL is read as the empty text: no words, nothing found, score 0. Repeated rows stay, other
    columns pass through (new names that meet one get underscores), an empty table gives an empty result.
    """
    rules = tuple(rules)
    others = [c for c in docs.columns if c != text_col]
    names = []
    for c in ("words", "found", "score"):
        name = prefix + c
        while name.lower() in {x.lower() for x in docs.columns}:
            name += "_"
        names.append(name)
    fields = [("label", T.StringType(), pa.string()), ("priority", T.IntegerType(), pa.int32()), ("base", T.BooleanType(), pa.bool_()), ("first", T.LongType(), pa.int64()), ("end", T.LongType(), pa.int64())]
    spark_found = T.ArrayType(T.StructType([T.StructField(n, t) for n, t, _ in fields]))
    arrow_found = pa.list_(pa.struct([(n, t) for n, _, t in fields]))
    schema = T.StructType([*[docs.schema[c] for c in others], *[T.StructField(n, t) for n, t in zip(names, (T.LongType(), spark_found, T.DoubleType()))]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists, scores = [], [], []
            for text in batch.column(len(others)):
                n, found = detect(text.as_py(), rules)
                counts.append(n)
                lists.append([{"label": rules[k].label, "priority": p, "base": rules[k].base, "first": a, "end": b} for p, a, b, k in found])
                scores.append(max((CONFIDENCE[p] for p, *_ in found), default=0.0))
            made = [pa.array(counts, pa.int64()), pa.array(lists, arrow_found), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *made], names=[*others, *names])

    return docs.select(*[column(c) for c in others], column(text_col)).mapInArrow(each, schema)
