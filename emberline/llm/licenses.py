"""Licence scans: known sentences, then ordered rules over their identifiers, in DataFrame functions only.

A text is cut into sentences at blank lines (also those of comment marks only), list marks and ``. ! ?`` before
white space; everything but a-z and 0-9, A-Z lower-cased, is a single blank, so comment marks fall away. A known
sentence may begin and end at any line feed as well, and run over any number of wrapped lines; of those that begin
at one place the longest counts. It is mapped to the identifiers that it stands for. Rules, in order, look for
their sequence of identifiers among the identifiers found, next to each other once unknown sentences are left
out; what a rule has matched is used up for the rules after it.

``SENTENCES``, ``RULES`` and ``RESTRICTED`` are what the SQL twin knows: short sentences of one line each. The
operator knows ``KNOWN`` (text to identifiers), ``ALL_RULES`` and ``ALL_RESTRICTED``, which contain them.

Defined cases: null and empty texts have no sentences; a sentence that occurs twice counts twice; an empty
table gives no rows; columns of the input come through, but for those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences by identifier.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "you may not use this file except in compliance with the license",
    3: "you may obtain a copy of the license at",
    4: "see the license for the specific language governing permissions and limitations under the license",
    5: "released under the mit license",
    6: "permission is hereby granted free of charge to any person obtaining a copy of this software",
    7: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    8: "this work is licensed under the gnu general public license version 3",
    9: "this program is free software you can redistribute it and or modify it",
    10: "you should have received a copy of the gnu general public license along with this program",
    11: "licensed under cc by nc 4 0",
    12: "licensed under cc by 4 0",
    13: "all rights reserved",
    14: "redistribution and use in source and binary forms with or without modification are permitted",
    15: "redistributions of source code must retain the above copyright notice",
    16: "redistributions in binary form must reproduce the above copyright notice",
    17: "spdx license identifier mit",
    18: "spdx license identifier apache 2 0",
}
#: Fixed values: (licence, sequence of sentence identifiers), the longer rules before the shorter ones they contain.
RULES = [
    ("Apache-2.0", (1, 2, 3, 4)),
    ("BSD-2-Clause", (14, 15, 16)),
    ("MIT", (6, 7)),
    ("GPL-3.0", (9, 10)),
    ("Apache-2.0", (1,)),
    ("MIT", (5,)),
    ("GPL-3.0", (8,)),
    ("CC-BY-NC-4.0", (11,)),
    ("CC-BY-4.0", (12,)),
    ("MIT", (17,)),
    ("Apache-2.0", (18,)),
    ("Proprietary", (13,)),
]
#: Licences that forbid or bind commercial re-use of the text.
RESTRICTED = ("GPL-3.0", "CC-BY-NC-4.0", "Proprietary")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPDX_LINE = "spdx license identifier "
RESULTS = ("sentence_ids", "licenses", "restricted")

# What follows holds the sentences as the licences print them; names that vary are in braces and spelt out below.
_GPL = "{} is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_ANY = "or at your option any later version"
_KINDS = {"GPL": "general public license", "LGPL": "lesser general public license", "LLGPL": "library general public license", "AGPL": "affero general public license"}
_CC = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
_SPDX = ["MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "Unlicense", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0", "WTFPL", "PSF-2.0", "Artistic-2.0"]
_SPDX += [f"{kind}-{version}" for kind, versions in (("GPL", ("2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("3.0",))) for version in versions]
_SPDX += [f"CC-{kind.upper().replace(' ', '-')}-{version}" for kind in _CC for version in ("2.0", "2.5", "3.0", "4.0")]


def _plain(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


def _catalogue() -> tuple[dict[str, tuple[int, ...]], list[tuple[str, tuple[int, ...]]]]:
    """Sentences by text, each with its identifiers, and the rules; new identifiers follow those of ``SENTENCES``."""
    known: dict[str, tuple[int, ...]] = {text: (number,) for number, text in SENTENCES.items()}
    several, single = list(RULES[:4]), list(RULES[4:-1])
    ids = {name: (seq[0],) for name, seq in RULES if len(seq) == 1}  # by licence: the identifier of its notices
    last = max(SENTENCES)

    def new(*texts: str) -> tuple[int]:
        nonlocal last
        last += 1
        known.update(dict.fromkeys(texts, (last,)))
        return (last,)

    def notice(name: str, *texts: str) -> None:
        single.append((name, new(*texts)))

    # whole sentences for which the short ones stand
    known["licensed under the apache license version 2 0 the license"] = (1,)
    known["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"] = (1, 2)
    known["licensed under the apache license version 2 0 the license you may not use this work except in compliance with the license"] = (1, 2)
    for s in ("s", ""):
        known[f"you may obtain a copy of the license at http{s} www apache org licenses license 2 0"] = (3,)
    grant = SENTENCES[6] + " and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    known[grant + " subject to the following conditions"] = (6,)
    known[SENTENCES[7].replace("notice shall", "notice including the next paragraph shall")] = (7,)
    single.append(("MIT-0", new(grant)))
    held = " this list of conditions and the following disclaimer"
    known[SENTENCES[14] + " provided that the following conditions are met"] = (14,)
    known[SENTENCES[15] + held] = (15,)
    known[SENTENCES[16] + held + " in the documentation and or other materials provided with the distribution"] = (16,)
    ends = "may be used to endorse or promote products derived from this software without specific prior written permission"
    third = new(
        f"neither the name of the copyright holder nor the names of its contributors {ends}", f"nor the names of its contributors {ends}",
        f"the name of the author may not {ends[4:]}", f"the names of its contributors may not {ends[4:]}",
    )
    for four in ((14, 15, 16, *third), (14, 15, *third)):
        several.insert(0, ("BSD-3-Clause", four))
    known[SENTENCES[8] + " or later"] = known["released under the gnu general public license version 3"] = (8,)
    known["licensed under the mit license"] = known["this project is licensed under the mit license"] = known["distributed under the mit license"] = (5,)
    known["this project is licensed under the apache license version 2 0"] = known["released under the apache license version 2 0"] = known["licensed under the apache license 2 0"] = (1,)
    known["apache license version 2 0 january 2004"] = known["apache license version 2 0 january 2004 http www apache org licenses"] = (1,)
    # the family of the GPL: headers of files, then the titles of the licences themselves
    for short, title in _KINDS.items():
        dated = {"GPL": {"2": "june 1991", "3": "29 june 2007"}, "LGPL": {"2 1": "february 1999", "3": "29 june 2007"}, "LLGPL": {"2": "june 1991"}, "AGPL": {"3": "19 november 2007"}}[short]
        received = [(10,)] if short == "GPL" else []
        thanks = f"you should have received a copy of the gnu {title} along with this "
        both = (received or [new(*(thanks + x for x in ("program", "library")))])[0]
        known.update({thanks + x + y: both for x in ("program", "library", "file", "software") for y in ("", " if not see http www gnu org licenses", " if not see https www gnu org licenses")})
        for version, date in dated.items():
            name = f"{short.removeprefix('L') if short == 'LLGPL' else short}-{version.replace(' ', '.') if ' ' in version else version + '.0'}"
            texts = [f"gnu {title} version {version} {date}"]
            for what in ("this program", "this library"):
                base = _GPL.format(what, title)
                texts += [f"{base} {e}version {version} of the license{rest}" for e, rest in (("", ""), ("either ", " " + _ANY))]
                texts.append(base.replace(f"{title} as", f"{title} version {version} as"))
            number = new(*texts, f"this work is licensed under the gnu {title} version {version}") if (short, version) != ("GPL", "3") else new(*texts)
            several.append((name, number + both))
            single.append((name, number))
    # licences of their own words
    mozilla = new("this source code form is subject to the terms of the mozilla public license v", "this source code form is subject to the terms of the mozilla public license version 2 0")
    where = new(*(f"if a copy of the mpl was not distributed with this file you can obtain one at http{s} {w}mozilla org mpl 2 0" for s in ("", "s") for w in ("", "www ")))
    several.append(("MPL-2.0", mozilla + where))
    single.append(("MPL-2.0", where))
    notice("MPL-2.0", "mozilla public license version 2 0")
    asked = ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"]
    notice("ISC", *(a + " provided that the above copyright notice and this permission notice appear in all copies" for a in asked))
    notice("0BSD", *asked)
    notice("Zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions")
    notice("Unlicense", "this is free and unencumbered software released into the public domain")
    notice("WTFPL", "do what the fuck you want to public license")
    boost = "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
    notice("BSL-1.0", boost, "boost software license version 1 0 august 17th 2003", "distributed under the boost software license version 1 0")
    for version, at in (("1.0", "v10"), ("2.0", "2 0")):
        made = "this program and the accompanying materials are made available under the terms of the eclipse public license " + ("" if version == "2.0" else "v") + _plain(version)
        notice(f"EPL-{version}", f"eclipse public license v {_plain(version)}", f"eclipse public license version {_plain(version)}", made, *(f"{made} which {y} available at http{s} www eclipse org legal epl {x}" for s in ("", "s") for x in (at, at + " html") for y in ("is", "accompanies this distribution and is")))
    notice("CC0-1.0", "cc0 1 0 universal", "licensed under cc0 1 0", "licensed under cc0")
    for kind, title in _CC.items():
        for version in ("2.0", "2.5", "3.0", "4.0"):
            name, v = f"CC-{kind.upper().replace(' ', '-')}-{version}", _plain(version)
            titles = dict.fromkeys((title, title.replace("noncommercial", "non commercial").replace("sharealike", "share alike").replace("noderivatives", "no derivatives"), title.replace("noderivatives", "noderivs")))
            where = ("", {"4.0": " international", "3.0": " unported"}.get(version, " generic"))
            names = [f"cc {kind} {v}", *(f"creative commons {t} {v}{w}" for t in titles for w in where)]
            texts = [f"{a}licensed under {form}" for n in names for a in ("", "this work is ") for form in (n, f"{n} license", f"a {n} license", f"the {n} license")]
            texts = [t for t in texts if t not in known]
            if name in ids:
                known.update(dict.fromkeys(texts, ids[name]))
            else:
                notice(name, *texts)
    # SPDX lines of one identifier; those of several are cut before
    spdx = {"MIT": (17,), "Apache-2.0": (18,)}
    for name in _SPDX:
        if name not in spdx:
            spdx[name] = new(f"spdx license identifier {_plain(name)}")
            single.append((name, spdx[name]))
        family = name.split("-")[0] in ("GPL", "LGPL", "AGPL")
        for ending in (" only", " or later") if family else ():
            known[f"spdx license identifier {_plain(name)}{ending}"] = spdx[name]
    # a reservation just before a licence's whole text is part of its copyright line
    several.sort(key=lambda rule: -len(rule[1]))
    reserved = [(name, (13, *seq)) for name, seq in several]
    return known, [*(r for pair in zip(reserved, several) for r in pair), *single, RULES[-1]]


KNOWN, ALL_RULES = _catalogue()
#: Licences of ``ALL_RULES`` that forbid commercial re-use or bind works made of the text to their own terms.
ALL_RESTRICTED = (*RESTRICTED, *sorted({n for n, _ in ALL_RULES if n.startswith(("GPL", "LGPL", "AGPL", "MPL", "EPL")) or "-NC" in n or "-SA" in n or "-ND" in n} - {*RESTRICTED}))


def _ends_cut(text: Column) -> Column:
    """Words with single blanks; \x01 where a sentence ends for certain, \n where a line does."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER + "\x01", LOWER + " ")
    ended = F.regexp_replace(lower, r"[.!?]+[ \t\n\r]+(?:[^a-z0-9\n]*+\n)*+", "\x01")
    marked = F.regexp_replace(ended, r"(?<![^\n\x01])[^a-z0-9\n\x01]*(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})\)[ \t]+", "\x01")
    marked = F.regexp_replace(marked, r"(?<![^\n\x01])[ \t]*(?:rem|dnl)\b", "")
    plain = F.regexp_replace(marked, r"[^a-z0-9\n\x01]+", " ")
    lines = F.regexp_replace(plain, r" *([\n\x01]) *", "$1")
    whole = F.regexp_replace(lines, r"\n*\x01[\n\x01]*|\n{2,}", "\x01")
    named = F.regexp_replace(whole, r"(?<![^\n\x01])(?:[a-z0-9]+[ \n]){1,8}?is free software([ \n])you can", "this program is free software$1you can")
    listed = F.regexp_replace(named, r"(?<![^\n\x01])neither the names? of (?:[a-z0-9]+[ \n]){1,16}?nor the names? of (?:[a-z0-9]+[ \n]){1,8}?may", "neither the name of the copyright holder nor the names of its contributors may")
    listed = F.trim(listed)
    # asked of the raw text, so that the steps above are taken once
    return F.when(F.contains(lower, F.lit("spdx")), _spdx_apart(listed)).otherwise(listed)


def _spdx_apart(text: Column) -> Column:
    """SPDX expressions, of any number of licences, as one sentence for each licence."""
    pieces = F.split(text, r"(?<=[\n\x01])")  # each with the mark of its end
    apart = lambda piece: F.regexp_replace(piece, r" (?:or|and) (?!later)", f"\x01{SPDX_LINE}")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith(SPDX_LINE), apart(p)).otherwise(p)), "")


def _any_of(texts: list[list[str]]) -> str:
    """A pattern of all these word lists, longest first, common beginnings taken once, any blank a line feed."""
    heads: dict[str, list[list[str]]] = {}
    for first, *more in filter(None, texts):
        heads.setdefault(first, []).append(more)
    made = []
    for first, rest in heads.items():
        chain = [first]
        while len(rest) == 1 or all(rest) and len({r[0] for r in rest}) == 1:
            if not rest[0]:
                break
            chain.append(rest[0][0])
            rest = [r[1:] for r in rest]
        tail = _any_of(rest)
        tail = f"(?:[ \\n]{tail})" + ("?" if [] in rest else "") if tail else ""
        made.append(r"[ \n]".join(chain) + tail)
    return made[0] if len(made) == 1 else f"(?:{'|'.join(made)})" if made else ""


def scan(docs: DataFrame, sentences: dict | None = None, rules: list | None = None, restricted: tuple | None = None) -> DataFrame:
    """``docs`` with ``sentence_ids`` (array, in text order), ``licenses`` (array, in rule order) and ``restricted``.

    ``sentences`` are identifiers' texts as ``SENTENCES`` has them, or texts with their identifiers as ``KNOWN``.
    """
    sentences, rules, restricted = sentences or KNOWN, rules or ALL_RULES, restricted or ALL_RESTRICTED
    if all(isinstance(number, int) for number in sentences):
        sentences = {text: (number,) for number, text in sentences.items()}
    known = F.str_to_map(F.lit(";".join(f"{text}:{','.join(map(str, ids))}" for text, ids in sentences.items())), F.lit(";"), F.lit(":"))
    pattern = rf"(?<![^\n\x01]){_any_of([text.split(' ') for text in sentences])}(?![^\n\x01])"
    hits = F.regexp_extract_all(_ends_cut(F.col("text")), F.lit(pattern), F.lit(0))
    numbers = F.flatten(F.transform(hits, lambda s: F.split(F.try_element_at(known, F.translate(s, "\n", " ")), ",").cast("array<int>")))
    found = F.filter(numbers, lambda n: n.isNotNull())
    docs = docs.drop(*RESULTS).withColumn("sentence_ids", found)
    tags = F.array_join(F.transform("sentence_ids", lambda n: F.concat(F.lit("<"), n.cast("string"), F.lit(">"))), "")
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{n}>" for n in ids)).alias("tags")) for name, ids in rules))
    start = F.struct(tags.alias("rest"), F.array().cast("array<string>").alias("names"))
    matched = F.aggregate(
        table,
        start,
        lambda acc, rule: F.struct(
            F.replace(acc["rest"], rule["tags"], F.lit("|")).alias("rest"),
            F.when(F.contains(acc["rest"], rule["tags"]), F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names"),
        ),
        lambda acc: F.array_distinct(acc["names"]),
    )
    names = F.when(F.size("sentence_ids") > 0, matched).otherwise(F.array().cast("array<string>"))
    return docs.withColumn("licenses", names).withColumn(
        "restricted", F.arrays_overlap("licenses", F.array(*map(F.lit, restricted)))
    )
