"""License scans: ordered signature rules behind a keyword prefilter.

Texts without any keyword are only counted. The others are reduced to their words, and rules whose
keyword occurs are matched: SPDX identifiers, clauses of the licenses and their usual notices, names
after words of licensing, and names alone. A detection that lies within one of higher priority, or
within a longer one of the same priority, is suppressed, in one pass over the detections in order.
Everything is a projection over built-in functions: nothing is shuffled, and a row's result depends
on its own text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, without

#: Words over texts of any case; those of the lower-cased text are the same places.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label | keyword | regex over words joined by single spaces
FAMILIES = """
mit | mit | mit licen[cs]e
mit | expat | expat licen[cs]e
mit-0 | mit | mit no attribution(?: licen[cs]e)?|mit 0 licen[cs]e
x11 | x11 | x11 licen[cs]e
apache-2 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?|apache 2(?: 0)?
apache-1.1 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?1 1
apache-1.0 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?1 0
gpl-3 | general public | gnu general public licen[cs]e(?: version| v)? ?3(?: 0)?
gpl-2 | general public | gnu general public licen[cs]e(?: version| v)? ?2(?: 0)?
gpl-1 | general public | gnu general public licen[cs]e(?: version| v)? ?1(?: 0)?
gpl | general public | gnu general public licen[cs]e
gpl-3 | gpl | (?:gnu )?gpl(?: version| v)? ?3(?: 0)?|gplv3
gpl-2 | gpl | (?:gnu )?gpl(?: version| v)? ?2(?: 0)?|gplv2
lgpl-3 | general public | gnu (?:lesser|library) general public licen[cs]e(?: version| v)? ?3(?: 0)?
lgpl-2.1 | general public | gnu (?:lesser|library) general public licen[cs]e(?: version| v)? ?2 1
lgpl-2 | general public | gnu (?:lesser|library) general public licen[cs]e(?: version| v)? ?2(?: 0)?
lgpl | general public | gnu (?:lesser|library) general public licen[cs]e
gpl | gpl | gnu gpl
lgpl-3 | lgpl | (?:gnu )?lgpl(?: version| v)? ?3(?: 0)?|lgplv3
lgpl-2.1 | lgpl | (?:gnu )?lgpl(?: version| v)? ?2 1|lgplv2 1
lgpl-2 | lgpl | (?:gnu )?lgpl(?: version| v)? ?2(?: 0)?(?! 1 )|lgplv2(?! 1 )
lgpl | lgpl | (?:gnu )?lgpl(?: version| v)? ?[23]?(?: [01])?
agpl-3 | general public | gnu affero general public licen[cs]e(?: version| v)? ?3(?: 0)?
agpl | general public | gnu affero general public licen[cs]e
agpl-3 | agpl | (?:gnu )?agpl(?: version| v)? ?3(?: 0)?
fdl-1.3 | documentation | gnu free documentation licen[cs]e(?: version| v)? ?1 3
fdl | documentation | gnu free documentation licen[cs]e
mpl-2 | mozilla | mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?
mpl-1.1 | mozilla | mozilla public licen[cs]e(?: version| v)? ?1 1
mpl | mozilla | mozilla public licen[cs]e
mpl-2 | mpl | mpl(?: version| v)? ?2 0|mplv2
mpl-1.1 | mpl | mpl(?: version| v)? ?1 1
epl-2 | epl | epl(?: version| v)? ?2 0
epl-1 | epl | epl(?: version| v)? ?1 0
epl-2 | eclipse | eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?
epl-1 | eclipse | eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?
cddl-1 | development and distribution | common development and distribution licen[cs]e(?: version| v)? ?1(?: [01])?
cpl-1 | common public | common public licen[cs]e(?: version| v)? ?1(?: 0)?
bsd-2 | bsd | (?:2 clause|two clause|simplified|freebsd) bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?
bsd-3 | bsd | (?:3 clause|three clause|new|revised|modified) bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?
bsd-4 | bsd | (?:4 clause|four clause|original) bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?
bsd | bsd | bsd(?: style)? licen[cs]e
bsd-3 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
isc | isc | isc licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
bsl-1 | boost | boost software licen[cs]e(?: version| v)? ?1(?: 0)?
unlicense | unlicense | (?:the )?unlicense
wtfpl | what the | do what the fuck you want to public licen[cs]e
wtfpl | wtfpl | wtfpl
cc0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0 | cc zero | cc zero(?: 1 0)?
cc-by | cc by | cc by(?: [1-4] [05])?
cc-by-sa | cc by | cc by sa(?: [1-4] [05])?
cc-by-nd | cc by | cc by nd(?: [1-4] [05])?
cc-by-nc | cc by | cc by nc(?: [1-4] [05])?
cc-by-nc-sa | cc by | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | cc by | cc by nc nd(?: [1-4] [05])?
cc-by | creative commons | creative commons attribution(?: [1-4] [05])?(?: international| unported)?
cc-by-sa | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative|atives|s)(?: [1-4] [05])?(?: international| unported)?
cc-by-nc | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?
cc-by | creative commons | creative commons by(?: [1-4] [05])?
cc-by-sa | creative commons | creative commons by sa(?: [1-4] [05])?
cc-by-nd | creative commons | creative commons by nd(?: [1-4] [05])?
cc-by-nc | creative commons | creative commons by nc(?: [1-4] [05])?
cc-by-nc-sa | creative commons | creative commons by nc sa(?: [1-4] [05])?
cc-by-nc-nd | creative commons | creative commons by nc nd(?: [1-4] [05])?
ofl-1.1 | font | sil open font licen[cs]e(?: version| v)? ?1 1|open font licen[cs]e
artistic-2 | artistic | artistic licen[cs]e(?: version| v)? ?2(?: 0)?
artistic-1 | artistic | artistic licen[cs]e(?: version| v)? ?1(?: 0)?|perl artistic licen[cs]e
eupl-1.2 | european union | european union public licen[cs]e(?: version| v)? ?1 2
eupl | european union | european union public licen[cs]e
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
psf-2 | python | python software foundation licen[cs]e(?: version| v)? ?2?
php-3 | php | php licen[cs]e(?: version| v)? ?3(?: 01?)?
ruby | ruby | ruby licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
openssl | openssl | openssl licen[cs]e
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e
afl-3 | academic | academic free licen[cs]e(?: version| v)? ?3(?: 0)?
osl-3 | open software | open software licen[cs]e(?: version| v)? ?3(?: 0)?
upl-1 | permissive | universal permissive licen[cs]e(?: version| v)? ?1?(?: 0)?
ecl-2 | educational | educational community licen[cs]e(?: version| v)? ?2(?: 0)?
odbl | open database | open database licen[cs]e
w3c | w3c | w3c(?: software)?(?: notice and)? licen[cs]e
vim | vim | vim licen[cs]e
proprietary | all rights reserved | all rights reserved
public-domain | public domain | (?:in|into) the public domain|public domain dedication
"""

#: label | regex over the words of an SPDX identifier, which names a license without its prose name
SPDX = """
mit | mit(?! (?:0|advertising|click|cmu|enna|feh|festival|khronos|modern|open|stk|testregex|wu) )
mit-0 | mit 0
x11 | x11(?! (?:distribute|swapped) )
apache-2 | apache 2 0
apache-1.1 | apache 1 1
apache-1.0 | apache 1 0
gpl-3 | gpl 3 0(?: only| or later)?
gpl-2 | gpl 2 0(?: only| or later)?
gpl-1 | gpl 1 0(?: only| or later)?
lgpl-3 | lgpl 3 0(?: only| or later)?
lgpl-2.1 | lgpl 2 1(?: only| or later)?
lgpl-2 | lgpl 2 0(?: only| or later)?
agpl-3 | agpl 3 0(?: only| or later)?
agpl | agpl 1 0(?: only| or later)?
fdl-1.3 | gfdl 1 3(?: no invariants| invariants)?(?: only| or later)?
fdl | gfdl 1 [12](?: no invariants| invariants)?(?: only| or later)?
mpl-2 | mpl 2 0(?: no copyleft exception)?
mpl-1.1 | mpl 1 1
mpl | mpl 1 0
epl-2 | epl 2 0
epl-1 | epl 1 0
cddl-1 | cddl 1 [01]
cpl-1 | cpl 1 0
bsd-2 | bsd 2 clause(?! (?:darwin|first|patent|pkgconf|views) )
bsd-3 | bsd 3 clause(?! (?:acpica|attribution|clear|flex|hp|lbnl|modification|no|open|sun) )
bsd-4 | bsd 4 clause(?! (?:shortened|uc) )
isc | isc(?! veillard )
zlib | zlib(?! acknowledgement )
bsl-1 | bsl 1 0
unlicense | unlicense
wtfpl | wtfpl
cc0 | cc0 1 0
cc-by | cc by [1-4] [05]
cc-by-sa | cc by sa [1-4] [05]
cc-by-nd | cc by nd [1-4] [05]
cc-by-nc | cc by nc [1-4] [05]
cc-by-nc-sa | cc by nc sa [1-4] [05]
cc-by-nc-nd | cc by nc nd [1-4] [05]
ofl-1.1 | ofl 1 1(?: no rfn| rfn)?
artistic-2 | artistic 2 0
artistic-1 | artistic 1 0(?: cl8| perl)?
eupl-1.2 | eupl 1 2
eupl | eupl 1 [01]
ms-pl | ms pl
ms-rl | ms rl
psf-2 | psf 2 0|python 2 0
php-3 | php 3 01?
ruby | ruby
postgresql | postgresql
openssl | openssl
ncsa | ncsa
afl-3 | afl 3 0
osl-3 | osl 3 0
upl-1 | upl 1 0
ecl-2 | ecl 2 0
odbl | odbl 1 0
w3c | w3c
vim | vim
"""

#: label | keyword | regex of a clause or a notice that stands for the license
CLAUSES = r"""
mit | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | free of charge | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11 | consortium | except as contained in this notice the name of the x consortium shall not be used
bsl-1 | free of charge | permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this license
isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided that the above)
isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd-3 | contributors may be used | neither the name of (?:\w+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-4 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-2 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software
bsd | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
apache-2 | in compliance | you may not use (?:this file|this work|this software|these files) except in compliance with the license
apache-2 | as is basis | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | apache org | apache org licenses license 2 0
apache-1.1 | apache | this product includes software developed by the apache software foundation
gpl-3 | gnu | either version 3 of the license or (?:at your option )?any later version
gpl-2 | gnu | either version 2 of the license or (?:at your option )?any later version
gpl-1 | gnu | either version 1 or (?:at your option )?any later version
gpl | gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | gnu | this program is distributed in the hope that it will be useful but without any warranty
gpl | gnu | you should have received a copy of the gnu general public license
gpl-3 | gnu | gnu org licenses gpl 3 0
gpl-2 | gnu | gnu org licenses (?:old licenses )?gpl 2 0
lgpl | gnu | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | gnu | you should have received a copy of the gnu (?:lesser|library) general public license
lgpl-2.1 | gnu | either version 2 1 of the license or (?:at your option )?any later version
lgpl-3 | gnu | gnu org licenses lgpl 3 0
agpl-3 | gnu | gnu org licenses agpl 3 0
agpl | gnu | you should have received a copy of the gnu affero general public license
fdl | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | mozilla | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-2 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 2 0
epl-1 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 1 0
cddl-1 | development and distribution | the contents of this file are subject to the terms of the common development and distribution license
zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | unencumbered | anyone is free to copy modify publish use compile sell or distribute this software
cc0 | extent possible | to the extent possible under law (?:\w+ ){1,12}(?:has|have) (?:dedicated|waived) all copyright and related
cc0 | creativecommons | creativecommons org publicdomain zero 1 0
cc-by | creativecommons | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [05]
cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [05]
cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
wtfpl | what the | everyone is permitted to copy and distribute verbatim or modified copies of this license document
artistic-1 | artistic | the intent of this document is to state the conditions under which a package may be copied
ofl-1.1 | reserved font name | with reserved font name
ofl-1.1 | font software | permission is hereby granted free of charge to any person obtaining a copy of the font software
psf-2 | python | psf hereby grants licensee a nonexclusive royalty free world wide license
openssl | openssl | this product includes software developed by the openssl project
ncsa | university of illinois | developed by (?:\w+ ){1,12}university of illinois
postgresql | university of california | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ms-pl | microsoft | this license governs use of the accompanying software if you use the software you accept this license
w3c | w3c | by obtaining using and or copying this work you the licensee agree
odbl | open data commons | open data commons open database license
odc-by | open data commons | open data commons attribution license
pddl | open data commons | open data commons public domain dedication and licen[cs]e
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthori | unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|work|document) (?:via any medium )?is strictly prohibited
"""

#: label | keyword | regex of a short name that says enough only after words of licensing
SHORT = r"""
mit | mit | mit
apache-2 | apache | apache(?: v)? ?2(?: 0)?
apache-2 | asl | asl ?2(?: 0)?
apache | apache | apache
bsd-2 | bsd | bsd 2|2 clause bsd
bsd-3 | bsd | bsd 3|3 clause bsd
bsd | bsd | bsd
isc | isc | isc
mpl-2 | mpl | mpl(?: v)? ?2(?: 0)?
mpl-1.1 | mpl | mpl(?: v)? ?1 1
epl-2 | epl | epl(?: v)? ?2(?: 0)?
epl-1 | epl | epl(?: v)? ?1(?: 0)?
cddl-1 | cddl | cddl(?: v)?(?: 1(?: [01])?)?
zlib | zlib | zlib
x11 | x11 | x11
ncsa | ncsa | ncsa
postgresql | postgresql | postgresql
ofl-1.1 | ofl | (?:sil )?ofl(?: v)?(?: 1 1)?
eupl-1.2 | eupl | eupl(?: v)? ?1 2
eupl | eupl | eupl
odbl | odbl | odbl
afl-3 | afl | afl(?: v)? ?3(?: 0)?
osl-3 | osl | osl(?: v)? ?3(?: 0)?
upl-1 | upl | upl(?: v)?(?: 1 0)?
psf-2 | psf | psf
wtfpl | wtfpl | wtfpl
artistic-2 | artistic | artistic(?: v)? ?2(?: 0)?
ms-pl | ms pl | ms pl
proprietary | proprietary | (?:a )?proprietary licen[cs]e
"""

#: How a license is spoken of: priority, confidence, and what stands around the name. The last is the name alone.
FORMS = (
    (4, 0.98, r"(?:permission is hereby granted under|terms and conditions of|under the terms of|subject to the terms of|distributed under the terms of)(?: the)? (?:{name})"),
    (3, 0.95, r"(?:licen[cs]ed|released|distributed|published|made available|available|covered|provided|governed)(?: \w+)? (?:under|by)(?: the)? (?:{name})"),
    (2, 0.9, r"(?:under|by|see)(?: the)? (?:{name})"),
    (1, 0.7, r"(?:{name})"),
)
#: Priority and confidence of an SPDX identifier, of a clause, and of a short name after words of licensing.
SPDX_FORM = (5, 1.0, r"spdx licen[cs]e identifier (?:{name})")
CLAUSE_FORM = (4, 0.97, r"(?:{name})")
#: A field or sentence that tells a license by its identifier or short name: License: X, license = "X", see the license file (X).
FIELD_FORM = (2, 0.9, r"licen[cs]es?(?: is| are| name| type| id| file| file for details| for details| spdx)? (?:the )?(?:{name})")
SHORT_FORM = (2, 0.8, r"(?:(?:dual )?licen[cs]ed|released|distributed|published|made available|available)(?: \w+)? under(?: the)? (?:{name})")

#: What gates a text, besides cc followed by by, 0 or zero, and a short name under which something is licensed. Every
#: match of a rule holds one of these; of a keyword of several words the first and last are looked for.
KEYWORDS = ("licen", "all rights reserved", "public domain", "wtfpl", "creative", "gpl", "bsd", "apache", "cc0", "attribution", "hereby granted", "copyright notice", "advertising materials", "contributors may", "redistribut", "warranty", "later version", "dedicated all", "waived all", "any purpose", "reserved font", "unencumbered", "distribute this software", "misrepresented", "altered source", "proprietary", "strictly prohibited", "intent of this", "verbatim or modified", "this product includes", "university of illinois", "mpl was", "hereby grants", "by obtaining", "open data", "x consortium", "publicdomain")


def rules() -> list[tuple[int, str, int, float, str, str, str]]:
    """(place, label, priority, confidence, keyword, name, pattern) of every rule, in order; SPDX identifiers come first.

    A rule is tried only in a text that holds its keyword and somewhere its name. Identifiers come a
    second time, as values of a field called license.
    """
    out: list[tuple] = []

    def add(label: str, keyword: str, name: str, *forms: tuple[int, float, str]) -> None:
        for priority, confidence, form in forms:
            out.append((len(out), label, priority, confidence, keyword, _whole(f"(?:{name})"), _whole(f"(?:{form.format(name=name)})")))

    for line in SPDX.strip().splitlines():
        label, name = (x.strip() for x in line.split(" | ", 1))
        add(label, "spdx", name, SPDX_FORM)
    for line in SPDX.strip().splitlines():
        label, name = (x.strip() for x in line.split(" | ", 1))
        add(label, "licen", name, FIELD_FORM)
    for listed, forms in ((CLAUSES, [CLAUSE_FORM]), (FAMILIES, FORMS), (SHORT, [SHORT_FORM, FIELD_FORM])):
        for line in listed.strip().splitlines():
            label, keyword, name = (x.strip() for x in line.split(" | ", 2))
            add(label, keyword, name, *forms)
    return out


def _whole(pattern: str) -> str:
    """The pattern between spaces."""
    return f"(?<= ){pattern}(?= )"


def _places(words: Column, phrase: str) -> Column:
    """The starts of a phrase's words standing consecutively."""
    parts = phrase.split()
    n = F.size(words)

    def here(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + k) == part)
        return test

    return F.when(n >= len(parts), F.filter(F.sequence(F.lit(0), n - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def _rule_array() -> Column:
    """The rules by keyword and name, in order: keyword, name, and the rules under them."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    groups: dict[tuple[str, str], list[str]] = {}
    for i, label, priority, confidence, keyword, name, pattern in rules():
        groups.setdefault((keyword, name), []).append(f"struct({i} AS rule, {quote(label)} AS label, {priority} AS priority, {confidence}D AS confidence, {quote(pattern)} AS pattern)")
    return F.expr("array(" + ", ".join(f"struct({quote(k)} AS keyword, {quote(n)} AS name, array({', '.join(r)}) AS rules)" for (k, n), r in groups.items()) + ")")


_DETECTION = "struct<start:int,size:int,priority:int,rule:int,label:string,confidence:double>"


def _detections(line: Column, rule: Column) -> Column:
    """Each match of one rule: start and size in characters of the word line, both signed so that detections sort by what covers what."""
    found = F.regexp_extract_all(line, rule["pattern"], F.lit(0))
    between = F.split(line, rule["pattern"], -1)
    # one fold carries the place along: what was before, and the matches so far
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, x: F.struct(F.length(x).alias("skip"), F.length(m).alias("size")))

    def step(at: Column, x: Column) -> Column:
        start = at["end"] + x["skip"]
        one = F.struct(start.alias("start"), (-x["size"]).alias("size"), (-rule["priority"]).alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))
        return F.struct((start + x["size"]).alias("end"), F.concat(at["all"], F.array(one)).alias("all"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{_DETECTION}>").alias("all")), step, lambda at: at["all"])


def _uncovered(found: Column) -> Column:
    """The detections that none covers: of higher priority, or of the same and longer, or equal and of an earlier rule.

    In order of start, then length, priority and rule, whatever covers a detection comes before it and
    reaches its end, so the furthest end of each priority so far decides.
    """
    most = max(p for _, _, p, *_ in rules())

    def step(at: Column, d: Column) -> Column:
        end, priority = d["start"] - d["size"], -d["priority"]
        covered = F.array_max(F.slice(at["ends"], priority, most)) >= end
        ends = F.transform(at["ends"], lambda e, i: F.when(i + 1 == priority, F.greatest(e, end)).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(covered, at["kept"]).otherwise(F.concat(at["kept"], F.array(d))).alias("kept"))

    start = F.struct(F.array_repeat(F.lit(-1), most).alias("ends"), F.array().cast(f"array<{_DETECTION}>").alias("kept"))
    kept = F.aggregate(F.sort_array(found), start, step, lambda at: at["kept"])
    return F.transform(kept, lambda d: F.struct(d["rule"].alias("rule"), d["label"].alias("label"), (-d["priority"]).alias("priority"), d["confidence"].alias("confidence"), d["start"].alias("start"), (-d["size"]).alias("size")))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score, and the kept detections.

    A null or empty text has no words: n_words and n_base 0, first_word and last_word null, empty
    label strings, score 0. Ties between equal intervals of equal priority go to the earlier rule.
    Repeated rows give repeated results, and an empty table none. A column of ``keep`` that is named
    like a result gives way to it; other columns are ignored.
    """
    keep = without(keep, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    carried, keep = keep, ("_row",)
    base = docs.select(F.struct(*(F.col(f"`{k}`") for k in carried)).alias("_row") if carried else F.lit(None).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    low = F.lower(F.col("_text"))
    gate = F.lit(False)
    for k in KEYWORDS:
        first, *rest = k.split()
        gate = gate | low.contains(first) if not rest else gate | (low.contains(first) & low.contains(rest[-1]))
    gate = gate | (low.contains("cc") & F.col("_text").rlike(r"(?i)cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*(by|0|zero)"))
    apart = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    gate = gate | (low.contains("under") & low.rlike(f"under{apart}(?:the{apart}|a{apart})?(?:[23]{apart}clause|mit|isc|[me]pl|asl|cddl|zlib|x11|ncsa|postgresql|sil|ofl|eupl|odbl|afl|osl|upl|psf|artistic|ms{apart}pl)"))
    gate = gate | ((low.contains("mpl") | low.contains("epl")) & low.rlike(f"[me]pl(?:{apart})?(?:v|version)?(?:{apart})?[12]"))
    base = base.withColumn("_gate", gate)
    n_words = F.regexp_count("_text", F.lit(WORDS))
    words = F.when(F.col("_gate"), F.regexp_extract_all(ascii_lower(F.col("_text")), F.lit(WORDS), F.lit(0)))
    base = base.select(*keep, "_gate", n_words.cast("long").alias("n_words"), words.alias("_words"))
    base = base.withColumn("_line", F.when(F.col("_gate"), F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))))
    for i, phrase in enumerate(BASE):
        base = base.withColumn(f"_at{i}", F.when(F.col("_line").contains(f" {phrase} "), _places(F.col("_words"), phrase)))
    places = F.flatten(F.array(*(F.coalesce(F.col(f"_at{i}"), F.array().cast("array<int>")) for i in range(len(BASE)))))
    base = base.withColumn("_places", places)
    usable = F.filter(_rule_array(), lambda r: F.col("_line").contains(r["keyword"]) & F.rlike("_line", r["name"]))
    every = F.when(F.col("_gate"), F.flatten(F.transform(F.flatten(F.transform(usable, lambda r: r["rules"])), lambda r: _detections(F.col("_line"), r))))
    base = base.withColumn("_every", every)
    base = base.withColumn("_kept", F.coalesce(_uncovered(F.col("_every")), F.array().cast("array<struct<rule:int,label:string,priority:int,confidence:double,start:int,size:int>>")))
    base_labels = F.array(*(F.when(F.size(F.coalesce(F.col(f"_at{i}"), F.array().cast("array<int>"))) > 0, F.lit(label)) for i, label in enumerate(BASE.values())))
    base = base.withColumn("_base", F.array_compact(base_labels))
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.transform("_kept", lambda d: d["label"]))))
    score = F.greatest(F.when(F.size("_base") > 0, 0.95).otherwise(0.0), F.coalesce(F.array_max(F.transform("_kept", lambda d: d["confidence"])), F.lit(0.0)))
    return base.select(
        *(F.col("_row")[k].alias(k) for k in carried),
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        F.col("_kept").alias("detections"),
    )
