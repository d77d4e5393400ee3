"""License scan: ordered signature rules over the words of a text, gated by keywords, overlaps resolved.

A text becomes its lower-cased words with one space between. Rules come from hand-written families (names,
versions) and forms (SPDX line, grant, title, bare name), and from clauses of license texts, notices and terms of
use: a regex each, several hundred in all. A rule is run only on texts that hold its keyword. Detections are taken by priority, then length, then place; one that lies
inside an interval already taken is suppressed. Five fixed phrases are the base and always count.

The score is the confidence of the surest detection (0 without any). Null and empty texts have no words, no
labels and score 0; repeated rows and ids are scanned each on their own; texts are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from phantomlake.llm.common import id_text, raw

#: Fixed values of the query: phrase, label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
BASE_CONFIDENCE = 0.6

#: A-Z lower-cased, ASCII other than letters and digits to space.
WORDS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))

#: Label, keyword that must occur, names (regex over words), versions.
FAMILIES = (
    ("gpl", "general public", "gnu general public licen[sc]e", ("1", "2", "3")),
    ("gpl", "gpl", "gnu gpl|gpl", ("1", "2", "3")),
    ("lgpl", "lesser general", "gnu lesser general public licen[sc]e", ("2", "2 1", "3")),
    ("lgpl", "library general", "gnu library general public licen[sc]e", ("2",)),
    ("lgpl", "lgpl", "gnu lgpl|lgpl", ("2", "2 1", "3")),
    ("agpl", "affero", "gnu affero general public licen[sc]e|affero general public licen[sc]e", ("1", "3")),
    ("agpl", "agpl", "gnu agpl|agpl", ("3",)),
    ("gfdl", "free documentation", "gnu free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache (?:software )?licen[sc]e|asl", ("1 0", "1 1", "2 0")),
    ("mit", "mit", "mit licen[sc]e|mit x11 licen[sc]e|the mit licen[sc]e", ()),
    ("mit", "expat", "expat licen[sc]e", ()),
    ("x11", "x11", "x11 licen[sc]e", ()),
    ("bsd-2-clause", "bsd", "bsd 2 clause(?: licen[sc]e)?|simplified bsd licen[sc]e|freebsd licen[sc]e|2 clause bsd(?: licen[sc]e)?", ()),
    ("bsd-3-clause", "bsd", "bsd 3 clause(?: licen[sc]e)?|(?:new|revised|modified) bsd licen[sc]e|3 clause bsd(?: licen[sc]e)?", ()),
    ("bsd-4-clause", "bsd", "bsd 4 clause(?: licen[sc]e)?|original bsd licen[sc]e|4 clause bsd(?: licen[sc]e)?", ()),
    ("bsd", "bsd", "bsd licen[sc]e|bsd style licen[sc]e", ()),
    ("0bsd", "bsd", "0bsd|zero clause bsd(?: licen[sc]e)?", ()),
    ("isc", "isc", "isc licen[sc]e", ()),
    ("mpl", "mozilla", "mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public licen[sc]e", ("1 0", "2 0")),
    ("cddl", "common development", "common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("cpl", "common public", "common public licen[sc]e", ("1 0",)),
    ("eupl", "european union", "european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", "eupl", ("1 0", "1 1", "1 2")),
    ("cecill", "cecill", "cecill(?: [bc])?(?: licen[sc]e)?", ("1", "2", "2 1")),
    ("artistic", "artistic", "(?:perl )?artistic licen[sc]e", ("1 0", "2 0")),
    ("boost", "boost", "boost software licen[sc]e", ("1 0",)),
    ("zlib", "zlib", "zlib licen[sc]e|zlib libpng licen[sc]e", ()),
    ("wtfpl", "what the fuck", "do what the fuck you want to public licen[sc]e", ("1", "2")),
    ("wtfpl", "wtfpl", "wtfpl", ("1", "2")),
    ("unlicense", "unlicense", "(?:the )?unlicense", ()),
    ("cc0", "cc0", "cc0(?: public domain dedication)?", ("1 0",)),
    ("cc0", "zero", "creative commons zero", ("1 0",)),
    ("odbl", "open database", "open database licen[sc]e|open data commons open database licen[sc]e", ("1 0",)),
    ("odc-by", "open data commons", "open data commons attribution licen[sc]e", ("1 0",)),
    ("pddl", "public domain dedication", "public domain dedication and licen[sc]e", ("1 0",)),
    ("ofl", "open font", "(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
    ("psf", "python", "python software foundation licen[sc]e|python licen[sc]e", ("2", "2 0")),
    ("php", "php", "php licen[sc]e", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby licen[sc]e", ()),
    ("postgresql", "postgresql", "postgresql licen[sc]e", ()),
    ("ncsa", "illinois", "university of illinois ncsa open source licen[sc]e", ()),
    ("qpl", "public license", "q public licen[sc]e", ("1 0",)),
    ("vim", "vim", "vim licen[sc]e", ()),
    ("zpl", "zope", "zope public licen[sc]e", ("1 1", "2 0", "2 1")),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e", ()),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e", ()),
    ("osl", "open software", "open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", "academic free licen[sc]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("ecl", "educational community", "educational community licen[sc]e", ("1 0", "2 0")),
    ("upl", "universal permissive", "universal permissive licen[sc]e", ("1 0",)),
    ("mulan", "mulan", "mulan permissive software licen[sc]e|mulan psl", ("1", "2")),
    ("bsl", "business source", "business source licen[sc]e", ("1 0", "1 1")),
    ("sspl", "server side public", "server side public licen[sc]e", ("1",)),
    ("elastic", "elastic", "elastic licen[sc]e", ("1 0", "2 0")),
    ("ijg", "independent jpeg", "independent jpeg group licen[sc]e", ()),
    ("openssl", "openssl", "openssl licen[sc]e", ()),
    ("json", "json", "json licen[sc]e", ()),
    ("beerware", "beer", "beer ware licen[sc]e|beerware(?: licen[sc]e)?", ()),
)

#: Attribution kinds and versions of the Creative Commons licenses, and how each part is written out.
CC_KINDS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
CC_PARTS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative|atives|s)(?: works)?", "nc": "non ?commercial"}

#: Single statements: label, keyword, regex, confidence.
STATEMENTS = (
    ("public-domain", "public domain", "(?:is|are|in|into|to) the public domain", 0.7),
    ("proprietary", "all rights reserved", "all rights reserved", 0.5),
    ("proprietary", "unauthorized", "unauthori[sz]ed (?:copying|use|reproduction|distribution)", 0.7),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 0.95),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms", 0.9),
    ("gpl", "free software you can", "this program is free software you can redistribute it and or modify", 0.9),
    ("apache", "you may not use this file", "you may not use this file except in compliance with the license", 0.9),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such", 0.9),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 0.4),
)

#: Between one and eight words of any kind, such as a holder's name.
_ANY = "(?:[^ ]+ ){1,8}"

#: Clauses of license texts and notices, by label and confidence; each is gated by its longest literal run.
CLAUSES = (
    ("mit", 0.95, (
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
        "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    )),
    ("x11", 0.9, (f"except as contained in this notice the names? of {_ANY}shall not be used in advertising or otherwise to promote the sale",)),
    ("json", 0.95, ("the software shall be used for good not evil",)),
    ("isc", 0.9, ("the software is provided as is and the authors? disclaims? all warranties with regard to this software",)),
    ("0bsd", 0.95, ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided",)),
    ("hpnd", 0.9, ("permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and)?(?: is hereby granted)? without fee",)),
    ("postgresql", 0.95, ("for any purpose without fee and without a written agreement is hereby granted",)),
    ("ncsa", 0.95, ("to deal with the software without restriction including without limitation the rights to use",)),
    ("unicode", 0.95, ("to deal in the data files or software without restriction", "obtaining a copy of (?:the )?unicode data files")),
    ("upl", 0.95, ("to deal in both a the software and b any piece of software and or hardware listed in the",)),
    ("boost", 0.95, (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "solely in the form of machine executable object code generated by a source language processor",
    )),
    ("bsd", 0.85, (
        "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice",
        "this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) as is and any express or implied warranties",
    )),
    ("bsd-3-clause", 0.95, (f"neither the names? of {_ANY}nor the names of (?:its|their|any) contributors may be used to endorse or promote products",)),
    ("bsd-3-clause-clear", 0.95, ("no express or implied licenses to any party s patent rights are granted by this license",)),
    ("bsd-4-clause", 0.95, ("all advertising materials mentioning features or use of this software must display the following acknowledge?ment",)),
    ("apache-2.0", 0.95, (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "you must cause any modified files to carry prominent notices stating that you changed the files",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
    )),
    ("apache-1.1", 0.9, ("this product includes software developed by the apache (?:software foundation|group)", "products derived from this software may not be called apache")),
    ("gpl", 0.85, (
        "this program is distributed in the hope that it will be useful but without any warranty", "you should have received a copy of the gnu general public license along with",
        "does not permit incorporating your program into proprietary programs",
    )),
    ("gpl-1", 0.9, ("the license agreements of most software companies try to keep users at the mercy of those companies",)),
    ("gpl-2", 0.95, (
        "the licenses for most software are designed to take away your freedom to share and change it",
        "activities other than copying distribution and modification are not covered by this license they are outside its scope",
    )),
    ("gpl-3", 0.95, (
        "the gnu general public license is a free copyleft license for software and other kinds of works",
        "to convey a work means any kind of propagation that enables other parties to make or receive copies",
    )),
    ("gpl-classpath-exception", 0.95, ("give you permission to link this library with independent modules to produce an executable",)),
    ("gpl-font-exception", 0.95, ("if you create a document which uses this font and embed this font or unaltered portions of this font into the document",)),
    ("gcc-runtime-exception", 0.9, ("gcc runtime library exception",)),
    ("bison-exception", 0.95, ("you may create a larger work that contains part or all of the bison parser skeleton",)),
    ("linux-syscall-note", 0.95, ("does not cover user programs that use kernel services by normal system calls",)),
    ("agpl", 0.9, ("you should have received a copy of the gnu affero general public license along with",)),
    ("agpl-3", 0.95, (
        "specifically designed to ensure cooperation with the community in the case of network server software",
        "must prominently offer all users interacting with it remotely through a computer network",
    )),
    ("lgpl", 0.9, ("you should have received a copy of the gnu (?:lesser|library) general public license along with", "permits more lax criteria for linking other code with the library")),
    ("lgpl-3", 0.95, ("a combined work is a work produced by combining or linking an application with the library",)),
    ("gnu-text", 0.8, ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",)),
    ("gfdl", 0.95, (
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
        "with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts",
    )),
    ("mpl-2.0", 0.95, (
        "this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at",
        "this source code form is incompatible with secondary licenses",
    )),
    ("mpl-1.1", 0.95, ("the contents of this file are subject to the mozilla public license version 1 1",)),
    ("mpl", 0.8, ("covered (?:code|software) is provided under this license on an as is basis",)),
    ("epl", 0.95, (
        "the accompanying program is provided under the terms of this eclipse public license",
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
    )),
    ("cpl", 0.8, ("any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement",)),
    ("cddl", 0.95, ("the contents of this file are subject to the terms of the common development and distribution license", "include this cddl header notice in each file")),
    ("artistic-1.0", 0.95, (
        "the intent of this document is to state the conditions under which a package may be copied", "maintains some semblance of artistic control over the development of the package",
        "you may charge a reasonable copying fee for any distribution of this package",
    )),
    ("artistic-2.0", 0.95, ("this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",)),
    ("zlib", 0.95, (
        "in no event will the authors be held liable for any damages arising from the use of this software",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "this notice may not be removed or altered from any source distribution",
    )),
    ("unlicense", 0.95, (
        "this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest",
    )),
    ("cc0", 0.95, (
        f"to the extent possible under law {_ANY}waived all copyright and related or neighboring rights",
        "the person who associated a work with this deed has dedicated the work to the public domain",
    )),
    ("cc", 0.85, (
        "share copy and redistribute the material in any medium or format", "you must give appropriate credit provide a link to the license and indicate if changes were made",
        "you may not apply legal terms or technological measures that legally restrict others from doing anything the license permits",
        "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons",
    )),
    ("cc-commercial", 0.8, ("remix transform and build upon the material for any purpose even commercially",)),
    ("cc-nc", 0.9, ("you may not use the material for commercial purposes",)),
    ("cc-sa", 0.9, ("if you remix transform or build upon the material you must distribute your contributions under the same license as the original",)),
    ("cc-nd", 0.9, ("if you remix transform or build upon the material you may not distribute the modified material",)),
    ("cc-by", 0.85, (
        "lizenziert unter einer creative commons namensnennung", "bajo una licencia(?: de)? creative commons (?:reconocimiento|atribuci(?:ó|o)n)",
        "selon les termes de la licence creative commons (?:attribution|paternit(?:é|e))",
    )),
    ("wtfpl", 0.95, ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "you just do what the fuck you want to")),
    ("beerware", 0.95, ("as long as you retain this notice you can do whatever you want with this stuff", "you think this stuff is worth it you can buy me a beer in return")),
    ("ofl", 0.95, (
        "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects",
        "neither the font software nor any of its individual components in original or modified versions may be sold by itself",
    )),
    ("psf", 0.95, ("this license agreement is between the python software foundation psf and the individual or organization", "psf is making python available to licensee on an as is basis")),
    ("php", 0.95, ("this product includes php software freely available from", "products derived from this software may not be called php")),
    ("openssl", 0.95, ("this product includes software developed by the openssl project for use in the openssl toolkit",)),
    ("ssleay", 0.95, ("this product includes cryptographic software written by eric young",)),
    ("ruby", 0.9, ("you may make and give away verbatim copies of the source form of the software without restriction",)),
    ("w3c", 0.95, ("by obtaining(?: using and or)? copying this work you the licensee agree that you have read understood and will comply with",)),
    ("libpng", 0.95, ("the png reference library is supplied as is",)),
    ("ijg", 0.95, ("this software is based in part on the work of the independent jpeg group",)),
    ("freetype", 0.95, (f"portions of this software are copyright {_ANY}the freetype project",)),
    ("ms-pl", 0.85, ("if you use the software you accept this license if you do not accept the license do not use the software",)),
    ("osl", 0.9, ("this open software license the license applies to any original work of authorship",)),
    ("afl", 0.9, ("this academic free license the license applies to any original work of authorship",)),
    ("eupl", 0.95, ("this european union public licen[sc]e the eupl applies to the work", "licensed under the eupl")),
    ("cecill", 0.95, ("this software is governed by the cecill(?: [bc])? licen[sc]e under french law and abiding by the rules of distribution of free software",)),
    ("mulan", 0.95, ("you can use this software according to the terms and conditions of the mulan",)),
    ("lppl", 0.95, ("this work may be distributed and or modified under the conditions of the latex project public license",)),
    ("bsl", 0.95, ("the business source license this document or the license is not an open source license", "effective on the change date or the fourth anniversary of the first publicly available distribution")),
    ("sspl", 0.95, ("available to third parties as a service you must make the service source code available",)),
    ("elastic", 0.95, ("you may not provide the software to third parties as a hosted or managed service",)),
    ("commons-clause", 0.95, ("the license does not grant to you the right to sell the software",)),
    ("polyform", 0.95, ("to do everything you might do with the software that would otherwise infringe the licensor s copyright",)),
    ("openrail", 0.85, ("you agree not to use the model or derivatives of the model", "use based restrictions as referenced in")),
    ("llama", 0.9, (f"you will not use {_ANY}to improve any other large language model",)),
    ("odbl", 0.95, ("any rights in individual contents of the database are licensed under the database contents license",)),
    ("ogl", 0.95, ("contains public sector information licensed under the open government licen[sc]e", "you are free to copy publish distribute and transmit the information")),
    ("us-government", 0.85, (
        "prepared by an officer or employee of the united states government as part of that person s official duties", "is a work of the (?:u s|united states) government",
    )),
    ("gutenberg", 0.95, ("this ebook is for the use of anyone anywhere", "at no cost and with almost no restrictions whatsoever")),
    ("public-domain", 0.85, ("(?:has|have) been dedicated to the public domain", "no known copyright restrictions", "placed in the public domain by (?:its|the) authors?")),
    ("proprietary", 0.9, (
        "this software is licensed not sold", "(?:may|shall|must|agree) not(?: to)? reverse engineer decompile or disassemble", "this end user license agreement(?: eula)? is a legal agreement between you",
        "by installing copying or otherwise using (?:the|this) software you agree to be bound by", "confidential and proprietary information of", "unpublished proprietary source code",
        "use duplication or disclosure by the(?: u s)? government is subject to restrictions", "contains? trade secrets of",
    )),
    ("proprietary", 0.75, (
        "no part of this (?:publication|book|document|work|website|article) may be (?:reproduced|copied|stored|distributed|transmitted)",
        "may not be published broadcast rewritten or redistributed", "may not be reproduced without(?: the)?(?: express)?(?: prior)?(?: written)? (?:permission|consent)",
        "reproduction in whole or in part without(?: written)? permission is(?: strictly)? prohibited", "without the prior written (?:consent|permission) of the (?:publisher|author|copyright)",
        "tous droits r(?:é|e)serv(?:é|e)s", "reproduction(?: m(?:ê|e)me partielle)? interdite", "alle rechte vorbehalten", "nachdruck(?: auch auszugsweise)? verboten",
        "todos los derechos reservados", "prohibida (?:la|su) reproducci(?:ó|o)n",
    )),
    ("non-commercial", 0.8, ("for(?: your)? personal(?: and)? non ?commercial use only", "free for non ?commercial use", "any commercial use is(?: strictly)? (?:prohibited|forbidden)")),
    ("research-only", 0.8, ("for(?: academic| scientific)?(?: and| or)? research (?:use|purposes) only", "may only be used for(?: academic| scientific)? research")),
    ("evaluation-only", 0.8, ("for evaluation purposes only",)),
    ("no-ai-training", 0.9, (
        "for the purpose of training artificial intelligence technologies or systems", "may not be used (?:to train|for training|in the training of) (?:any )?(?:machine learning|artificial intelligence|ai|language)",
        "reserves? (?:the|all) rights? (?:of|to|for) text and data mining",
    )),
)

#: Licenses whose notices name the version after their publisher: label, name, versions.
PUBLISHED = (
    ("gpl", "gnu general public license", ("1", "2", "3")), ("lgpl", "gnu lesser general public license", ("2 1", "3")),
    ("lgpl", "gnu library general public license", ("2",)), ("agpl", "gnu affero general public license", ("3",)),
)

_GRANT = "(?:licensed|released|distributed|available|published|provided|covered) (?:only )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"


@dataclass(frozen=True)
class Rule:
    """One signature; a smaller priority is stronger."""

    label: str
    keyword: bytes
    pattern: str
    priority: int
    confidence: float


def family_rules(label: str, keyword: str, names: str, versions: tuple[str, ...]) -> list[Rule]:
    key, name, out = keyword.encode(), f"(?:{names})", []
    for v in versions:
        own = f"{label}-{v.replace(' ', '.')}"
        number = f"{v.removesuffix(' 0')}(?: 0)?" if " " not in v or v.endswith(" 0") else v
        tail = f"(?: ?v| version| licen[sc]e version)? ?{number}(?: or (?:any |at your option any )?later(?: version)?| only)?(?! [0-9])"
        out += [Rule(own, key, _GRANT + name + tail, 1, 0.95), Rule(own, key, name + tail, 2, 0.85)]
    return [*out, Rule(label, key, _GRANT + name, 3, 0.8), Rule(label, key, name, 4, 0.65)]


def longest_literal(pattern: str) -> str:
    """The longest run of characters that every match holds: groups, classes and what may be absent end a run."""
    plain = pattern
    while (shorter := re.sub(r"\((?:\?[:!])?[^()]*\)(?:\?|\{[0-9,]*\})?", "\0", plain)) != plain:
        plain = shorter
    return max(re.split("\0", re.sub(r"\[[^\]]*\][?*+]?|.[?*]", "\0", plain)), key=len).strip()


def clause_rules() -> list[Rule]:
    """Whole clauses are stronger than the names that stand in them."""
    out = [Rule(label, longest_literal(p).encode(), p, 1, sure) for label, sure, patterns in CLAUSES for p in patterns]
    for label, name, versions in PUBLISHED:
        for v in versions:
            pattern = f"{name} as published by the free software foundation(?: either)? version {v}(?! [0-9])"
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", name.encode(), pattern, 1, 0.95))
    return out


def all_rules() -> list[Rule]:
    out = [r for f in FAMILIES for r in family_rules(*f)]
    for kind in CC_KINDS:
        label = "cc-" + kind.replace(" ", "-")
        written = " ".join(CC_PARTS[x] for x in kind.split())
        out += family_rules(label, "cc", f"cc {kind}", CC_VERSIONS)
        out += family_rules(label, "creative commons", f"creative commons {written}(?: licen[sc]e| international| unported| public licen[sc]e)*", CC_VERSIONS)
    ids = {(f[0], v) for f in FAMILIES for v in (*f[3], "")} | {("cc-" + k.replace(" ", "-"), v) for k in CC_KINDS for v in CC_VERSIONS}
    for label, v in sorted(ids):
        name = label.replace("-", " ") + (f" {v}" if v else "")
        out.append(Rule(f"{label}-{v.replace(' ', '.')}" if v else label, b"spdx", f"spdx licen[sc]e identifier {name}(?: 0)?(?: only| or later)?(?! [0-9])", 0, 1.0))
    out += [Rule(label, key.encode(), pattern, 5, sure) for label, key, pattern, sure in STATEMENTS]
    return out + clause_rules()


class Scanner:
    """The compiled rules, grouped by keyword."""

    def __init__(self, rules: list[Rule] | None = None):
        self.by_keyword: dict[bytes, list[tuple[re.Pattern, Rule]]] = {}
        for rule in rules if rules is not None else all_rules():
            self.by_keyword.setdefault(rule.keyword, []).append((re.compile(f"(?<= )(?:{rule.pattern})(?= )".encode()), rule))
        # a word inside a keyword stands whole in every text that holds it, so most keywords need no search
        self.by_word: dict[bytes, list[bytes]] = {}
        self.searched: list[bytes] = []
        for key in self.by_keyword:
            inner = key.split(b" ")[1:-1]
            if any(inner):
                self.by_word.setdefault(max(inner, key=len), []).append(key)
            else:
                self.searched.append(key)
        self.phrases = [(f" {p} ".encode(), label) for p, label in PHRASES]

    def held(self, text: bytes) -> list[bytes]:
        """The keywords that stand in the spaced words."""
        likely = [key for word in self.by_word.keys() & set(text.split(b" ")) for key in self.by_word[word]]
        return [key for key in self.searched + likely if key in text]

    def detections(self, text: bytes) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) in characters of the spaced words, resolved and in order."""
        found = [(m.start(), m.end(), rule) for key in self.held(text) for pattern, rule in self.by_keyword[key] for m in pattern.finditer(text)]
        found.sort(key=lambda x: (x[2].priority, x[0], -x[1], x[2].label))
        kept: list[tuple[int, int, Rule]] = []
        starts: list[int] = []  # of the stronger detections, and how far those up to each start reach
        reach: list[int] = []
        for _, same in groupby(found, key=lambda x: x[2].priority):
            last = 0
            for start, end, rule in same:
                at = bisect_right(starts, start)
                if end > max(last, reach[at - 1] if at else 0):
                    kept.append((start, end, rule))
                    last = end
            kept.sort(key=lambda x: x[:2])
            starts, reach = [x[0] for x in kept], list(accumulate((x[1] for x in kept), max))
        return kept

    def base(self, text: bytes) -> list[tuple[int, str]]:
        """(word, label) of all places of the fixed phrases."""
        out: list[tuple[int, str]] = []
        for phrase, label in self.phrases:
            word, last, at = 0, 0, text.find(phrase)
            while at >= 0:
                word += text.count(b" ", last, at)
                out.append((word, label))
                last, at = at, text.find(phrase, at + 1)
        return out

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, int]:
        words = text.translate(WORDS).split()
        spaced = b" " + b" ".join(words) + b" " if words else b" "
        base, found = self.base(spaced), self.detections(spaced)
        labels = {x for _, x in base}
        places = [x for x, _ in base]
        sure = max([BASE_CONFIDENCE * bool(base), *(r.confidence for _, _, r in found)])
        return (
            len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {r.label for _, _, r in found})), float(sure), len(found),
        )


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"
_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in COLUMNS.split(", ")])
_SCANNER: list[Scanner] = []


def scan_licenses(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, the labels of base and rules, and the score."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rules is None and not _SCANNER:
            _SCANNER.append(Scanner())
        scanner = _SCANNER[0] if rules is None else Scanner(rules)
        for part in parts:
            rows = [scanner.scan(x) for x in raw(part.column("text"))]
            columns = list(zip(*rows, strict=True)) or [()] * (len(ARROW) - 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(columns, list(ARROW)[1:], strict=True))], schema=ARROW)

    return id_text(docs, id_col, text_col).mapInArrow(run, COLUMNS)
