"""Licences named in text, by built-in functions alone: ordered signature rules.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. One keyword regex,
made from what the rules need, gates a document; only gated ones are brought to a line of words on which rules work. There are
some hundreds of rules, each a regular expression written by hand with a keyword of its own that
must occur before it is tried: names of licences, which take what stands before them along (a
grant, a citation, a mention, or nothing, each with a priority of its own), and sentences of
licence texts and notices. Rules are ordered by priority; a match that lies within another of
equal or higher priority is suppressed, and of equal places and priorities the earlier rule stays.

Fixed phrases are found beside the rules: all places where their words stand consecutively.

Defined results: a null text counts as empty: no words, no places, no labels, score 0. Equal
rows give equal results. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chars, let
from .secret_scan import located

# The phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: What parts words, of a text and, with A-Z among it, of a lower-case one.
_APART = chars((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_SEP = f"[{chars((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))}]"
_LIC = "(?:license|licence)"


def _version(v: str) -> str:
    """A version as words: "2.0" is "2 0", "v2 0" or "version 2 0"; a final 0 may be missing."""
    major, _, minor = v.partition(".")
    tail = f" {minor}" if minor not in ("", "0") else "(?: 0)?"
    return rf"(?:version )?v?{major}{tail}"


def names() -> list[tuple[str, str, str]]:
    """(label, keyword, expression) of every licence."""
    out = [("mit", "mit", f"mit(?: open source)? {_LIC}"), ("isc", "isc", f"isc {_LIC}"), ("zlib", "zlib", f"zlib {_LIC}"), ("x11", "x11", f"x11 {_LIC}")]
    # GNU licences: initials or full name, with a version.
    for label, initials, full in (("gpl", "gpl", "general public"), ("lgpl", "lgpl", "(?:lesser|library) general public"), ("agpl", "agpl", "affero general public")):
        for v in {"gpl": ("1", "2", "3"), "lgpl": ("2", "2.1", "3"), "agpl": ("1", "3")}[label]:
            minor = v.replace(".", " ")
            out += [
                (f"{label}-{v}", initials, rf"(?:gnu )?{initials}(?: ?v ?| version | )?{minor}(?: 0)?(?: only| or later)?"),
                (f"{label}-{v}", "general public", rf"(?:gnu )?{full} {_LIC} (?:version )?v?{minor}(?: 0)?"),
            ]
        out.append((label, "general public", rf"(?:gnu )?{full} {_LIC}"))
    for n, words in ((2, "simplified|freebsd"), (3, "new|revised|modified"), (4, "original|old")):
        out += [(f"bsd-{n}", "bsd", rf"bsd {n} clause(?: {_LIC})?"), (f"bsd-{n}", "bsd", rf"(?:{n} clause|{words}) bsd(?: {_LIC})?")]
    out.append(("bsd", "bsd", f"bsd(?: style)? {_LIC}"))
    # Licences of a name and versions.
    for label, key, word, versions in (
        ("apache", "apache", "apache(?: software)?", ("1.0", "1.1", "2.0")), ("mpl", "mozilla public", "mozilla public", ("1.1", "2.0")), ("epl", "eclipse public", "eclipse public", ("1.0", "2.0")),
        ("cddl", "common development and distribution", "common development and distribution", ("1.0", "1.1")), ("artistic", "artistic", "artistic", ("1.0", "2.0")), ("eupl", "european union public", "european union public", ("1.1", "1.2")),
        ("ofl", "open font", "(?:sil )?open font", ("1.0", "1.1")), ("afl", "academic free", "academic free", ("2.1", "3.0")), ("osl", "open software", "open software", ("2.1", "3.0")), ("boost", "boost software", "boost software", ("1.0",)),
        ("php", "php", "php", ("3.0", "3.01")), ("zpl", "zope public", "zope public", ("2.0", "2.1")), ("ecl", "educational community", "educational community", ("1.0", "2.0")), ("upl", "universal permissive", "universal permissive", ("1.0",)),
        ("elastic", "elastic", "elastic", ("1.0", "2.0")), ("sspl", "server side public", "server side public", ("1.0",)), ("bsl", "business source", "business source", ("1.1",)), ("cpl", "common public", "common public", ("1.0",)),
        ("psf", "python software foundation", "python software foundation", ("2.0",)), ("lppl", "latex project public", "latex project public", ("1.3",)), ("odbl", "open", "open (?:data commons open )?database", ("1.0",)),
    ):
        for v in versions:
            out.append((f"{label}-{v.removesuffix('.0')}", key, rf"{word} {_LIC} {_version(v)}"))
        out.append((label, key, rf"{word} {_LIC}"))
    # Creative Commons: every combination of its elements, by initials and by name.
    short = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative|ativ)?(?:e)?s?(?: works)?"}
    for parts in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        label = "cc-" + "-".join(parts)
        out += [
            (label, "cc by", rf"(?:creative commons )?cc {' '.join(parts)}(?: {_LIC})?(?: [1-4] [05])?"),
            (label, "creative commons", rf"creative commons {' '.join(short[p] for p in parts)}(?: [1-4] [05])?(?: (?:international|unported))?(?: {_LIC})?"),
        ]
    out += [("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"), ("cc0", "creative commons zero", "creative commons zero")]
    for label, word in (("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("ncsa", f"ncsa(?: open source)? {_LIC}"), ("postgresql", f"postgresql {_LIC}"), ("openssl", f"openssl {_LIC}"), ("ruby", f"ruby {_LIC}"), ("vim", f"vim {_LIC}"), ("w3c", f"w3c(?: software)? {_LIC}"), ("ms-pl", f"microsoft public {_LIC}"), ("ms-rl", f"microsoft reciprocal {_LIC}"), ("unicode", f"unicode {_LIC}")):
        out.append((label, word.split("(")[0].split(" ")[0], word))
    return out


#: What may stand before a name: priority, confidence, expression; a lower priority number wins, and a bare name comes after them.
_OF = "(?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?"
PREFIXES = [
    (0, 1.0, f"(?:licensed|released|distributed|published|available|provided|used|redistributed) under {_OF}"),
    (0, 1.0, "spdx license identifier "),
    (1, 0.95, f"(?:subject to|governed by|covered by|according to) {_OF}"),
    (2, 0.9, f"under {_OF}"),
    (3, 0.8, "(?:license|licence|licensed|licences|licenses) "),
]
BARE = (4, 0.6)

#: Names that have neither versions nor other forms: label, keyword, expression.
MORE_NAMES = [
    ("gfdl", "free documentation", f"(?:gnu )?free documentation {_LIC}(?: version)?(?: 1 [123])?"), ("ftl", "freetype", f"freetype(?: project)? {_LIC}"), ("ijg", "independent jpeg", f"independent jpeg group(?: s)? {_LIC}"),
    ("libpng", "libpng", f"libpng {_LIC}"), ("curl", "curl", f"curl {_LIC}"), ("bzip2", "bzip2", f"bzip2 {_LIC}"), ("info-zip", "info zip", f"info zip {_LIC}"), ("icu", "icu", f"icu {_LIC}"), ("tcl", "tcl", f"tcl(?: tk)? {_LIC}"), ("beerware", "beerware", f"beerware(?: {_LIC})?"), ("beerware", "beer ware", f"beer ware(?: {_LIC})?"),
    ("json", "json", f"json {_LIC}"), ("hpnd", "historical permission", "historical permission notice and disclaimer"), ("oldap", "openldap", f"openldap public {_LIC}(?: (?:version )?v?2 8)?"), ("npl", "netscape public", f"netscape public {_LIC}(?: (?:version )?1 [01])?"),
    ("spl", "sun public", f"sun public {_LIC}"), ("ipl", "ibm public", f"ibm public {_LIC}"), ("qpl", "q public", f"q public {_LIC}"), ("sissl", "sun industry", f"sun industry standards source {_LIC}"), ("rpl", "reciprocal public", f"reciprocal public {_LIC}"), ("cpal", "public attribution", f"common public attribution {_LIC}"),
    ("apsl", "apple public", f"apple public source {_LIC}(?: (?:version )?[12](?: [0-2])?)?"), ("intel", "intel open", f"intel open source {_LIC}"), ("lpl", "lucent public", f"lucent public {_LIC}"), ("nokos", "nokia open", f"nokia open source {_LIC}"), ("watcom", "watcom", f"(?:sybase open )?watcom(?: public)? {_LIC}"),
    ("rpsl", "realnetworks", f"realnetworks public source {_LIC}"), ("vsl", "vovida", f"vovida software {_LIC}"), ("sleepycat", "sleepycat", f"sleepycat {_LIC}"), ("ngpl", "nethack", f"nethack general public {_LIC}"), ("naumen", "naumen", f"naumen public {_LIC}"), ("motosoto", "motosoto", f"motosoto {_LIC}"),
    ("frameworx", "frameworx", f"frameworx(?: open)? {_LIC}"), ("fair", "fair", f"fair {_LIC}"), ("efl", "eiffel forum", f"eiffel forum {_LIC}(?: 2)?"), ("entessa", "entessa", f"entessa public {_LIC}"), ("aal", "attribution assurance", f"attribution assurance {_LIC}"), ("apl", "adaptive public", f"adaptive public {_LIC}"),
    ("cua-opl", "cua office", f"cua office public {_LIC}"), ("catosl", "computer associates", f"computer associates trusted open source {_LIC}"), ("rscpl", "ricoh", f"ricoh source code public {_LIC}"), ("ogtsl", "open group", f"open group test suite {_LIC}"), ("nposl", "non profit open", f"non profit open software {_LIC}(?: 3 0)?"),
    ("simpl", "simple public", f"simple public {_LIC}"), ("ms-lpl", "microsoft limited", f"microsoft limited public {_LIC}"), ("ms-rsl", "microsoft reference", f"microsoft reference source {_LIC}"), ("odc-by", "open data commons", f"open data commons attribution {_LIC}"), ("pddl", "public domain dedication", f"public domain dedication (?:and )?{_LIC}"),
    ("cdla-permissive", "community data", f"community data {_LIC} agreement permissive(?: (?:version )?[12] 0)?"), ("cdla-sharing", "community data", f"community data {_LIC} agreement sharing(?: (?:version )?1 0)?"), ("ogl", "open government", f"open government {_LIC}(?: (?:version |v ?)?[123] 0)?"), ("etalab", "etalab", f"etalab open {_LIC}"),
    ("nlod", "open government data", f"norwegian {_LIC} for open government data"), ("cern-ohl", "cern open hardware", f"cern open hardware {_LIC}(?: (?:version )?[12](?: [0-2])?)?(?: (?:strongly reciprocal|weakly reciprocal|permissive))?"), ("tapr-ohl", "tapr", f"tapr open hardware {_LIC}"), ("solderpad", "solderpad", f"solderpad hardware {_LIC}"),
    ("mulan", "mulan", f"mulan (?:permissive software|public) {_LIC}(?: (?:version )?v?[12])?"), ("blueoak", "blue oak", f"blue oak model {_LIC}(?: 1 0 0)?"), ("hippocratic", "hippocratic", f"hippocratic {_LIC}(?: [123](?: [01])?)?"), ("commons-clause", "commons clause", f"commons clause(?: {_LIC})?"),
    ("polyform", "polyform", f"polyform (?:noncommercial|small business|shield|strict|internal use|free trial|perimeter) {_LIC}(?: 1 0 [01])?"), ("ccl", "confluent community", f"confluent community {_LIC}"), ("rsal", "redis source", f"redis source available {_LIC}(?: (?:version |v ?)?[12])?"), ("tsl", "timescale", f"timescale {_LIC}"),
    ("cockroach", "cockroach", f"cockroach(?:db)? community {_LIC}"), ("parity", "parity public", f"parity public {_LIC}(?: [67] 0 0)?"), ("prosperity", "prosperity public", f"prosperity public {_LIC}(?: [23] 0 0)?"), ("anti-996", "anti 996", f"anti 996 {_LIC}"), ("openrail", "openrail", f"(?:creativeml |bigscience |bigcode )?openrail(?: ?m)?(?: {_LIC})?"), ("openrail", "open rail", f"(?:creativeml |bigscience |bigcode )?open rail(?: m)?(?: {_LIC})?"),
    ("llama", "llama", f"llama (?:[234](?: [0-9])? )?community {_LIC}"), ("gemma", "gemma", "gemma terms of use"), ("apple-sample", "apple sample", f"apple sample code {_LIC}"), ("oracle-bcl", "oracle binary", f"oracle binary code {_LIC}"), ("oracle-otn", "oracle technology", f"oracle technology network {_LIC}"), ("amazon", "amazon software", f"amazon software {_LIC}"),
    ("unsplash", "unsplash", f"unsplash {_LIC}"), ("pexels", "pexels", f"pexels {_LIC}"), ("pixabay", "pixabay", f"pixabay {_LIC}"), ("ubuntu-font", "ubuntu font", f"ubuntu font {_LIC}"), ("bitstream-vera", "bitstream vera", f"bitstream vera(?: font)? {_LIC}"), ("gust-font", "gust font", f"gust font {_LIC}"), ("ipa-font", "ipa font", f"ipa font {_LIC}"),
    ("perl", "same terms as perl", "same terms as perl(?: itself)?"), ("mit-0", "mit no attribution", "mit no attribution"), ("0bsd", "zero clause", f"zero clause bsd(?: {_LIC})?"), ("bsl-1", "bsl", "bsl 1 0"), ("cecill", "cecill", f"cecill(?: [bc])?(?: {_LIC})?(?: 2 [01])?"), ("ecos", "ecos", f"ecos {_LIC}"),
]

_ANY = lambda n: rf"(?:[^ ]+ ){{0,{n}}}?"
#: Sentences of licence texts and notices, and statements of rights: priority, confidence, label, keyword, expression.
SENTENCES = [
    (0, 1.0, "mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (1, 0.9, "mit", "this permission notice", "(?:the above copyright notice and )?this permission notice shall be included in all copies or substantial portions of the software"),
    (0, 1.0, "boost-1", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (0, 1.0, "isc", "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice)?"),
    (1, 0.9, "hpnd", "permission to use", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted"),
    (0, 1.0, "bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    (0, 1.0, "bsd-3", "neither the name", f"neither the name of {_ANY(12)}nor the names of {_ANY(3)}contributors may be used to endorse or promote products derived from this software"),
    (0, 1.0, "bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (0, 1.0, "apache-2", "apache org", "you may obtain a copy of the license at https? www apache org licenses license 2 0"), (1, 0.95, "apache-2", "apache org", "apache org licenses license 2 0"),
    (2, 0.8, "apache", "in compliance with the license", "you may not use this file except in compliance with the license"), (1, 0.9, "apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    (0, 1.0, "gpl", "general public license", "you can redistribute it and or modify it under the terms of (?:version [23] of )?the gnu general public license"),
    (0, 1.0, "lgpl", "general public license", "you can redistribute it and or modify it under the terms of (?:version [23] of )?the gnu (?:lesser|library) general public license"),
    (0, 1.0, "agpl", "affero general public license", "you can redistribute it and or modify it under the terms of (?:version [13] of )?the gnu affero general public license"),
    (0, 1.0, "gpl-2", "general public license", "gnu general public license as published by the free software foundation (?:either )?version 2"), (0, 1.0, "gpl-3", "general public license", "gnu general public license as published by the free software foundation (?:either )?version 3"),
    (0, 1.0, "lgpl-2.1", "general public license", "gnu lesser general public license as published by the free software foundation (?:either )?version 2 1"), (0, 1.0, "lgpl-3", "general public license", "gnu lesser general public license as published by the free software foundation (?:either )?version 3"),
    (0, 1.0, "lgpl-2", "library general public", "gnu library general public license as published by the free software foundation (?:either )?version 2"), (0, 1.0, "agpl-3", "affero general public", "gnu affero general public license as published by the free software foundation (?:either )?version 3"),
    (1, 0.9, "gpl", "general public license", "you should have received a copy of the gnu general public license"), (1, 0.9, "lgpl", "general public license", "you should have received a copy of the gnu (?:lesser|library) general public license"), (1, 0.9, "agpl", "affero general public", "you should have received a copy of the gnu affero general public license"),
    (1, 0.95, "gpl-2", "gnu org licenses", "gnu org licenses (?:old licenses )?gpl 2 0"), (1, 0.95, "gpl-3", "gnu org licenses", "gnu org licenses gpl 3 0"), (1, 0.95, "lgpl-2.1", "gnu org licenses", "gnu org licenses (?:old licenses )?lgpl 2 1"), (1, 0.95, "lgpl-3", "gnu org licenses", "gnu org licenses lgpl 3 0"),
    (1, 0.95, "agpl-3", "gnu org licenses", "gnu org licenses agpl 3 0"), (1, 0.95, "gfdl", "gnu org licenses", "gnu org licenses fdl 1 [123]"), (1, 0.95, "gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (0, 1.0, "mpl-2", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"), (0, 1.0, "mpl-2", "copy of the mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"), (0, 1.0, "mpl-1.1", "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1"),
    (1, 0.95, "mpl-2", "mozilla org mpl", "mozilla org mpl 2 0"), (0, 1.0, "epl-1", "eclipse public license", "accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0"), (0, 1.0, "epl-2", "eclipse public license", "accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0"),
    (1, 0.95, "epl-1", "eclipse org", "eclipse org legal epl v10"), (1, 0.95, "epl-2", "eclipse org", "eclipse org legal epl (?:v20|2 0)"), (0, 1.0, "cddl", "common development and distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    (1, 0.9, "zlib", "held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"), (0, 1.0, "zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (0, 1.0, "zlib", "altered source", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"), (1, 0.95, "boost-1", "boost org", "boost org license 1 0"), (0, 1.0, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    (1, 0.9, "unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software"), (1, 0.95, "unlicense", "unlicense org", "unlicense org"), (0, 1.0, "wtfpl", "what the", "do what the f[^ ]* you want to public license"), (1, 0.9, "wtfpl", "what the", "you just do what the f[^ ]* you want to"),
    (0, 1.0, "cc0", "waived all copyright", f"to the extent possible under law {_ANY(12)}has waived all copyright and related or neighbou?ring rights to"), (1, 0.95, "cc0", "publicdomain zero", "creativecommons org publicdomain zero 1 0"), (1, 0.95, "public-domain", "publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    (1, 0.95, "cc-by", "creativecommons org", "creativecommons org licenses by [1-4] [05]"), (1, 0.95, "cc-by-sa", "creativecommons org", "creativecommons org licenses by sa [1-4] [05]"), (1, 0.95, "cc-by-nd", "creativecommons org", "creativecommons org licenses by nd [1-4] [05]"),
    (1, 0.95, "cc-by-nc", "creativecommons org", "creativecommons org licenses by nc [1-4] [05]"), (1, 0.95, "cc-by-nc-sa", "creativecommons org", "creativecommons org licenses by nc sa [1-4] [05]"), (1, 0.95, "cc-by-nc-nd", "creativecommons org", "creativecommons org licenses by nc nd [1-4] [05]"),
    (0, 1.0, "ofl", "this font software", "this font software is licensed under the sil open font license"), (1, 0.95, "ofl", "scripts sil org", "scripts sil org ofl"), (1, 0.8, "ofl", "reserved font name", "with reserved font names?"), (1, 0.95, "odbl", "opendatacommons org", "opendatacommons org licenses odbl"),
    (1, 0.95, "odc-by", "opendatacommons org", "opendatacommons org licenses by"), (1, 0.95, "pddl", "opendatacommons org", "opendatacommons org licenses pddl"), (1, 0.9, "openssl", "openssl project", "this product includes software developed by the openssl project"), (1, 0.9, "ssleay", "eric young", "this product includes cryptographic software written by eric young"),
    (1, 0.9, "php", "php software", "this product includes php software freely available from"), (1, 0.9, "x11", "x consortium", "the name of the x consortium shall not be used in advertising"), (1, 0.95, "json", "used for good", "the software shall be used for good not evil"), (1, 0.95, "beerware", "buy me a beer", "you can buy me a beer in return"),
    (1, 0.9, "ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group"), (1, 0.9, "ftl", "freetype project", f"portions of this software are copyright {_ANY(6)}the freetype project"), (1, 0.9, "ncsa", "to deal with the software", f"obtaining a copy of this software {_ANY(6)}to deal with the software without restriction"),
    (1, 0.95, "mit", "opensource org", "opensource org licenses mit"), (1, 0.95, "apache-2", "opensource org", "opensource org licenses apache 2 0"), (1, 0.95, "bsd-3", "opensource org", "opensource org licenses bsd 3 clause"), (1, 0.95, "bsd-2", "opensource org", "opensource org licenses bsd 2 clause"), (1, 0.95, "isc", "opensource org", "opensource org licenses isc"),
    (1, 0.95, "gpl-3", "opensource org", "opensource org licenses gpl 3 0"), (1, 0.95, "gpl-2", "opensource org", "opensource org licenses gpl 2 0"), (1, 0.95, "artistic-2", "opensource org", "opensource org licenses artistic license 2 0"), (1, 0.95, "zlib", "opensource org", "opensource org licenses zlib"),
    (5, 0.5, "public-domain", "public domain", "(?:in|into|to) the public domain"), (5, 0.5, "public-domain", "public domain", "public domain (?:work|dedication|mark|software)"), (5, 0.5, "public-domain", "no rights reserved", "no rights reserved"), (5, 0.5, "proprietary", "all rights reserved", "all rights reserved"),
    (5, 0.5, "proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)"), (5, 0.5, "proprietary", "unauthorized", f"unauthorized (?:copying|reproduction|use|distribution|duplication) {_ANY(10)}(?:is|are) (?:strictly )?prohibited"), (5, 0.5, "proprietary", "may be reproduced", f"no part of this {_ANY(3)}may be reproduced"),
    (5, 0.5, "proprietary", "may not be", "may not be (?:reproduced|copied|distributed|republished) (?:in whole or in part )?without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)"), (5, 0.5, "eula", "end user", f"end user {_LIC} agreement"), (5, 0.4, "shareware", "shareware", "this (?:program|software) is shareware"),
    (6, 0.2, "unknown", "under", f"(?:licensed|released|distributed) under [^ ]+(?: [^ ]+){{0,5}}? {_LIC}"),
]


def named() -> list[tuple[str, str, str]]:
    """(label, keyword, expression) of all names."""
    return names() + MORE_NAMES


def rules() -> list[dict]:
    """All rules: label, keyword, pattern over a line of words, and the priority and confidence of a match whose first group is empty.

    A name's first group is what stands before it; a sentence's is always empty.
    """
    before = "|".join(p for _, _, p in PREFIXES)
    out = [{"prio": BARE[0], "conf": BARE[1], "label": label, "key": key, "pattern": f" ((?:{before})?){name}(?= )"} for label, key, name in named()]
    return out + [{"prio": p, "conf": c, "label": label, "key": key, "pattern": f" (){text}(?= )"} for p, c, label, key, text in SENTENCES]


def gate() -> str:
    """A regular expression that the lower case of every text with a match of a rule or a phrase fits.

    What a rule needs is the word licence, where a name has it other than as an option, or else its keyword.
    The needed words begin words, and common beginnings are tried once.
    """
    needed = [("license" if _LIC in name.replace(f"(?: {_LIC})?", "") else key) for _, key, name in named()]
    needed += ["license" if _LIC in text else key for _, _, _, key, text in SENTENCES]
    needed += [phrase for phrase, _ in PHRASES]
    tree: dict = {}
    for x in ["license", "licence", "unlicense", *(x for x in needed if not re.search("licen[sc]e", x))]:
        node = tree
        for c in x:
            node = node.setdefault(c, {})
        node[""] = {}

    def written_out(node: dict) -> str:
        if "" in node:
            return ""
        each = [(f"[{_APART}]+" if c == " " else c) + written_out(more) for c, more in sorted(node.items())]
        return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"

    return f"(?<![a-z0-9])(?=[{''.join(sorted(tree))}]){written_out(tree)}"


#: Texts whose lower case does not fit this name no licence.
GATE = gate()


def line_of_words(text: Column) -> Column:
    """The words of a text in lower case (A-Z alone), each after a blank, and a blank."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, f"{_SEP}+", " ")), F.lit(" "))


FOUND = "array<struct<start:int,stop:int,prio:int,label:string,conf:double>>"
#: Matches that are gone over together.
BLOCK = 256


def matches(line: Column) -> Column:
    """array<struct<start, stop, prio, label, conf>>: the rules' matches that are not suppressed, by place."""
    groups: dict[str, list[dict]] = {}
    for i, r in enumerate(rules()):
        groups.setdefault(r.pop("key"), []).append(r | {"rule": i})
    kind = "array<struct<key:string,rules:array<struct<prio:int,conf:double,label:string,pattern:string,rule:int>>>>"
    table = F.from_json(F.lit(json.dumps([{"key": k, "rules": v} for k, v in groups.items()])), kind)

    def graded(r: Column, before: Column, column: int) -> Column:
        """The priority (0) or confidence (1) of a match, by what stands before the name."""
        out = r["prio"].cast("double") if column == 0 else r["conf"]
        for p in reversed(PREFIXES):
            out = F.when(before.rlike(f"^(?:{p[2]})$"), F.lit(float(p[column]))).otherwise(out)
        return F.when(before == "", r["prio"].cast("double") if column == 0 else r["conf"]).otherwise(out)

    def hits(text: Column, r: Column) -> Column:
        def one(s: Column) -> Column:
            grade = [graded(r, s["value"], k) for k in (0, 1)]
            return F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), grade[0].cast("int").alias("prio"), r["rule"].alias("rule"), r["label"].alias("label"), grade[1].alias("conf"))

        return F.transform(F.filter(located(text, r["pattern"], 1), lambda s: s["stop"] > s["start"]), one)

    def tried(text: Column) -> Column:
        near = F.flatten(F.transform(F.filter(table, lambda g: F.contains(text, g["key"])), lambda g: g["rules"]))
        fit = F.filter(near, lambda r: F.rlike(text, r["pattern"]))
        return F.array_sort(F.flatten(F.transform(fit, lambda r: hits(text, r))))  # by start, then the longest, then priority and rule

    return unsuppressed(let(line, tried))


def unsuppressed(found: Column) -> Column:
    """Of matches by start, the longest first, then priority and rule: those within none of equal or higher priority.

    A match that starts later, or is shorter, contains none; so the farthest end so far of each
    priority or a higher one decides, and what suppresses may itself be suppressed: its own
    suppressor contains both.
    """
    levels = range(max(r["prio"] for r in rules()) + 1)

    def within(p: int):
        return lambda h: h["prio"] <= p

    def farther(far: Column, block: Column) -> Column:
        ends = [F.array_max(F.transform(F.filter(block, within(p)), lambda h: -h["back"])) for p in levels]
        return F.array(*[F.greatest(far[p], e) for p, e in zip(levels, ends, strict=True)])

    def step(acc: Column, h: Column) -> Column:
        one = F.struct(h["start"].alias("start"), (-h["back"]).alias("stop"), h["prio"].alias("prio"), h["label"].alias("label"), h["conf"].alias("conf"))
        far = F.transform(acc["far"], lambda e, p: F.when(p >= h["prio"], F.greatest(e, -h["back"])).otherwise(e))
        return F.when(-h["back"] > F.element_at(acc["far"], h["prio"] + 1), F.struct(far.alias("far"), F.concat(acc["out"], F.array(one)).alias("out"))).otherwise(acc)

    none = F.array(*[F.lit(-1) for _ in levels])

    def blocks(hs: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(hs) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(hs, i + 1, F.lit(BLOCK)))
        first = F.struct(none.alias("far"), F.array().cast("array<array<int>>").alias("out"))

        def bases(bs: Column) -> Column:
            return F.aggregate(bs, first, lambda acc, b: F.struct(farther(acc["far"], b).alias("far"), F.concat(acc["out"], F.array(acc["far"])).alias("out")), lambda acc: acc["out"])

        def kept(b: Column, far: Column) -> Column:
            return F.aggregate(b, F.struct(far.alias("far"), F.array().cast(FOUND).alias("out")), step, lambda acc: acc["out"])

        return F.flatten(let(each, lambda bs: F.zip_with(bs, bases(bs), kept)))

    return let(found, blocks)


def phrase_places(line: Column, n_words: Column, phrase: str) -> dict[str, Column]:
    """Number of places of a phrase, and its first and last start, from the words between its places."""
    words = lambda part: F.char_length(part) - F.char_length(F.replace(part, F.lit(" "), F.lit("")))
    size = len(phrase.split())
    parts = F.split(line, f" {phrase}(?= )", -1)
    got = let(
        parts,
        lambda p: F.struct(
            (F.size(p) - 1).alias("n"),
            F.when(F.size(p) > 1, words(F.element_at(p, 1))).alias("first"),
            F.when(F.size(p) > 1, n_words - size - (words(F.element_at(p, -1)) - 1)).alias("last"),
        ),
    )
    return got


def licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, phrases, found): per phrase struct<n, first, last>, and the rules' matches, a row a row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = df.select(F.col(id_col).alias("id"), text.alias("t"))
    lined = thin.select("id", F.regexp_count("t", F.lit(f"[^{_APART}]+")).cast("long").alias("n_words"), F.when(F.lower("t").rlike(GATE), line_of_words(F.col("t"))).alias("line"))
    named = F.struct(*[phrase_places(F.col("line"), F.col("n_words"), p).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)])
    none = F.array().cast(FOUND)
    gated = F.col("line").isNotNull()
    out = lined.select("id", "n_words", F.when(gated, named).alias("phrases"), F.when(gated, matches(F.col("line"))).otherwise(none).alias("found"))
    return out.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of :func:`licenses`."""
    each = [F.col(f"phrases.p{i}") for i in range(len(PHRASES))]
    count = lambda p: F.coalesce(p["n"], F.lit(0))
    base = F.filter(F.array(*[F.when(count(p) > 0, F.lit(label)) for p, (_, label) in zip(each, PHRASES, strict=True)]), lambda x: x.isNotNull())
    labels = F.transform("found", lambda m: m["label"])
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    total = count(each[0])
    for p in each[1:]:
        total = total + count(p)
    score = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda m: m["conf"])), F.lit(0.0)), F.when(total > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return found.select(
        id_col, "n_words", total.cast("long").alias("n_base"), F.least(*[p["first"] for p in each]).cast("long").alias("first_word"), F.greatest(*[p["last"] for p in each]).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, labels)).alias("labels"), score.alias("score"),
    )
