"""The rule table of the license scan: hand-written signatures, in order of priority.

A rule is (label, keyword, pattern, confidence). Texts are lower-cased (A-Z) before they are matched, the
keyword (or one of several, parted by bars) must occur in the text before the pattern is tried, and the place in the table is the priority:
a detection inside one of an earlier rule is suppressed.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    confidence: float


#: Sentences that only the named license texts have.
BODY = (
    ("mit", "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy\s+of\s+this\s+software", 0.95),
    ("mit-0", "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, [^.]{0,400}substantial portions of the software\.\s+the software is provided \"as is\"", 0.6),
    ("isc", "permission to use, copy, modify", r"permission to use, copy, modify, and/or distribute this software for any\s+purpose with or without fee is hereby granted", 0.95),
    ("0bsd", "permission to use, copy, modify", r"permission to use, copy, modify, and/or distribute this software for any\s+purpose with or without fee is hereby granted\.\s+the software is provided", 0.7),
    ("hpnd", "permission to use, copy, modify", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose", 0.9),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display", 0.95),
    ("bsd-3-clause", "neither the name of", r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse", 0.95),
    ("bsd-2-clause", "redistribution and use in source and binary", r"redistribution and use in source and binary forms,? with or without\s+modification,? are permitted", 0.8),
    ("apache-2.0", "apache license", r"licensed under the apache license, version 2\.0 \(the \"license\"\)", 0.95),
    ("apache-2.0", "apache license", r"apache license\s+version 2\.0,? january 2004", 0.95),
    ("apache-1.1", "apache software license", r"the apache software license, version 1\.1", 0.95),
    ("gpl-3.0-or-later", "gnu general public license", r"gnu general public license as published by\s+the free software foundation,? either version 3 of the license,? or\s+\(at your option\) any later version", 0.95),
    ("gpl-2.0-or-later", "gnu general public license", r"gnu general public license as published by\s+the free software foundation;? either version 2 of the license,? or\s+\(at your option\) any later version", 0.95),
    ("lgpl-3.0-or-later", "gnu lesser general public license", r"gnu lesser general public license as published by\s+the free software foundation,? either version 3 of the license,? or\s+\(at your option\) any later version", 0.95),
    ("lgpl-2.1-or-later", "gnu lesser general public license", r"gnu lesser general public license as published by\s+the free software foundation;? either version 2\.1 of the license,? or\s+\(at your option\) any later version", 0.95),
    ("agpl-3.0-or-later", "gnu affero general public license", r"gnu affero general public license as published by\s+the free software foundation,? either version 3 of the license,? or\s+\(at your option\) any later version", 0.95),
    ("mpl-2.0", "mozilla public license", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0", 0.95),
    ("mpl-1.1", "mozilla public license", r"subject to the mozilla public license version 1\.1 \(the \"license\"\)", 0.95),
    ("epl-2.0", "eclipse public license", r"made available under the\s+terms of the eclipse public license 2\.0", 0.95),
    ("epl-1.0", "eclipse public license", r"made available under the\s+terms of the eclipse public license v1\.0", 0.95),
    ("cddl-1.0", "common development and distribution license", r"the terms of the common development and distribution license, version 1\.0", 0.95),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain", 0.95),
    ("wtfpl", "do what the fuck you want to", r"do what the fuck you want to public license", 0.95),
    ("zlib", "altered source versions must be", r"altered source versions must be plainly marked as such", 0.9),
    ("bsl-1.0", "boost software license", r"distributed under the boost software license, version 1\.0", 0.95),
    ("cc0-1.0", "dedicated all copyright", r"has dedicated all copyright and related and neighboring rights to this (?:work|software) to the public domain", 0.9),
    ("artistic-2.0", "artistic license", r"under the terms of the artistic license \(?2\.0\)?", 0.9),
    ("ofl-1.1", "sil open font license", r"this font software is licensed under the sil open font license, version 1\.1", 0.95),
    ("ruby", "same terms as ruby", r"under the same terms as ruby", 0.8),
    ("artistic-1.0-perl", "same terms as perl", r"under the same terms as perl(?: itself)?", 0.8),
    ("python-2.0", "python software foundation license", r"python software foundation license version 2", 0.95),
    ("all-rights-reserved", "all rights reserved", r"(?:copyright|\(c\)|©)[^\n]{0,120}all rights reserved", 0.7),
    ("all-rights-reserved", "all rights reserved", r"\ball rights reserved\b", 0.5),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary (?:information|to)", 0.8),
    ("proprietary", "may not be reproduced", r"may not be reproduced(?:,| or) (?:distributed|transmitted|copied)[^.]{0,80}without", 0.7),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain", 0.85),
    ("public-domain", "public domain", r"\bis in the public domain\b", 0.7),
    ("no-warranty", "without warranty of any kind", r"without warranty of any kind,? (?:either )?express(?:ed)? or implied", 0.3),
)

#: (label, names as patterns with their keyword, versions as patterns). Names are matched with word borders.
FAMILIES = (
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", (("3.0", r"3(?:\.0)?"), ("1.0", r"1(?:\.0)?"))),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e", (("3.0", r"3(?:\.0)?"), ("2.1", r"2\.1"))),
    ("lgpl", "library general public", r"(?:gnu )?library general public licen[sc]e", (("2.0", r"2(?:\.0)?"),)),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", (("3.0", r"3(?:\.0)?"), ("2.0", r"2(?:\.0)?"), ("1.0", r"1(?:\.0)?"))),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", (("1.3", r"1\.3"), ("1.2", r"1\.2"), ("1.1", r"1\.1"))),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", (("2.0", r"2(?:\.0)?"), ("1.1", r"1\.1"), ("1.0", r"1\.0"))),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", (("2.0", r"2(?:\.0)?"), ("1.1", r"1\.1"), ("1.0", r"1\.0"))),
    ("epl", "eclipse", r"eclipse public licen[sc]e", (("2.0", r"2(?:\.0)?"), ("1.0", r"1(?:\.0)?"))),
    ("cddl", "common development", r"common development and distribution licen[sc]e", (("1.1", r"1\.1"), ("1.0", r"1\.0"))),
    ("eupl", "european union", r"european union public licen[sc]e", (("1.2", r"1\.2"), ("1.1", r"1\.1"))),
    ("artistic", "artistic", r"artistic licen[sc]e", (("2.0", r"2\.0"), ("1.0", r"1\.0"))),
    ("bsl", "boost", r"boost software licen[sc]e", (("1.0", r"1(?:\.0)?"),)),
    ("busl", "business source", r"business source licen[sc]e", (("1.1", r"1\.1"),)),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", (("1.1", r"1\.1"), ("1.0", r"1\.0"))),
    ("osl", "open software", r"open software licen[sc]e", (("3.0", r"3\.0"), ("2.1", r"2\.1"))),
    ("afl", "academic free", r"academic free licen[sc]e", (("3.0", r"3\.0"), ("2.1", r"2\.1"))),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", ()),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", ()),
    ("cpl", "common public", r"common public licen[sc]e", (("1.0", r"1\.0"),)),
    ("ipl", "ibm public", r"ibm public licen[sc]e", (("1.0", r"1\.0"),)),
    ("qpl", "q public", r"\bq public licen[sc]e", (("1.0", r"1\.0"),)),
    ("lppl", "latex project", r"latex project public licen[sc]e", (("1.3c", r"1\.3c"), ("1.3", r"1\.3"))),
    ("odbl", "open database", r"open (?:data commons )?(?:open )?database licen[sc]e", (("1.0", r"1\.0"),)),
    ("odc-by", "open data commons attribution", r"open data commons attribution licen[sc]e", (("1.0", r"1\.0"),)),
    ("pddl", "public domain dedication and", r"public domain dedication and licen[sc]e", (("1.0", r"1\.0"),)),
    ("cecill", "cecill", r"\bcecill(?:-[bc])?(?: free software)? licen[sc]e", (("2.1", r"2\.1"), ("2.0", r"2(?:\.0)?"))),
    ("sspl", "server side public", r"server side public licen[sc]e", (("1.0", r"1(?:\.0)?"),)),
    ("elastic", "elastic license", r"\belastic licen[sc]e", (("2.0", r"2\.0"),)),
    ("php", "php license", r"\bphp licen[sc]e", (("3.01", r"3\.01"), ("3.0", r"3\.0"))),
    ("python", "python software foundation", r"python software foundation licen[sc]e", (("2.0", r"2(?:\.0)?"),)),
    ("postgresql", "postgresql", r"\bpostgresql licen[sc]e", ()),
    ("zlib", "zlib", r"\bzlib(?:/libpng)? licen[sc]e", ()),
    ("isc", "isc license", r"\bisc licen[sc]e", ()),
    ("mit", "mit licen", r"\bmit licen[sc]e", ()),
    ("mit", "expat licen", r"\bexpat licen[sc]e", ()),
    ("x11", "x11 licen", r"\bx11 licen[sc]e", ()),
    ("ncsa", "ncsa", r"university of illinois/ncsa(?: open source)? licen[sc]e", ()),
    ("bsd-3-clause", "bsd", r"\b(?:3-clause|new|modified|revised) bsd licen[sc]e", ()),
    ("bsd-3-clause", "bsd", r"\bbsd[ -]3[ -]clause", ()),
    ("bsd-2-clause", "bsd", r"\b(?:2-clause|simplified) bsd licen[sc]e", ()),
    ("bsd-2-clause", "bsd", r"\bbsd[ -]2[ -]clause", ()),
    ("bsd", "bsd", r"\bbsd(?:-style)? licen[sc]e", ()),
    ("unlicense", "unlicense", r"\bthe unlicen[sc]e\b", ()),
    ("vim", "vim license", r"\bvim licen[sc]e", ()),
    ("openssl", "openssl", r"\bopenssl licen[sc]e", ()),
    ("curl", "curl license", r"\bcurl licen[sc]e", ()),
    ("ruby", "ruby license", r"\bruby licen[sc]e", ()),
    ("json", "json license", r"\bjson licen[sc]e", ()),
    ("beerware", "beer-ware", r"\bbeer-ware licen[sc]e", ()),
    ("openrail", "openrail", r"\b(?:bigscience )?openrail(?:-m|\+\+)?(?: licen[sc]e)?", ()),
)

#: Creative Commons: condition codes with the words that spell them out.
CREATIVE = (
    ("by-nc-nd", r"attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?(?: works)?"),
    ("by-nc-sa", r"attribution[- ]non-?commercial[- ]share-?alike"),
    ("by-nd", r"attribution[- ]no-?deriv(?:ative)?s?(?: works)?"),
    ("by-sa", r"attribution[- ]share-?alike"),
    ("by-nc", r"attribution[- ]non-?commercial"),
    ("by", r"attribution"),
)
CREATIVE_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")

#: Identifiers of the SPDX tag line that are matched as they are.
SPDX = (
    "agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-1.0 artistic-2.0 bsd-2-clause bsd-3-clause "
    "bsd-4-clause bsl-1.0 busl-1.1 cc-by-4.0 cc-by-sa-4.0 cc-by-nc-4.0 cc0-1.0 cddl-1.0 epl-1.0 epl-2.0 eupl-1.2 "
    "gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later isc lgpl-2.1-only lgpl-2.1-or-later "
    "lgpl-3.0-only lgpl-3.0-or-later mit mit-0 mpl-1.1 mpl-2.0 ncsa ofl-1.1 postgresql unlicense wtfpl zlib 0bsd"
).split()

#: Addresses of license texts.
ADDRESSES = (
    ("apache-2.0", "apache.org/licenses", r"apache\.org/licenses/license-2\.0"),
    ("gpl-3.0", "gnu.org/licenses", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-2.0", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("lgpl-3.0", "gnu.org/licenses", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", "gnu.org/licenses", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl", "gnu.org/licenses", r"gnu\.org/licenses/fdl"),
    ("gpl", "gnu.org/licenses", r"gnu\.org/licenses/?(?:\s|$|[).,>])"),
    ("mit", "opensource.org/licenses", r"opensource\.org/licenses/mit\b"),
    ("bsd-3-clause", "opensource.org/licenses", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-2-clause", "opensource.org/licenses", r"opensource\.org/licenses/bsd-2-clause"),
    ("isc", "opensource.org/licenses", r"opensource\.org/licenses/isc\b"),
    ("mpl-2.0", "mozilla.org/mpl", r"mozilla\.org/mpl/2\.0"),
    ("cc0-1.0", "creativecommons.org/publicdomain", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("unlicense", "unlicense.org", r"\bunlicense\.org\b"),
)


def rule_table() -> list[Rule]:
    """All rules, the most specific first: tags, sentences, addresses, versions, names."""
    rules = [
        Rule(name, f"spdx-license-identifier: {name}", rf"spdx-license-identifier:\s*{name.replace('.', r'\.')}(?![\w.+-])", 0.99)
        for name in SPDX
    ]
    rules += [Rule(*row) for row in BODY]
    for code, _ in CREATIVE:
        rules += [
            Rule(f"cc-{code}-{v}", "creativecommons.org/licenses", rf"creativecommons\.org/licenses/{code}/{v.replace('.', r'\.')}", 0.97)
            for v in CREATIVE_VERSIONS
        ]
    rules += [Rule(label, key, pattern, 0.95) for label, key, pattern in ADDRESSES]
    border = r"(?![\w-])"
    for code, spelled in CREATIVE:
        short = rf"\bcc[ -]{code.replace('-', '[- ]')}"
        for v in CREATIVE_VERSIONS:
            number = v.replace(".", r"\.")
            rules.append(Rule(f"cc-{code}-{v}", "cc by|cc-by", rf"{short}[- ]{number}(?!\w)", 0.9))
            rules.append(Rule(f"cc-{code}-{v}", "creative commons", rf"creative commons {spelled}(?: licen[sc]e)? {number}", 0.9))
    for code, spelled in CREATIVE:
        rules.append(Rule(f"cc-{code}", "cc by|cc-by", rf"\bcc[ -]{code.replace('-', '[- ]')}{border}", 0.7))
        rules.append(Rule(f"cc-{code}", "creative commons", rf"creative commons {spelled}\b", 0.8))
    rules.append(Rule("cc0-1.0", "cc0", r"\bcc0(?:[ -]1\.0)?(?: universal)?\b", 0.85))
    for label, keyword, name, versions in FAMILIES:
        for version, number in versions:
            joint = r",?\s*\(?(?:version|v\.?)?\s*"
            rules.append(Rule(f"{label}-{version}-or-later", keyword, rf"{name}{joint}{number}\)?,?\s*(?:or|and) (?:\(at your option\) )?(?:any )?later", 0.93))
            rules.append(Rule(f"{label}-{version}", keyword, rf"{name}{joint}{number}(?![\w.]*\d)", 0.9))
    for label, keyword, name, _ in FAMILIES:
        rules.append(Rule(label, keyword, rf"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?{name}", 0.85))
        rules.append(Rule(label, keyword, name, 0.75))
    rules += [
        Rule("gpl", "gpl", r"\b(?:gnu )?gpl(?:[ -]?v?[23](?:\.0)?)?(?:\+)?\b", 0.6),
        Rule("unspecified", "licen", r"\b(?:licen[sc]ed|released|distributed) under (?:the )?[^.\n]{1,60}licen[sc]e", 0.4),
        Rule("unspecified", "see the license", r"\bsee the licen[sc]e(?: file)?\b", 0.3),
        Rule("copyright-notice", "copyright", r"\bcopyright (?:\(c\)|©)?\s*(?:19|20)\d\d", 0.3),
    ]
    return rules
