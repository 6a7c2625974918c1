"""Signature rules of the license scan.

A rule is a regular expression over *words*: tokens separated by one space,
each token a regex for one word or a bracket of alternative word runs, a
trailing ``?`` marking it optional (``apache license (version|v)? v?2 0?``). ``FAMILIES`` holds the hand-written names
of each license; three forms are derived from each (tag, grant, name), and
``NOTICES`` adds wording that names no license. Order is priority: an earlier
rule wins where intervals contain one another.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# label | SPDX id, as words | names, separated by " ; "
FAMILIES = r"""
mit | mit | the? mit license ; mit style license ; expat license
mit-0 | mit 0 | mit no attribution license?
x11 | x11 | x11 license ; mit x11 license
isc | isc | isc license ; internet systems consortium license
apache-1 | apache 1 [01] | apache (software)? license (version|v)? v?1( [01])?
apache-1.1 | apache 1 1 | apache software? license (version|v)? v?1 1
apache-2 | apache 2 0 | apache software? license (version|v)? v?2 0? ; apache 2 0? license ; asl 2 0
bsd-2-clause | bsd 2 clause( freebsd)? | simplified bsd license ; freebsd license ; bsd 2 clause license? ; two clause bsd license
bsd-3-clause | bsd 3 clause( clear)? | (new|revised|modified) bsd license ; bsd 3 clause license? ; three clause bsd license
bsd-4-clause | bsd 4 clause | original bsd license ; bsd 4 clause license? ; four clause bsd license
bsd-0-clause | 0bsd | zero clause bsd license? ; 0bsd license?
bsd | bsd | (berkeley|the)? bsd style? license
gpl-1 | gpl 1 0( only| or later)? | gnu? gpl (version|v)? v?1( 0)?
gpl-2 | gpl 2 0( only| or later)? | gnu? gpl (version|v)? v?2( 0)? ; gnu? gplv2
gpl-3 | gpl 3 0( only| or later)? | gnu? gpl (version|v)? v?3( 0)? ; gnu? gplv3
gpl-1 | gnu gpl 1 | (gnu)? general public license (version|v)? v?1( 0)?
gpl-2 | gnu gpl 2 | (gnu)? general public license (version|v)? v?2( 0)?
gpl-3 | gnu gpl 3 | (gnu)? general public license (version|v)? v?3( 0)?
lgpl-2 | lgpl 2 0( only| or later)? | (gnu)? (lesser|library) general public license (version|v)? v?2( 0)?
lgpl-2.1 | lgpl 2 1( only| or later)? | (gnu)? (lesser|library) general public license (version|v)? v?2 1
lgpl-3 | lgpl 3 0( only| or later)? | (gnu)? (lesser|library) general public license (version|v)? v?3( 0)?
lgpl-2.1 | gnu lgpl 2 1 | gnu? lgpl (version|v)? v?2 1 ; gnu? lgplv2 1
lgpl-3 | gnu lgpl 3 | gnu? lgpl (version|v)? v?3( 0)? ; gnu? lgplv3
agpl-1 | agpl 1 0( only| or later)? | affero general public license (version|v)? v?1( 0)?
agpl-3 | agpl 3 0( only| or later)? | (gnu)? affero general public license (version|v)? v?3( 0)?
agpl-3 | gnu agpl 3 | gnu? agpl (version|v)? v?3( 0)? ; gnu? agplv3
gfdl-1.1 | gfdl 1 1( only| or later)? | (gnu)? free documentation license (version|v)? v?1 1
gfdl-1.2 | gfdl 1 2( only| or later)? | (gnu)? free documentation license (version|v)? v?1 2
gfdl-1.3 | gfdl 1 3( only| or later)? | (gnu)? free documentation license (version|v)? v?1 3
mpl-1.0 | mpl 1 0 | mozilla public license (version|v)? v?1 0
mpl-1.1 | mpl 1 1 | mozilla public license (version|v)? v?1 1
mpl-2.0 | mpl 2 0( no copyleft exception)? | mozilla public license (version|v)? v?2( 0)?
epl-1.0 | epl 1 0 | eclipse public license (version|v)? v?1( 0)?
epl-2.0 | epl 2 0 | eclipse public license (version|v)? v?2( 0)?
edl-1.0 | edl 1 0 | eclipse distribution license (version|v)? v?1( 0)?
cddl-1.0 | cddl 1 0 | common development and distribution license (version|v)? v?1( 0)?
cddl-1.1 | cddl 1 1 | common development and distribution license (version|v)? v?1 1
cpl-1.0 | cpl 1 0 | common public license (version|v)? v?1( 0)?
cpal-1.0 | cpal 1 0 | common public attribution license (version|v)? v?1( 0)?
ipl-1.0 | ipl 1 0 | ibm public license (version|v)? v?1( 0)?
eupl-1.1 | eupl 1 1 | european union public licen[cs]e (version|v)? v?1 1
eupl-1.2 | eupl 1 2 | european union public licen[cs]e (version|v)? v?1 2
osl-3.0 | osl 3 0 | open software license (version|v)? v?3( 0)?
afl-3.0 | afl 3 0 | academic free license (version|v)? v?3( 0)?
ecl-2.0 | ecl 2 0 | educational community license (version|v)? v?2( 0)?
artistic-1.0 | artistic 1 0( perl| cl8)? | artistic license (version|v)? v?1( 0)?
artistic-2.0 | artistic 2 0 | artistic license (version|v)? v?2( 0)?
ms-pl | ms pl | microsoft public license
ms-rl | ms rl | microsoft reciprocal license
bsl-1.0 | bsl 1 0 | boost software license (version|v)? v?1? 0?
busl-1.1 | busl 1 1 | business source license (version|v)? v?1? 1?
sspl-1.0 | sspl 1 0 | server side public license (version|v)? v?1?
elastic-2.0 | elastic 2 0 | elastic license (version|v)? v?2? 0?
zlib | zlib | zlib license ; zlib libpng license
libpng-2.0 | libpng 2 0 | libpng license (version|v)? v?2?
openssl | openssl | openssl license
unlicense | unlicense | the unlicense ; unlicense license?
wtfpl | wtfpl | do what the fuck you want to public license (version|v)? v?2?
beerware | beerware | the beer ware license ; beer ware license revision 42
cc0-1.0 | cc0 1 0 | cc0 (1 0)? (universal)? ; cc zero
cc0-1.0 | creative commons 0 | creative commons zero (v1)? 1? 0? universal?
cc-by | cc by [1-4] [05] | cc by [1-4] [05]
cc-by-sa | cc by sa [1-4] [05] | cc by sa ([1-4] [05])?
cc-by-nd | cc by nd [1-4] [05] | cc by nd ([1-4] [05])?
cc-by-nc | cc by nc [1-4] [05] | cc by nc ([1-4] [05])?
cc-by-nc-sa | cc by nc sa [1-4] [05] | cc by nc sa ([1-4] [05])?
cc-by-nc-nd | cc by nc nd [1-4] [05] | cc by nc nd ([1-4] [05])?
cc-by | creative commons by | creative commons attribution (license|[1-4] [05]) (international|unported)?
cc-by-sa | creative commons by sa | creative commons attribution (share alike|sharealike) ([1-4] [05])?
cc-by-nd | creative commons by nd | creative commons attribution (no derivatives|noderivatives|noderivs) ([1-4] [05])?
cc-by-nc | creative commons by nc | creative commons attribution (non commercial|noncommercial) ([1-4] [05])?
cc-by-nc-sa | creative commons by nc sa | creative commons attribution (non commercial|noncommercial) (share alike|sharealike) ([1-4] [05])?
cc-by-nc-nd | creative commons by nc nd | creative commons attribution (non commercial|noncommercial) (no derivatives|noderivatives|noderivs) ([1-4] [05])?
odbl-1.0 | odbl 1 0 | open (data commons)? open? database license (version|v)? v?1?
odc-by-1.0 | odc by 1 0 | open data commons attribution license
pddl-1.0 | pddl 1 0 | open data commons public domain dedication
ofl-1.1 | ofl 1 1 | (sil)? open font license (version|v)? v?1? 1?
python-2.0 | python 2 0 | python software foundation license (version|v)? v?2? ; psf license
php-3.01 | php 3 01 | php license (version|v)? v?3( 01)?
ruby | ruby | ruby license
perl | perl 5 | same terms as perl itself
postgresql | postgresql | postgresql licen[cs]e
ncsa | ncsa | university of illinois ncsa open source license ; ncsa license
curl | curl | curl license
vim | vim | vim license
zpl-2.1 | zpl 2 1 | zope public license (version|v)? v?2( 1)?
w3c | w3c | w3c software (notice and)? license
unicode-dfs | unicode dfs 2016 | unicode license agreement
cecill-2.1 | cecill 2 1 | cecill free? software? license agreement? (version|v)? v?2?
upl-1.0 | upl 1 0 | universal permissive license (version|v)? v?1?
openrail | openrail | (open rail|openrail) m? license ; responsible ai license
json | json | json license
"""

# label | pattern
NOTICES = r"""
mit | permission is hereby granted free of charge to any person obtaining a copy
bsd | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | neither the name of \S+ nor the names of its contributors may be used to endorse
zlib | this software is provided as is without any express or implied warranty
isc | permission to use copy modify and or distribute this software for any purpose
json | the software shall be used for good not evil
unlicense | free and unencumbered software released into the public domain
gpl | gnu general public license
lgpl | gnu (lesser|library) general public license
agpl | gnu affero general public license
gpl | gnu? gpl license
apache | apache license
creative-commons | creative commons license
commons-clause | commons clause license? condition?
public-domain | (released|dedicated|placed) (in|into|to) the public domain
public-domain | in the public domain
all-rights-reserved | all rights reserved
proprietary | proprietary and confidential
proprietary | proprietary license
unknown-license | (licensed|released|distributed) under the? \S+ \S+? licen[cs]e
unknown-license | spdx license identifier \S+
"""

TAG = "spdx license identifier"
GRANT = "(licensed|released|distributed|available|published|provided) under (the)? (terms of the)?"

#: Base phrases of the contract: every place counts and the label always stays.
BASE = (
    ("mit", "the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)


@dataclass(frozen=True)
class Rule:
    rank: int  # 0 first; smaller wins
    label: str
    keywords: tuple[str, ...]
    pattern: str
    confidence: float
    base: bool = False


def _rows(table: str):
    for line in table.strip().splitlines():
        yield [part.strip() for part in line.split(" | ")]


def _tokens(pattern: str) -> list[str]:
    """Tokens of a pattern: words and brackets, with their ``?``."""
    out, depth, token = [], 0, ""
    for ch in pattern + " ":
        if ch == " " and depth == 0:
            out.append(token)
            token = ""
        else:
            depth += (ch == "(") - (ch == ")")
            token += ch
    return [t for t in out if t]


def _spread(pattern: str) -> str:
    return pattern.replace("( ", " (").replace("| ", "|")  # "1( 0)?" is "1 (0)?"


def gate(pattern: str) -> tuple[str, ...]:
    """Substrings of the text (words with one space between and around) that
    every match of the rule implies: its runs of neighbouring literal words
    that are not optional; of a word with a choice in it (``licen[cs]e``)
    the letters before the choice."""
    runs, run = [], " "
    for token in [*_tokens(_spread(pattern)), "()"]:
        literal = re.match(r"(?:[a-z0-9](?![?*]))*", token)[0]
        if literal == token:
            run += token + " "
            continue
        if literal and not token.endswith("?"):
            run += literal
        if run.strip():
            runs.append(run)
        run = " "
    return tuple(dict.fromkeys(runs))


def roots_of(rules: tuple[Rule, ...]) -> tuple[str, ...]:
    """Substrings of which every match of any rule has one: ``licen``, and for
    a rule that implies no earlier root its longest word (short rules first:
    ``gpl`` before ``gplv2``, a name before its grant)."""
    roots = ["licen"]
    for r in sorted(rules, key=lambda r: len("".join(r.keywords))):
        if not any(root in keyword for keyword in r.keywords for root in roots):
            word = max(reversed(" ".join(r.keywords).split()), key=len)
            roots.append(word if len(word) > 2 else r.keywords[0])
    return tuple(roots)


def compile_words(pattern: str) -> str:
    """Regex over the wrapped word form, in which each word stands between
    two spaces of its own; so neighbouring words share no character and a
    pattern of whole words needs no look-around."""

    def run(words: str) -> str:
        return "".join(map(one, _tokens(words)))

    def one(token: str) -> str:
        body = token[:-1] if token.endswith("?") else token
        if body.startswith("("):
            body = "(?:" + "|".join(run(option) for option in body[1:-1].split("|")) + ")"
        else:
            body = f" {body} "
        return f"(?:{body})?" if token.endswith("?") else body

    return run(_spread(pattern))


def build_rules() -> tuple[Rule, ...]:
    """All rules in priority order: tags, grants, names, notices."""
    tags, grants, names = [], [], []
    for label, ident, listed in _rows(FAMILIES):
        tags.append((label, gate(TAG), f"{TAG} {ident}", 1.0))  # one keyword for all tags
        for name in listed.split(" ; "):
            grants.append((label, gate(f"{GRANT} {name}"), f"{GRANT} {name}", 0.95))
            names.append((label, gate(name), name, 0.8))
    # longer wording first, so that the specific rule outranks the general one
    by_length = lambda row: -len(row[2].split())
    notices = [(label, gate(pattern), pattern, 0.6) for label, pattern in _rows(NOTICES)]
    ordered = sorted(tags, key=by_length) + sorted(grants, key=by_length) + sorted(names, key=by_length) + notices
    rules = [Rule(i, label, need, compile_words(p), conf) for i, (label, need, p, conf) in enumerate(ordered)]
    rules += [Rule(len(rules) + i, label, gate(p), compile_words(p), 0.9, True) for i, (label, p) in enumerate(BASE)]
    return tuple(rules)


RULES = build_rules()

#: A text without any of these meets no rule.
ROOTS = roots_of(RULES)
