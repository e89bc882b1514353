"""Licence signature rules: hand-written names, short forms and notice patterns.

All patterns are over normalised words: lower-case ASCII letters, digits and
non-ASCII characters, single spaces between. A pattern starts with a literal
word, its keyword; it is tried only where a text has that word, or one of the
words that :func:`joined` gives where the space after the keyword may be missing.
"""

from __future__ import annotations

import re
from itertools import product

# (label, short forms as in tags and manifests, names as in prose); "x( y)?" is a regular expression
LICENSES: list[tuple[str, list[str], list[str]]] = [
    ("gpl-1.0", ["gpl 1 0( only| or later)?"], ["gnu general public license( as published by the free software foundation)?( either)? v(ersion)? ?1( 0)?", "gpl ?v1"]),
    ("gpl-2.0", ["gpl 2 0( only| or later)?", "gpl ?v?2( only| or later)?"], ["gnu general public license( as published by the free software foundation)?( either)? v(ersion)? ?2( 0)?", "gpl ?v2"]),
    ("gpl-3.0", ["gpl 3 0( only| or later)?", "gpl ?v?3( only| or later)?"], ["gnu general public license( as published by the free software foundation)?( either)? v(ersion)? ?3( 0)?", "gpl ?v3"]),
    ("lgpl-2.1", ["lgpl 2 1( only| or later)?"], ["gnu lesser general public license v(ersion)? ?2 1", "lgpl ?v2 1"]),
    ("lgpl-3.0", ["lgpl 3 0( only| or later)?"], ["gnu lesser general public license v(ersion)? ?3( 0)?", "lgpl ?v3"]),
    ("lgpl-2.0", ["lgpl 2 0( only| or later)?"], ["gnu library general public license( v(ersion)? ?2( 0)?)?", "lgpl ?v2( 0)?"]),
    ("agpl-3.0", ["agpl 3 0( only| or later)?"], ["gnu affero general public license( v(ersion)? ?3( 0)?)?", "agpl ?v?3"]),
    ("gfdl", ["gfdl( 1 [123])?( only| or later)?"], ["gnu free documentation license( v(ersion)? ?1( [0-3])?)?"]),
    ("apache-2.0", ["apache 2 0", "apache2"], ["apache license v(ersion)? ?2( 0)?", "apache software license v(ersion)? ?2( 0)?", "apache 2 0 license"]),
    ("apache-1.1", ["apache 1 1"], ["apache (software )?license v(ersion)? ?1 1"]),
    ("apache-1.0", ["apache 1 0"], ["apache (software )?license v(ersion)? ?1 0"]),
    ("mit", ["mit"], ["mit license", "mit expat license", "expat license"]),
    ("mit-0", ["mit 0"], ["mit no attribution( license)?"]),
    ("x11", ["x11"], ["x11 license", "mit x11 license"]),
    ("isc", ["isc"], ["isc license"]),
    ("bsd-2-clause", ["bsd 2 clause"], ["bsd 2 clause( simplified)? license", "simplified bsd license", "freebsd license", "2 clause bsd license"]),
    ("bsd-3-clause", ["bsd 3 clause"], ["bsd 3 clause( new| revised)? license", "new bsd license", "modified bsd license", "3 clause bsd license"]),
    ("bsd-4-clause", ["bsd 4 clause"], ["bsd 4 clause license", "original bsd license", "4 clause bsd license"]),
    ("0bsd", ["0bsd"], ["zero clause bsd license", "bsd zero clause license"]),
    ("bsd", [], ["bsd license", "bsd style license", "berkeley software distribution license"]),
    ("mpl-1.1", ["mpl 1 1"], ["mozilla public license v(ersion)? ?1 1"]),
    ("mpl-2.0", ["mpl 2 0"], ["mozilla public license v(ersion)? ?2( 0)?", "mpl ?v2"]),
    ("epl-1.0", ["epl 1 0"], ["eclipse public license v(ersion)? ?1( 0)?"]),
    ("epl-2.0", ["epl 2 0"], ["eclipse public license v(ersion)? ?2( 0)?"]),
    ("cddl-1.0", ["cddl 1 0"], ["common development and distribution license( v(ersion)? ?1( 0)?)?"]),
    ("cpl-1.0", ["cpl 1 0"], ["common public license( v(ersion)? ?1( 0)?)?"]),
    ("eupl-1.2", ["eupl 1 2"], ["european union public licen[cs]e( v(ersion)? ?1 2)?"]),
    ("artistic-1.0", ["artistic 1 0"], ["artistic license v(ersion)? ?1( 0)?", "artistic license 1 0"]),
    ("artistic-2.0", ["artistic 2 0"], ["artistic license v(ersion)? ?2( 0)?", "artistic license 2 0"]),
    ("bsl-1.0", ["bsl 1 0"], ["boost software license( v(ersion)? ?1( 0)?)?"]),
    ("zlib", ["zlib"], ["zlib license", "zlib libpng license"]),
    ("unlicense", ["unlicense"], ["unlicense", "free and unencumbered software released into the public domain"]),
    ("wtfpl", ["wtfpl"], ["do what the fuck you want to public license"]),
    ("ofl-1.1", ["ofl 1 1"], ["sil open font license( v(ersion)? ?1( 1)?)?", "open font license v(ersion)? ?1 1"]),
    ("postgresql", ["postgresql"], ["postgresql license"]),
    ("python-2.0", ["python 2 0", "psf 2 0"], ["python software foundation license( v(ersion)? ?2)?", "psf license"]),
    ("php-3.01", ["php 3 0(1)?"], ["php license v(ersion)? ?3 0(1)?"]),
    ("ruby", ["ruby"], ["ruby license"]),
    ("ms-pl", ["ms pl"], ["microsoft public license"]),
    ("ms-rl", ["ms rl"], ["microsoft reciprocal license"]),
    ("osl-3.0", ["osl 3 0"], ["open software license( v(ersion)? ?3( 0)?)?"]),
    ("afl-3.0", ["afl 3 0"], ["academic free license( v(ersion)? ?3( 0)?)?"]),
    ("ecl-2.0", ["ecl 2 0"], ["educational community license( v(ersion)? ?2( 0)?)?"]),
    ("ncsa", ["ncsa"], ["university of illinois ncsa open source license", "ncsa open source license"]),
    ("openssl", ["openssl"], ["openssl license"]),
    ("odbl-1.0", ["odbl( 1 0)?"], ["open database license( v(ersion)? ?1( 0)?)?"]),
    ("odc-by-1.0", ["odc by( 1 0)?"], ["open data commons attribution license"]),
    ("pddl-1.0", ["pddl( 1 0)?"], ["public domain dedication and license"]),
    ("cc0-1.0", ["cc0( 1 0)?"], ["cc0 1 0( universal)?", "cc zero( 1 0)?", "creative commons zero( v(ersion)? ?1( 0)?)?"]),
    ("cc-by-4.0", ["cc by 4 0"], ["cc by 4 0( international)?", "creative commons attribution 4 0( international)?( public)? license"]),
    ("cc-by-3.0", ["cc by 3 0"], ["cc by 3 0( unported)?", "creative commons attribution 3 0( unported)? license"]),
    ("cc-by-2.0", ["cc by 2 [05]"], ["cc by 2 [05]( generic)?", "creative commons attribution 2 [05]( generic)? license"]),
    ("cc-by-sa-4.0", ["cc by sa 4 0"], ["cc by sa 4 0( international)?", "creative commons attribution share ?alike 4 0( international)?( public)? license"]),
    ("cc-by-sa-3.0", ["cc by sa 3 0"], ["cc by sa 3 0( unported)?", "creative commons attribution share ?alike 3 0( unported)? license"]),
    ("cc-by-nc-4.0", ["cc by nc 4 0"], ["cc by nc 4 0( international)?", "creative commons attribution non ?commercial 4 0( international)?( public)? license"]),
    ("cc-by-nc-sa-4.0", ["cc by nc sa 4 0"], ["cc by nc sa 4 0( international)?", "creative commons attribution non ?commercial share ?alike 4 0( international)? license"]),
    ("cc-by-nc-nd-4.0", ["cc by nc nd 4 0"], ["cc by nc nd 4 0( international)?", "creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)? license"]),
    ("cc-by-nd-4.0", ["cc by nd 4 0"], ["cc by nd 4 0( international)?", "creative commons attribution no ?deriv(ative)?s 4 0( international)? license"]),
    ("cc-by-sa", [], ["cc by sa", "creative commons attribution share ?alike"]),
    ("cc-by-nc", [], ["cc by nc", "creative commons attribution non ?commercial"]),
    ("cc-by-nd", [], ["cc by nd", "creative commons attribution no ?deriv(ative)?s"]),
    ("lgpl", ["lgpl"], ["gnu lesser general public license", "lgpl"]),
    ("agpl", ["agpl"], ["affero general public license", "agpl"]),
    ("mpl", ["mpl"], ["mozilla public license"]),
    ("epl", ["epl"], ["eclipse public license"]),
    ("public-domain", [], ["public domain", "dedicated to the public domain"]),
]

# notices that name no licence: (label, pattern)
NOTICES: list[tuple[str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "confidential and proprietary"),
]

# the phrases every scan reports place by place: (label, phrase)
BASE: list[tuple[str, str]] = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

GRANTS = ("licensed", "released", "distributed", "available", "provided", "published", "offered")
WINDOW = 32


def rules() -> list[tuple[str, str, str, int, float, bool]]:
    """(keyword, pattern, label, rank, confidence, base), best rank first.

    Ranks follow the kind of evidence (a tag, then a grant, a notice, a
    manifest field, a bare name, a base phrase) and, within a kind, the order above.
    """
    out: list[tuple[str, str, str, float, bool]] = []
    for label, short, names in LICENSES:
        forms = "|".join(short)
        if short:
            out.append(("spdx", f"spdx license identifier (?:{forms})", label, 1.0, False))
    for label, short, names in LICENSES:
        forms = "|".join([*names, *short])
        out += [(g, f"{g} under (?:the )?(?:terms of )?(?:the )?(?:{forms})", label, 0.95, False) for g in GRANTS]
    out += [(p.split(" ")[0], p, label, 0.9 if label != "proprietary" else 0.5, False) for label, p in NOTICES]
    for label, short, _ in LICENSES:
        if short:
            out += [(k, f"{k} (?:{'|'.join(short)})", label, 0.8, False) for k in ("license", "licence")]
    for label, _, names in LICENSES:
        out += [(n.split(" ")[0], n, label, 0.7, False) for n in names]
    out += [(p.split(" ")[0], p, label, 0.6, True) for label, p in BASE]
    return [(k, p, label, rank, conf, base) for rank, (k, p, label, conf, base) in enumerate(out)]


def joined(pattern: str) -> list[str]:
    """The first words of a match that has no space where the pattern's first one is optional: 'agpl ?v?3' gives agplv3 and agpl3."""
    m = re.match(r"([a-z0-9]+) \?((?:[a-z0-9]\??)+)", pattern)
    if not m:
        return []
    letters = [(c, "") if optional else (c,) for c, optional in re.findall(r"([a-z0-9])(\??)", m[2])]
    return [m[1] + "".join(t) for t in product(*letters)]
