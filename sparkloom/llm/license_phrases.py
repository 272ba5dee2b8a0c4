"""Sentences of the full licence texts and notices, normalised, for license_scan."""

from __future__ import annotations

_REDISTRIBUTE = "redistribute it and or modify it under the terms of the gnu"
_FSF = "as published by the free software foundation"
_GNU = (
    ("GPL-2.0", "general public license", "2"), ("GPL-3.0", "general public license", "3"), ("LGPL-2.0", "lesser general public license", "2"),
    ("LGPL-2.1", "lesser general public license", "2 1"), ("LGPL-3.0", "lesser general public license", "3"), ("AGPL-3.0", "affero general public license", "3"),
)
_CC_PARTS = {
    "BY": ("attribution",), "BY-SA": ("attribution sharealike", "attribution share alike"), "BY-ND": ("attribution noderivatives", "attribution noderivs", "attribution no derivatives"),
    "BY-NC": ("attribution noncommercial", "attribution non commercial"), "BY-NC-SA": ("attribution noncommercial sharealike", "attribution non commercial share alike"),
    "BY-NC-ND": ("attribution noncommercial noderivatives", "attribution noncommercial noderivs", "attribution non commercial no derivatives"),
}
_CC_VERSIONS = {"4.0": ("4 0 international", "4 0"), "3.0": ("3 0 unported", "3 0", "3 0 united states"), "2.5": ("2 5 generic", "2 5"), "2.0": ("2 0 generic", "2 0")}


def _gnu() -> list[tuple[str, str]]:
    out = []
    for name, title, version in _GNU:
        for choice in ("either version", "version"):
            out.append((f"{name}-NOTICE", f"{_REDISTRIBUTE} {title} {_FSF} {choice} {version} of the license"))
        out.append((f"{name}-NOTICE", f"{_REDISTRIBUTE} {title} version {version} {_FSF}"))
    return out


def _cc() -> list[tuple[str, str]]:
    out = []
    for part, titles in _CC_PARTS.items():
        for version, spelled in _CC_VERSIONS.items():
            name = f"CC-{part}-{version}-NOTICE"
            out += [(name, f"licensed under {article} creative commons {t} {v} license") for article in ("a", "the") for t in titles for v in spelled]
            if (part, version) != ("BY-NC", "4.0"):  # a sentence of its own in SENTENCES
                out.append((name, f"licensed under cc {part.lower().replace('-', ' ')} {version.replace('.', ' ')}"))
    return out


#: (identifier, words in a row inside one sentence), in the order in which they stand in a licence.
PHRASES = (
    ("MIT_GRANT_TEXT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MIT_NOTICE", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MIT_NOTICE", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("MIT_AS_IS", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("ISC_GRANT", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC_GRANT", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC_AS_IS", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("BSD_PERMIT", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD_SOURCE", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD_BINARY", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSD_ADVERTISING", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSD_NEITHER", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD_AS_IS", "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("APACHE_HEADER", "under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("APACHE_GRANT", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    # A sentence ends after "v."
    ("MPL_FORM", "this source code form is subject to the terms of the mozilla public license v"),
    ("MPL_FORM", "this source code form is subject to the terms of the mozilla public license version 2 0"),
    ("MPL_COPY", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    *_gnu(),
    ("GPL-3.0-TEXT", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("GPL-2.0-TEXT", "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"),
    ("LGPL-2.1-TEXT", "this license the lesser general public license applies to some specially designated software packages"),
    ("LGPL-3.0-TEXT", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"),
    ("AGPL-3.0-TEXT", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    *_cc(),
)

#: Further rules, in the form of license_scan.RULES.
TEXT_RULES = (
    ("MIT", ("MIT_GRANT_TEXT", "MIT_NOTICE")),
    ("ISC", ("ISC_GRANT",)),
    ("BSD-2-Clause", ("BSD_PERMIT", "BSD_SOURCE", "BSD_BINARY", "BSD_AS_IS")),
    ("BSD-3-Clause", ("BSD_PERMIT", "BSD_SOURCE", "BSD_BINARY", "BSD_NEITHER", "BSD_AS_IS")),
    ("BSD-4-Clause", ("BSD_PERMIT", "BSD_SOURCE", "BSD_BINARY", "BSD_ADVERTISING", "BSD_NEITHER", "BSD_AS_IS")),
    ("Apache-2.0", ("APACHE_HEADER",)),
    ("Apache-2.0-header", ("APACHE_HEADER",)),
    ("Apache-2.0", ("APACHE_GRANT",)),
    ("MPL-2.0", ("MPL_FORM",)),
    *dict.fromkeys((n.removesuffix("-NOTICE").removesuffix("-TEXT"), (n,)) for n, _ in PHRASES if n.endswith(("-NOTICE", "-TEXT"))),
)

#: Each phrase has one of these words; a text without any of them needs no search.
WORDS = ("license", "permission", "redistribution", "software", "this file", "warranties")
