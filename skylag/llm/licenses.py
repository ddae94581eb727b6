"""Licence scan by sentence rules (operator 2), in DataFrame operations only.

A text is cut into sentences, each is normalised (lower case, runs of other characters than a-z and 0-9 become one
space) and looked up among the known licence sentences. The identifiers found, in text order, form a sequence, in which
ordered rules are matched: leftmost first, and at one place the rule that stands first in ``RULES``. Between two sentences
of a rule at most ``MAX_GAP`` unknown sentences may lie. All of it happens inside the row: no shuffle, no join.

Null and empty texts hold no sentence and give no row. Repeated rows give repeated results, an empty table an empty
one, other columns are ignored. A line end inside a sentence (the next line goes on in lower case, or in capitals after
capitals or a comma, or with a word listed in ``CONTINUED``) does not end it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

MAX_GAP = 1

# Wording of public licence notices, each with one identifier per piece, as ``_pieces`` cuts it. Wordings that
# say the same share an identifier.
SENTENCES = [
    ("a", "Licensed under the Apache License, Version 2.0."),
    ("a", "This project is licensed under the Apache License, Version 2.0."),
    ("a", "Licensed under the Apache License 2.0."),
    ("a", "This project is licensed under the Apache License 2.0."),
    ("a", "Released under the Apache License, Version 2.0."),
    ("b", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("c", "you may not use this file except in compliance with the License."),
    ("d", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("d", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("u", "You may obtain a copy of the License at"),
    ("v", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("v", "https://www.apache.org/licenses/LICENSE-2.0"),
    ("e", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
          "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("f", "See the License for the specific language governing permissions and limitations under the License."),
    ("g", "Released under the MIT License."),
    ("g", "Licensed under the MIT License."),
    ("g", "This project is licensed under the MIT License."),
    ("g", "This software is released under the MIT License."),
    ("g", "Distributed under the MIT License."),
    ("h", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
          "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
          "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
          "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
          "conditions:"),
    ("i", "The above copyright notice and this permission notice shall be included in all copies or substantial "
          "portions of the Software."),
    ("j", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
          "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("k", "This work is licensed under the GNU General Public License, version 3."),
    ("k", "Licensed under the GNU General Public License, version 3."),
    ("0", "This work is licensed under the GNU General Public License, version 2."),
    ("0", "Licensed under the GNU General Public License, version 2."),
    ("A", "This program is free software;"),
    ("A", "This library is free software;"),
    ("A", "This software is free software;"),
    ("A", "This file is free software;"),
    ("o", "Licensed under CC BY-NC 4.0."),
    ("1", "Licensed under CC BY 4.0."),
    ("p", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("q", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("r", "All rights reserved."),
    ("s", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
          "the following conditions are met:"),
    ("D", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
          "following disclaimer."),
    ("E", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
          "following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("t", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission."),
    ("F", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
          "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
          "PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("G", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
          "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("G", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
          "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("2", "Licensed under the ISC License."),
    ("2", "Released under the ISC License."),
    ("HIJ", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
            "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("HIJ", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
            "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("3", "Licensed under the Mozilla Public License, version 2.0."),
    ("3", "Licensed under the Mozilla Public License 2.0."),
    ("S", "SPDX-License-Identifier:"),
]

# The notices of the GNU licences: (prefix of the rules, name, SPDX name, identifiers: of the grant that ends before the
# version, of "See the ... for more details.").
_GNU = [("gpl", "GNU General Public License", "GPL", "B", "n"), ("lgpl", "GNU Lesser General Public License", "LGPL", "C", "w"),
        ("lgpl_library", "GNU Library General Public License", "LGPL", "K", "x"),
        ("agpl", "GNU Affero General Public License", "AGPL", "L", "y")]
_VERSIONS = {"gpl": "23", "lgpl": ("2.1", "3"), "lgpl_library": "2", "agpl": "3"}
_GRANT = "you can redistribute it and/or modify it under the terms of the {}"
_LATER = ("or (at your option) any later version.", "or any later version.")
_ANY = "This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied " \
       "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
#: Identifiers of pieces that are numbered: letters that stand nowhere else in a sequence.
_NUMBERED = iter(map(chr, [*range(0xC0, 0xD7), *range(0x100, 0x180)]))
SENTENCES += [("mM", _ANY.format(what)) for what in ("program", "library", "software", "file")]

# Fixed values: (rule, licence, sequence of sentences), in order of preference.
RULES = [
    ("apache_header", "Apache-2.0", "bcdef"),
    ("apache_header", "Apache-2.0", "bcuvef"),
    ("mit_text", "MIT", "hij"),
    ("bsd_3", "BSD-3-Clause", "sDEt"),
    ("bsd_3", "BSD-3-Clause", "st"),
    ("bsd_2", "BSD-2-Clause", "sDEF"),
    ("bsd_start", "BSD (clauses unknown)", "s"),
    ("isc_text", "ISC", "G"),
    ("mpl_notice", "MPL-2.0", "HIJ"),
    ("apache_short", "Apache-2.0", "a"),
    ("apache_start", "Apache-2.0", "b"),
    ("mit_short", "MIT", "g"),
    ("mit_grant", "MIT", "h"),
    ("isc_short", "ISC", "2"),
    ("mpl_short", "MPL-2.0", "3"),
    ("gpl_short", "GPL-3.0-only", "k"),
    ("gpl_2_short", "GPL-2.0-only", "0"),
    ("cc_by_nc_short", "CC-BY-NC-4.0", "o"),
    ("cc_by_short", "CC-BY-4.0", "1"),
    ("cc_by_nc", "CC-BY-NC-4.0", "q"),
    ("cc_by", "CC-BY-4.0", "p"),
    ("all_rights", "all rights reserved", "r"),
]


def _gnu_notices() -> None:
    """Grants of the GNU licences: name and version in one piece, or in two where a semicolon parts them."""
    either, exactly, grants = {}, {}, []
    for version in ("2", "2.1", "3"):
        either[version], exactly[version] = next(_NUMBERED), next(_NUMBERED)
        SENTENCES.extend((either[version], f"either version {version} of the License, {later}") for later in _LATER)
        SENTENCES.extend((exactly[version], wording.format(version)) for wording in
                         ("version {} of the License.", "either version {} of the License."))
    for prefix, name, spdx, alone, details in _GNU:
        grant = _GRANT.format(name)
        SENTENCES.append((alone, f"{grant} as published by the Free Software Foundation;"))
        SENTENCES.append((details, f"See the {name} for more details."))
        for version in _VERSIONS[prefix]:
            later, only = next(_NUMBERED), next(_NUMBERED)
            number = version if "." in version else f"{version}.0"
            rule = prefix if version == "3" or prefix == "lgpl_library" else f"{prefix}_{version.replace('.', '_')}"
            SENTENCES.extend((later, f"{grant} as published by the Free Software Foundation, either version {version} of the "
                                     f"License, {words}") for words in _LATER)
            SENTENCES.extend([(only, f"{grant} as published by the Free Software Foundation, version {version} of the License."),
                              (only, f"{grant} version {version} as published by the Free Software Foundation."),
                              (only, f"{grant}, version {version}, as published by the Free Software Foundation.")])
            if prefix == "gpl" and version == "3":
                SENTENCES[:] = [("l" if codes == later else codes, text) for codes, text in SENTENCES]
                later = "l"
            for licence, kind, codes in ((f"{spdx}-{number}-or-later", "", (later, alone + either[version])),
                                         (f"{spdx}-{number}-only", "_only", (only, alone + exactly[version]))):
                grants += [(f"{rule}{kind}", licence, c, details) for c in codes]
    RULES[:0] = [(f"{rule}_notice", licence, f"{codes}mM{details}") for rule, licence, codes, details in grants]
    RULES.extend((f"{rule}_grant", licence, codes) for rule, licence, codes, _ in grants)


def _spdx_lines() -> None:
    """``SPDX-License-Identifier:`` and one name."""
    names = {n: n for n in ("MIT", "ISC", "Apache-2.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0")}
    for gnu, versions in (("GPL", ("2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("3.0",))):
        for v in versions:
            names |= {f"{gnu}-{v}-only": f"{gnu}-{v}-only", f"{gnu}-{v}-or-later": f"{gnu}-{v}-or-later", f"{gnu}-{v}": f"{gnu}-{v}-only"}
    codes: dict[str, str] = {}
    for name, licence in names.items():
        if licence not in codes:
            codes[licence] = next(_NUMBERED)
            RULES.append(("spdx", licence, "S" + codes[licence]))
        SENTENCES.append((codes[licence], name))


_gnu_notices()
_spdx_lines()

#: Line ends that do not end a sentence, sentence ends (both with the signs of comments at the start of lines), and what is
#: dropped when a sentence is normalised.
CONTINUED = ("([A-Za-z,;)\"])[ \t\r]*\n[ \t#*/%]*([a-z(]|(?:GNU|General Public|Lesser General|Library General|Affero General|Public License|"
             "License[ ,]|Free Software|Software Foundation|Foundation[ ,;.]|Apache License|Mozilla Public|MERCHANTABILITY|FITNESS|"
             "WITHOUT (?:ANY|WARRANT)|WARRANT|You can obtain))")
CONTINUED_CAPITALS = "([A-Z,;)\"])[ \t\r]*\n[ \t#*/%]*(\"?[A-Z][A-Z])"
ENDS, DROPPED = "([.!?:;])[ \t\r\n][ \t\r\n#*/%]*", "[^a-z0-9]+"
GAP = "/"


def _pieces(text: str) -> list[str]:
    """The same cuts in plain Python, for the known sentences only."""
    text = re.sub(CONTINUED_CAPITALS, r"\1 \2", re.sub(CONTINUED, r"\1 \2", text))
    return [re.sub(DROPPED, " ", x.lower()).strip() for x in re.sub(ENDS, "\\1\n", text).split("\n")]


def known_sentences() -> dict[str, str]:
    """Normalised piece to identifier, for every piece of every known sentence."""
    known: dict[str, str] = {}
    for codes, text in SENTENCES:
        pieces = _pieces(text)
        if len(pieces) != len(codes) or any(known.setdefault(p, c) != c for p, c in zip(pieces, codes)):
            raise ValueError(f"identifiers {codes} do not fit the pieces of: {text}")
    return known


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, in order."""
    joined = F.regexp_replace(F.regexp_replace(text, CONTINUED, "$1 $2"), CONTINUED_CAPITALS, "$1 $2")
    return F.transform(F.split(F.regexp_replace(joined, ENDS, "$1\n"), "\n"),
                       lambda s: F.trim(F.regexp_replace(F.lower(s), DROPPED, " ")))


def recognise(docs: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Per document with a known sentence: doc_id, ``found`` array of (at, code), ``sequence``.

    ``sequence`` holds the codes in order; ``/`` stands where more than ``max_gap`` unknown sentences lie between two.
    """
    known = known_sentences()
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    longest = max(map(len, known))
    # A sentence of another length than any known one is not normalised letter by letter.
    found = F.filter(
        F.transform(sentences(F.col("text")), lambda s, at: F.struct(
            at.alias("at"), F.when(F.length(s).between(1, longest), F.element_at(lookup, s)).alias("code"))),
        lambda x: x["code"].isNotNull())
    sequence = F.array_join(F.transform("found", lambda x, k: F.concat(
        F.when((k > 0) & (x["at"] - F.try_element_at(F.col("found"), F.when(k > 0, k).otherwise(1))["at"] > max_gap + 1), GAP)
        .otherwise(""), x["code"])), "")
    return (docs.select("doc_id", found.alias("found")).filter(F.size("found") > 0)
            .withColumn("sequence", sequence))


def scan(docs: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Per document with a licence: doc_id, ``rules`` and ``licences`` as matched in text order, ``sequence``."""
    pattern = "|".join(codes for _, _, codes in RULES)
    by_codes = lambda k: F.create_map(*[F.lit(x) for rule in RULES for x in (rule[2], rule[k])])
    matched = F.regexp_extract_all("sequence", F.lit(f"({pattern})"))
    return (recognise(docs, max_gap).withColumn("matched", matched).filter(F.size("matched") > 0)
            .select("doc_id", F.transform("matched", lambda m: F.element_at(by_codes(0), m)).alias("rules"),
                    F.transform("matched", lambda m: F.element_at(by_codes(1), m)).alias("licences"),
                    "sequence"))
