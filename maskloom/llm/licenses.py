"""Licence scans by sentence rules: known sentences get identifiers, ordered rules read identifier sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences in their published wording, by identifier.
SENTENCES = {
    "ApacheV2": "Licensed under the Apache License, Version 2.0",
    "ApacheV2Long": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "ApacheUse": "you may not use this file except in compliance with the License",
    "ApacheCopy": "You may obtain a copy of the License at",
    "ApacheAsIs": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "ApacheSee": "See the License for the specific language governing permissions and limitations under the License",
    "MitName": "Released under the MIT License",
    "MitNamed": "This project is licensed under the MIT License",
    "MitTitle": "The MIT License",
    "MitTitleBare": "MIT License",
    "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "MitAsIs": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "Gpl3Name": "This work is licensed under the GNU General Public License, version 3",
    "Gpl2Name": "This work is licensed under the GNU General Public License, version 2",
    "GplFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "Gpl2Free": "This program is free software",
    "Gpl2Terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "Gpl2Later": "either version 2 of the License, or (at your option) any later version",
    "GplHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "GplDetails": "See the GNU General Public License for more details",
    "LgplFree": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "BsdRedist": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BsdEndorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "Mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "CcByNc4": "Licensed under CC BY-NC 4.0",
    "CcBy4": "Licensed under CC BY 4.0",
    "CcBySa4": "Licensed under CC BY-SA 4.0",
    "CcByLong": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CcBySaLong": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CcByNcLong": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "Cc0": "This work is licensed under CC0 1.0",
    "SpdxApache": "SPDX-License-Identifier: Apache-2.0",
    "SpdxMit": "SPDX-License-Identifier: MIT",
    "SpdxGpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "AllRights": "All rights reserved",
    "Gpl2OnlyTerms": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "Gpl2Only": "version 2 of the License",
    "Gpl3OnlyFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License",
    "AgplFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "AgplDetails": "See the GNU Affero General Public License for more details",
    "LibFree": "This library is free software",
    "Lgpl21Later": "either version 2.1 of the License, or (at your option) any later version",
    "Lgpl3Free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "LgplHope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "LgplDetails": "See the GNU Lesser General Public License for more details",
    "Epl1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "Epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "ZlibAsIs": "This software is provided 'as-is', without any express or implied warranty",
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BoostShort": "Distributed under the Boost Software License, Version 1.0",
    "BoostGrant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "ArtisticTerms": "you can redistribute it and/or modify it under the terms of the Artistic License 2.0",
    "PerlTerms": "you can redistribute it and/or modify it under the same terms as Perl itself",
    "BsdAdvert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "SpdxGpl3Later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SpdxGpl2": "SPDX-License-Identifier: GPL-2.0-only",
    "SpdxGpl2Later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "SpdxLgpl21": "SPDX-License-Identifier: LGPL-2.1-only",
    "SpdxLgpl21Later": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "SpdxLgpl3Later": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "SpdxAgpl3": "SPDX-License-Identifier: AGPL-3.0-only",
    "SpdxAgpl3Later": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "SpdxBsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "SpdxBsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "SpdxIsc": "SPDX-License-Identifier: ISC",
    "SpdxMpl2": "SPDX-License-Identifier: MPL-2.0",
    "SpdxEpl2": "SPDX-License-Identifier: EPL-2.0",
    "SpdxUnlicense": "SPDX-License-Identifier: Unlicense",
    "SpdxZlib": "SPDX-License-Identifier: Zlib",
    "SpdxBoost": "SPDX-License-Identifier: BSL-1.0",
    "SpdxCc0": "SPDX-License-Identifier: CC0-1.0",
}
# Rules in order, the licence and the sequence of identifiers that shows it. Longer sequences come first.
RULES = [
    ("Apache-2.0", "ApacheV2Long ApacheUse ApacheCopy ApacheAsIs ApacheSee"),
    ("Apache-2.0", "ApacheV2Long ApacheUse"),
    ("MIT", "MitTitle MitGrant MitNotice MitAsIs"),
    ("MIT", "MitTitleBare MitGrant MitNotice MitAsIs"),
    ("MIT", "MitGrant MitNotice MitAsIs"),
    ("MIT-style", "MitGrant MitNotice"),
    ("GPL-3.0-or-later", "GplFree GplHope GplDetails"),
    ("GPL-3.0-or-later", "GplFree"),
    ("GPL-2.0-or-later", "Gpl2Free Gpl2Terms Gpl2Later GplHope GplDetails"),
    ("GPL-2.0-or-later", "Gpl2Free Gpl2Terms Gpl2Later"),
    ("GPL-2.0-only", "Gpl2Free Gpl2OnlyTerms"),
    ("GPL-2.0-only", "Gpl2Free Gpl2Terms Gpl2Only"),
    ("GPL-3.0-only", "Gpl3OnlyFree"),
    ("AGPL-3.0-or-later", "AgplFree GplHope AgplDetails"),
    ("AGPL-3.0-or-later", "AgplFree"),
    ("LGPL-3.0-or-later", "Lgpl3Free"),
    ("LGPL-2.1-or-later", "LibFree LgplFree Lgpl21Later"),
    ("LGPL-2.0-or-later", "LibFree LgplFree Gpl2Later"),
    ("LGPL", "Gpl2Free LgplFree"),
    ("LGPL", "LibFree LgplFree"),
    ("Artistic-2.0", "Gpl2Free ArtisticTerms"),
    ("Artistic-2.0", "LibFree ArtisticTerms"),
    ("Perl", "Gpl2Free PerlTerms"),
    ("Perl", "LibFree PerlTerms"),
    ("EPL-1.0", "Epl1"),
    ("EPL-2.0", "Epl2"),
    ("Unlicense", "Unlicense"),
    ("Zlib", "ZlibAsIs ZlibGrant"),
    ("BSL-1.0", "BoostGrant"),
    ("BSL-1.0", "BoostShort"),
    ("BSD-4-Clause", "BsdRedist BsdSource BsdBinary BsdAdvert BsdEndorse"),
    ("BSD-4-Clause", "BsdRedist BsdSource BsdBinary BsdAdvert"),
    ("BSD-3-Clause", "BsdRedist BsdSource BsdBinary BsdEndorse"),
    ("BSD-2-Clause", "BsdRedist BsdSource BsdBinary"),
    ("ISC", "IscGrant"),
    ("Apache-2.0", "ApacheV2"),
    ("Apache-2.0", "ApacheV2Long"),
    ("Apache-2.0", "SpdxApache"),
    ("MIT", "MitName"),
    ("MIT", "MitNamed"),
    ("MIT", "SpdxMit"),
    ("GPL-3.0", "Gpl3Name"),
    ("GPL-3.0", "SpdxGpl3"),
    ("GPL-2.0", "Gpl2Name"),
    ("MPL-2.0", "Mpl2"),
    ("CC-BY-NC-4.0", "CcByNc4"),
    ("CC-BY-NC-4.0", "CcByNcLong"),
    ("CC-BY-SA-4.0", "CcBySa4"),
    ("CC-BY-SA-4.0", "CcBySaLong"),
    ("CC-BY-4.0", "CcBy4"),
    ("CC-BY-4.0", "CcByLong"),
    ("CC0-1.0", "Cc0"),
    ("GPL-3.0-or-later", "SpdxGpl3Later"),
    ("GPL-2.0-only", "SpdxGpl2"),
    ("GPL-2.0-or-later", "SpdxGpl2Later"),
    ("LGPL-2.1-only", "SpdxLgpl21"),
    ("LGPL-2.1-or-later", "SpdxLgpl21Later"),
    ("LGPL-3.0-or-later", "SpdxLgpl3Later"),
    ("AGPL-3.0-only", "SpdxAgpl3"),
    ("AGPL-3.0-or-later", "SpdxAgpl3Later"),
    ("BSD-2-Clause", "SpdxBsd2"),
    ("BSD-3-Clause", "SpdxBsd3"),
    ("ISC", "SpdxIsc"),
    ("MPL-2.0", "SpdxMpl2"),
    ("EPL-2.0", "SpdxEpl2"),
    ("Unlicense", "SpdxUnlicense"),
    ("Zlib", "SpdxZlib"),
    ("BSL-1.0", "SpdxBoost"),
    ("CC0-1.0", "SpdxCc0"),
    ("Proprietary", "AllRights"),
]
#: Every known sentence has one of these, so texts and sentences without them need no closer look.
STEMS = ("licen", "permission", "warrant", "redistribut", "rights reserved", "free software", "version 2 of", "public domain", "advertising materials", "same terms as perl")
#: Sentences end at line feeds, or at signs that white space follows.
SPLIT = "[.!?;]+[ \t\r\n]+|\n+"
#: The signs alone: what is between them can hold known sentences that are wrapped over lines.
ENDS = "[.!?;]+[ \t\r\n]+"


def _parts(text: str) -> list[str]:
    """The normalised sentences of a known text that have a stem."""
    parts = [re.sub("[^a-z0-9]+", " ", p.lower()).strip() for p in re.split(SPLIT, text)]
    return [p for p in parts if any(s in p for s in STEMS)]


def _named(name: str, sentences: dict[str, str]) -> dict[str, str]:
    parts = _parts(sentences[name])
    if not parts:
        raise ValueError(f"no stem in {name}")
    return {p: name if len(parts) == 1 else f"{name}{i + 1}" for i, p in enumerate(parts)}


def known(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normalised sentence to identifier; a text that SPLIT parts stands in parts, under the identifier and a number."""
    return {p: x for name in sentences for p, x in _named(name, sentences).items()}


def sequence_of(rule: str, sentences: dict[str, str] = SENTENCES) -> str:
    """The identifiers of a rule as they follow each other in a text, each between bars."""
    return "".join(f"|{x}|" for name in rule.split() for x in _named(name, sentences).values())


def _has_stem(text: Column) -> Column:
    low = F.lower(text)
    out = F.contains(low, F.lit(STEMS[0]))
    for s in STEMS[1:]:
        out = out | F.contains(low, F.lit(s))
    return out


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _unwrapped(sentence: Column, names: list[str]) -> Column:
    """The lines of a text between two signs that end sentences, with each known sentence that is wrapped over lines put on one, normalised.

    Signs at the ends and starts of lines, as of comments, don't matter; empty lines part sentences. Lines of texts without such a sentence stay as they are.
    """
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    lines = F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), "[^a-z0-9\n]+", " "), " ?\n ?", "\n"))
    keys = F.array(*[F.lit(n) for n in sorted(names, key=len, reverse=True)])
    anywhere = lambda k: F.concat(F.lit("(?<![^\n])"), F.replace(k, F.lit(" "), F.lit("[ \n]")), F.lit("(?![^\n])"))
    held = lambda low: once(F.replace(low, F.lit("\n"), F.lit(" ")), lambda flat: F.filter(keys, lambda k: F.contains(flat, k)))
    joined = lambda low: F.aggregate(held(low), low, lambda acc, k: F.regexp_replace(acc, anywhere(k), k))
    plain = F.split(sentence, "\n+", -1)
    found = once(lines, lambda low: once(joined(low), lambda j: F.when(j != low, F.split(j, "\n+", -1)).otherwise(plain)))
    return F.when(F.contains(sentence, F.lit("\n")), found).otherwise(plain)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(id, n_known, n_unknown, sentence_ids, licenses): licences of every whole text, with DataFrame functions only.

    sentence_ids are the known sentences in order, joined by commas, also those wrapped over lines. Rules apply in their order; each one's sequences
    are taken out of the identifiers, so that no later rule reads them again, and name its licence. licenses are
    the names found, in the rules' order and each once, joined by commas. n_unknown counts
    sentences with a stem that are not known. Null and empty texts have none of these; repeated rows repeat; an
    empty table stays empty; other columns are left out.
    """
    names = known(sentences)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t"))
    some = F.filter(F.flatten(F.transform(F.split("t", ENDS, -1), lambda s: _unwrapped(s, list(names)))), _has_stem)
    df = df.select(id_col, F.when(_has_stem(F.col("t")), F.transform(some, lambda s: F.try_element_at(table, normalised(s)))).alias("found"))
    df = df.withColumn("names", F.coalesce(F.array_compact("found"), F.array().cast("array<string>")))
    steps = F.array(*[F.struct(F.lit(licence).alias("name"), F.lit(sequence_of(rule, sentences)).alias("seq")) for licence, rule in rules])
    start = F.struct(F.array_join(F.transform("names", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "").alias("seq"), F.array().cast("array<string>").alias("out"))
    read = F.aggregate(steps, start, lambda acc, r: F.when(F.contains(acc["seq"], r["seq"]), F.struct(F.replace(acc["seq"], r["seq"], F.lit("#")).alias("seq"), F.array_append(acc["out"], r["name"]).alias("out"))).otherwise(acc), lambda acc: F.array_join(F.array_distinct(acc["out"]), ","))
    return df.select(
        id_col,
        F.size("names").cast("long").alias("n_known"),
        (F.coalesce(F.size(F.filter("found", lambda x: x.isNull())), F.lit(0)).cast("long")).alias("n_unknown"),
        F.array_join("names", ",").alias("sentence_ids"),
        F.when(F.size("names") > 0, read).otherwise(F.lit("")).alias("licenses"),
    )
