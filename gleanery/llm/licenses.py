"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, once at sentence ends with line breaks read as spaces, and once at line ends; a
sentence is normalised to lower-case ASCII letters and digits with single spaces. A sentence that equals a known
licence sentence stands for its identifier. The sequence of a text's identifiers, in order, is matched against
the rules in their order: a rule is a run of identifiers, names a licence, and takes what it matches from the
rules after it. A text has the licences that either cut finds.

Only texts that hold an anchor are cut. The anchors follow from the known sentences: each of them holds one, so no
other text can match.

Defined results: null and empty texts, and those without a known sentence, have no licences and count 0.
Everything happens within a row, so repeated rows get repeated results and nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to"
    " use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom"
    " the Software is furnished to do so, subject to the following conditions",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
    " of the Software",
    "mit_as_is": "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the"
    " warranties of merchantability, fitness for a particular purpose and noninfringement",
    "mit_liable": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether"
    " in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other"
    " dealings in the Software",
    "bsd_use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
    " following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission",
    "bsd_as_is": "This software is provided by the copyright holders and contributors as is and any express or implied warranties,"
    " including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache_file": "you may not use this file except in compliance with the License",
    "apache_terms": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3_or_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
    " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later"
    " version",
    "gpl_redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
    " the Free Software Foundation",
    "gpl2_or_later": "either version 2 of the License, or (at your option) any later version",
    "gpl_details": "See the GNU General Public License for more details",
    "gnu3_or_later": "either version 3 of the License, or (at your option) any later version",
    "lgpl3_or_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser"
    " General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
    " later version",
    "lgpl3_library": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser"
    " General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
    " later version",
    "lgpl_redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
    " published by the Free Software Foundation",
    "lgpl21_or_later": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl_details": "See the GNU Lesser General Public License for more details",
    "agpl3_or_later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero"
    " General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
    " later version",
    "agpl_redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as"
    " published by the Free Software Foundation",
    "agpl_details": "See the GNU Affero General Public License for more details",
    "mpl_subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl_file": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl_file_http": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to"
    " alter it and redistribute it freely, subject to the following restrictions",
    "free_domain": "This is free and unencumbered software released into the public domain",
}
# What a notice calls a licence, and its short identifier.
NAMES = {
    "the MIT License": "MIT",
    "the Apache License, Version 2.0": "Apache-2.0",
    "the GNU General Public License, version 2": "GPL-2.0",
    "the GNU General Public License, version 3": "GPL-3.0",
    "the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
    "the GNU Lesser General Public License, version 3": "LGPL-3.0",
    "the GNU Affero General Public License, version 3": "AGPL-3.0",
    "the Mozilla Public License, version 2.0": "MPL-2.0",
    "the Eclipse Public License, version 2.0": "EPL-2.0",
    "the BSD 2-Clause License": "BSD-2-Clause",
    "the BSD 3-Clause License": "BSD-3-Clause",
    "the ISC License": "ISC",
    "CC BY 4.0": "CC-BY-4.0",
    "CC BY-SA 4.0": "CC-BY-SA-4.0",
    "CC BY-NC 4.0": "CC-BY-NC-4.0",
    "CC BY-ND 4.0": "CC-BY-ND-4.0",
    "CC0 1.0": "CC0-1.0",
}
NOTICES = (
    "Licensed under {name}",
    "Licensed under {name} (the License)",
    "Released under {name}",
    "Distributed under {name}",
    "This work is licensed under {name}",
    "This software is licensed under {name}",
    "This project is licensed under {name}",
    "This file is licensed under {name}",
)
# Identifiers that a SPDX line can name besides those of ``NAMES``.
IDENTIFIERS = (
    *(f"{short}-{kind}" for short in NAMES.values() if "GPL" in short for kind in ("or-later", "only")),
    "Zlib",
    "Unlicense",
)
#: In order: the licence, and the run of identifiers that stands for it.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liable")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is")),
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("notice_Apache-2.0", "apache_file", "apache_terms")),
    ("Apache-2.0", ("apache_file", "apache_terms")),
    ("GPL-3.0-or-later", ("gpl3_or_later", "gpl_details")),
    ("GPL-3.0-or-later", ("gpl3_or_later",)),
    ("GPL-3.0-or-later", ("gpl_redistribute", "gnu3_or_later")),
    ("GPL-2.0-or-later", ("gpl_redistribute", "gpl2_or_later")),
    ("LGPL-3.0-or-later", ("lgpl3_or_later",)),
    ("LGPL-3.0-or-later", ("lgpl3_library",)),
    ("LGPL-3.0-or-later", ("lgpl_redistribute", "gnu3_or_later")),
    ("LGPL-2.1-or-later", ("lgpl_redistribute", "lgpl21_or_later")),
    ("AGPL-3.0-or-later", ("agpl3_or_later",)),
    ("AGPL-3.0-or-later", ("agpl_redistribute", "gnu3_or_later")),
    ("MPL-2.0", ("mpl_subject", "mpl_file")),
    ("MPL-2.0", ("mpl_subject", "mpl_file_http")),
    ("MPL-2.0", ("mpl_file",)),
    ("MPL-2.0", ("mpl_file_http",)),
    ("MPL-2.0", ("mpl_subject",)),
    ("ISC", ("isc_grant",)),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
    ("Unlicense", ("free_domain",)),
    *((short, (f"notice_{short}",)) for short in (*NAMES.values(), *IDENTIFIERS)),
)
#: anchors of most sentences; a sentence without one adds its longest word
STEMS = ("licens", "software", "copyright", "redistribut", "released")

_ENDS = r"[.!?;]+(?:\s|\z)|:\s*\n"
_ODD = r"[^a-z0-9\x01]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def dictionary() -> dict[str, str]:
    """Normalised sentence to identifier, about 200 of them."""
    known = {}
    for name, text in SENTENCES.items():
        # as a line, and up to the first place where a cut at sentence ends goes through it
        known[normalise(text)] = known[normalise(re.split(r"[.!?;]+\s", text)[0])] = name
    for name, short in NAMES.items():
        for notice in NOTICES:
            known[normalise(notice.format(name=name))] = f"notice_{short}"
    for short in (*NAMES.values(), *IDENTIFIERS):
        known[normalise(f"SPDX-License-Identifier: {short}")] = f"notice_{short}"
    return known


def anchors() -> tuple[str, ...]:
    """Words, or parts of them, of which every known sentence holds one."""
    found = list(STEMS)
    for sentence in dictionary():
        if not any(anchor in sentence for anchor in found):
            found.append(max(sentence.split(), key=len))
    return tuple(found)


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _identifiers(marked: Column) -> Column:
    """Identifiers of the known sentences of a text whose sentence ends are marked, as one string."""
    clean = F.regexp_replace(marked, _ODD, " ")
    known = F.create_map(*[F.lit(x) for pair in dictionary().items() for x in pair])
    found = F.transform(F.split(clean, "\x01"), lambda s: known[F.trim(s)])
    return F.concat(F.lit("|"), F.array_join(F.filter(found, lambda x: x.isNotNull()), "||"), F.lit("|"))


def _pattern(run: tuple[str, ...]) -> str:
    return "".join(f"|{name}|" for name in run)


def _matched(sequence: Column) -> Column:
    """Licences of a sequence, rule by rule; what a rule has matched is taken out."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_pattern(run)).alias("run")) for name, run in RULES])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("names"))
    step = lambda acc, rule: F.struct(
        F.replace(acc["rest"], rule["run"], F.lit("/")).alias("rest"),
        F.when(F.contains(acc["rest"], rule["run"]), F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names"),
    )
    return F.aggregate(rules, start, step, lambda acc: acc["names"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_sentences (known sentences of the cut that has more of them) and licenses (sorted, distinct) to rows."""
    lowered = _lowered(F.col(text))
    may = F.lit(False)
    for anchor in anchors():
        may = may | F.contains(lowered, F.lit(anchor))
    cuts = F.when(
        F.coalesce(may, F.lit(False)),
        F.array(
            _identifiers(F.regexp_replace(lowered, _ENDS, "\x01")),
            _identifiers(F.translate(lowered, "\n\r", "\x01\x01")),
        ),
    ).otherwise(F.array(F.lit("||")))
    # a generator keeps the optimizer from copying the cuts into every use
    with_cuts = docs.withColumn("__cuts", F.explode(F.array(cuts)))
    some = F.filter("__cuts", lambda c: c != "||")
    count = F.coalesce(F.array_max(F.transform(some, lambda c: F.size(F.split(F.substring(c, 2, 1 << 30), r"\|\|")))), F.lit(0))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(some, _matched))))
    return with_cuts.withColumns({"n_sentences": count.cast("long"), "licenses": names}).drop("__cuts")


def sql() -> str:
    """The scan of ``documents`` as SQL: doc_id, n_sentences and the licences as one string."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(name)})" for s, name in dictionary().items())
    steps, at = [], "rest0"
    for n, (_, run) in enumerate(RULES, 1):
        steps.append(f"r{n} as (select *, replace({at}, {quote(_pattern(run))}, '/') as rest{n} from {'seqs' if n == 1 else f'r{n - 1}'})")
        at = f"rest{n}"
    hits = ", ".join(f"case when contains(rest{n - 1}, {quote(_pattern(run))}) then {quote(name)} end" for n, (name, run) in enumerate(RULES, 1))
    return rf"""
with known(sentence, name) as (values {known}),
lowered as (select row_number() over () as n, doc_id, translate(text, '{_UPPER}', '{_LOWER}') as t from documents),
cuts as (
  select n, 1 as cut, string_split(regexp_replace(regexp_replace(t, '{_ENDS}', chr(1), 'g'), '[^a-z0-9\x01]+', ' ', 'g'), chr(1)) as parts from lowered
  union all
  select n, 2, string_split(regexp_replace(replace(replace(t, chr(10), chr(1)), chr(13), chr(1)), '[^a-z0-9\x01]+', ' ', 'g'), chr(1)) from lowered),
pieces as (select n, cut, unnest(parts) as part, generate_subscripts(parts, 1) as place from cuts),
seqs as (
  select n, cut, count(*) as found, '|' || string_agg(name, '||' order by place) || '|' as rest0
  from pieces join known on trim(part) = sentence group by n, cut),
{", ".join(steps)},
named as (select n, found, unnest([{hits}]) as name from r{len(RULES)}),
per_doc as (select n, max(found) as n_sentences, string_agg(distinct name, ',' order by name) as licenses from named group by n)
select doc_id, coalesce(n_sentences, 0)::bigint as n_sentences, coalesce(licenses, '') as licenses
from lowered left join per_doc using (n)
"""
