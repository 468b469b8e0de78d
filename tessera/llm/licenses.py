"""Licence scans by sentence rules.

A text is cut into sentences; each is normalised to plain words, and its first words are looked up in a table of the openings of known licence
sentences, whose identifier it gets. The sequence of identifiers is then matched against ordered rules, longest first, and each match
names a licence. Identifiers that no rule takes leave "unmatched" in the result.

A sentence begins with a text, a line (behind comment signs) or behind a full stop, colon, semicolon, question or exclamation mark; it ends before the
next full stop, question or exclamation mark and at an empty line. A line's end doesn't end it, nor do a semicolon, whose second part may be known
by itself, or the stop of an abbreviation such as "v. 2.0".
Sentences whose first word opens no known one are passed over before they are normalised; nothing else is.

Defined results: a null or empty text, or one without known sentences, has no licences (an empty list); repeated sentences
give repeated identifiers but one licence; repeated rows give repeated rows; an empty table gives an empty table; a null
doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_col

#: Openings of licence sentences as the licences word them, normalised: lower case, licence as license, words of letters and digits
#: alone, # for a number with dots. A bar parts wordings of one place, and - is none. What follows "..." has to come later in the sentence,
#: $ ends it. {v} is the sentence's first number, {k} what stands in its place.
SENTENCES: list[tuple[str, str]] = [
    ("MIT-name", "released|licensed|distributed|available|published under the|- mit license"),
    ("MIT-name", "released|licensed|distributed|available|published under the|- terms of the mit license"),
    ("MIT-title", "the|- mit license $"),
    ("MIT-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MIT-notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("ISC-permission", "permission to use copy modify and|- or|- distribute this software for any purpose with or without fee is hereby granted"),
    ("AS-IS", "the software is provided as is without warranty of any kind"),
    ("AS-IS", "the software is provided as is and the author disclaims all warranties"),
    ("LIABILITY", "in no event shall the authors|author|copyright|regents"),
    ("Apache-name-{v}", "licensed|released|distributed|available under the|- apache license version|- #"),
    ("Apache-name-{v}", "licensed|released|distributed|available under the|- terms of the apache license version|- #"),
    ("Apache-use", "you may not use this file except in compliance with the license"),
    ("Apache-copy", "you may obtain a copy of the license at"),
    ("Apache-basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("Apache-see", "see the license for the specific language governing permissions"),
    ("GPL-name-{v}", "this|- work|program|software|- is|- licensed|released|distributed under the|- gnu general public license version|v|- #"),
    ("GPL-name-{v}", "this|- work|program|software|- is|- licensed|released|distributed under the|- terms of the gnu general public license version|v|- #"),
    ("LGPL-name-{v}", "this|- work|program|library|- is|- licensed|released|distributed under the|- gnu lesser|library general public license version|v|- #"),
    ("LGPL-name-{v}", "this|- work|program|library|- is|- licensed|released|distributed under the|- terms of the gnu lesser|library general public license version|v|- #"),
    ("AGPL-name-{v}", "this|- work|program|- is|- licensed|released|distributed under the|- gnu affero general public license version|v|- #"),
    ("AGPL-name-{v}", "this|- work|program|- is|- licensed|released|distributed under the|- terms of the gnu affero general public license version|v|- #"),
    ("GPL-free-{v}", "this program|library is free software you can redistribute it and or|- modify it under the terms of the gnu general public license ... version #"),
    ("LGPL-free-{v}", "this program|library is free software you can redistribute it and or|- modify it under the terms of the gnu lesser|library general public license ... version #"),
    ("AGPL-free-{v}", "this program is free software you can redistribute it and or|- modify it under the terms of the gnu affero general public license ... version #"),
    ("GPL-warranty", "this program|library is distributed in the hope that it will be useful"),
    ("GPL-copy", "you should have received a copy of the gnu lesser|affero|- general public license"),
    ("BSD-redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSD-source", "#|- redistributions of source code must retain the above copyright notice"),
    ("BSD-binary", "#|- redistributions in binary form must reproduce the above copyright notice"),
    ("BSD-endorse", "#|- neither the name of ... may be used to endorse or promote products"),
    ("BSD-as-is", "this software is provided by the ... as is and any express or implied warranties"),
    ("MPL-name-{v}", "this source code form is subject to the terms of the mozilla public license v #"),
    ("MPL-copy", "if a copy of the mpl was not distributed with this file"),
    ("CC-name-{k}-{v}", "this|- work|- is|- licensed under a|the|- cc|creative by {k} #"),
    ("CC-name-{k}-{v}", "this|- work|- is|- licensed under a|the|- creative commons by {k} #"),
    ("CC0", "cc0 # universal"),
    ("CC0", "dedicated to the public domain"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("SPDX-{k}", "spdx license identifier {k} $"),
]

#: What {k} stands for in names of the Creative Commons family.
KINDS = ("by", "by nc", "by sa", "by nd", "by nc sa", "by nc nd")

#: Identifier sequences that make up a licence. A name ending in ? may be missing; {v} is the same throughout.
RULES: list[tuple[str, str]] = [
    ("BSD-3-Clause", "BSD-redistribution BSD-source BSD-binary BSD-endorse BSD-as-is LIABILITY?"),
    ("BSD-2-Clause", "BSD-redistribution BSD-source BSD-binary BSD-as-is LIABILITY?"),
    ("MIT", "MIT-title? MIT-permission MIT-notice AS-IS LIABILITY?"),
    ("ISC", "ISC-permission AS-IS LIABILITY?"),
    ("Apache-{v}", "Apache-name-{v} Apache-use Apache-copy? Apache-basis? Apache-see?"),
    ("GPL-{v}", "GPL-free-{v} GPL-warranty? GPL-copy?"),
    ("LGPL-{v}", "LGPL-free-{v} GPL-warranty? GPL-copy?"),
    ("AGPL-{v}", "AGPL-free-{v} GPL-warranty? GPL-copy?"),
    ("MPL-{v}", "MPL-name-{v} MPL-copy?"),
    ("MIT", "MIT-name"), ("MIT", "MIT-title"), ("Apache-{v}", "Apache-name-{v}"), ("GPL-{v}", "GPL-name-{v}"), ("LGPL-{v}", "LGPL-name-{v}"), ("AGPL-{v}", "AGPL-name-{v}"),
    ("CC-{v}", "CC-name-{v}"), ("CC0-1.0", "CC0"), ("Unlicense", "Unlicense"), ("{v}", "SPDX-{v}"),
]

COMMENT = r"[ \t]*(?://+|/?\*+/?|#+|--+|;+|%+|<!--|REM\b)?[ \t]*"


def wordings(text: str) -> list[tuple[str, ...]]:
    """Every wording of an opening."""
    out: list[tuple[str, ...]] = [()]
    for word in text.split():
        out = [o + (() if w == "-" else (w,)) for o in out for w in word.split("|")]
    return out


def openings() -> dict[tuple[str, ...], tuple[str, tuple[str, ...], bool]]:
    """Of each opening: identifier, words that have to follow somewhere, whether the sentence ends with it."""
    out = {}
    for name, text in SENTENCES:
        start, _, later = text.partition(" ... ")
        for kind in KINDS if " by {k} " in start else [""]:
            for words in wordings(start.replace("by {k}", kind)):
                ends = words[-1] == "$"
                out.setdefault(tuple(w for w in words if w not in ("$", "{k}")), (name.replace("{k}", kind.replace(" ", "-")) if kind else name, tuple(later.split()), ends))
    return out


KNOWN = openings()
SIZES = sorted({len(k) for k in KNOWN}, reverse=True)
FIRST = "|".join(sorted({k[0].replace("license", "licen[sc]e").replace("#", r"\d") for k in KNOWN}, key=len, reverse=True))
#: Where a sentence begins whose first word opens a known one.
START = re.compile(rf"(?:\A|\n|(?<=[.!?:;])\s){COMMENT}\W*(?=(?:{FIRST})\b)", re.I)
END = re.compile(r"(?<!\bv)[.!?](?=\s|\Z)|\n[ \t]*(?=\n)", re.I)
LINE = re.compile(rf"\n{COMMENT}")
WORD = re.compile(r"\d+(?:\.\d+)*|[a-z][a-z0-9]*|\d")


def normalised(sentence: str) -> tuple[list[str], list[str]]:
    """Words of a sentence, # for each number, and the numbers."""
    words, numbers = [], []
    for w in WORD.findall(sentence.lower().replace("licence", "license")):
        if w[0].isdigit():
            numbers.append(w)
            w = "#"
        words.append(w)
    return words, numbers


def identifiers(text: str | None) -> list[str]:
    """Identifiers of the known sentences of a text, in order."""
    out, done = [], 0
    for m in START.finditer(text or ""):
        if m.end() < done:
            continue  # inside an SPDX line
        spdx = text[m.end() : m.end() + 5].lower() == "spdx-"
        stop = re.compile(r"\n|\Z").search(text, m.end()) if spdx else END.search(text, m.end())
        end = stop.start() if stop else len(text)
        sentence = text[m.end() : end]
        if spdx:
            value = sentence.partition(":")[2].strip(" \t*/->")
            if sentence.lower().replace("licence", "license").startswith("spdx-license-identifier:") and value:
                out.append("SPDX-" + "-".join(re.findall(r"[a-z0-9.+]+", value.lower())))
                done = end
            continue
        words, numbers = normalised(LINE.sub(" ", sentence))
        for n in SIZES:
            found = KNOWN.get(tuple(words[:n])) if n <= len(words) else None
            if not found:
                continue
            name, later, ends = found
            rest = words[n:]
            if ends and rest or later and not any(tuple(rest[i : i + len(later)]) == later for i in range(len(rest))):
                continue
            if "{v}" in name:
                # the number of the opening, or the one behind what has to follow
                at = n if not later else n + next(i for i in range(len(rest)) if tuple(rest[i : i + len(later)]) == later) + len(later)
                name = name.replace("{v}", numbers[words[:at].count("#") - 1])
            out.append(name)
            break
    return out


def licences(found: list[str]) -> list[str]:
    """Licences of an identifier sequence: at each place the first rule that fits takes its identifiers."""
    out, at = [], 0
    while at < len(found):
        for name, rule in RULES:
            here, value = at, None
            for want in rule.split():
                own = re.compile(re.escape(want.removesuffix("?")).replace(r"\{v\}", "(.+)") + r"\Z")
                m = own.match(found[here]) if here < len(found) else None
                if m and not (m.groups() and value not in (None, m[1])):
                    value = m[1] if m.groups() else value
                    here += 1
                elif not want.endswith("?"):
                    break
            else:
                out.append(name.format(v=value or "").upper() if name == "{v}" else name.format(v=(value or "").upper()))
                at = here
                break
        else:
            out.append("unmatched")
            at += 1
    return sorted(set(out))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences, identifiers of every document."""

    def run(batches):
        for b in batches:
            ids = [identifiers(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([licences(x) for x in ids], pa.list_(pa.string())), pa.array(ids, pa.list_(pa.string()))], names=["doc_id", "licences", "identifiers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).mapInArrow(run, "doc_id long, licences array<string>, identifiers array<string>")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ";").alias("licences"), F.size("identifiers").cast("long").alias("n_sentences"))


ORACLE = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
hit AS (
  SELECT doc_id,
    (length(line) - length(replace(line, 'Released under the MIT License.', ''))) // length('Released under the MIT License.') AS mit,
    (length(line) - length(replace(line, 'Licensed under the Apache License, Version 2.0.', ''))) // length('Licensed under the Apache License, Version 2.0.') AS apache,
    (length(line) - length(replace(line, 'This work is licensed under the GNU General Public License, version 3.', ''))) // length('This work is licensed under the GNU General Public License, version 3.') AS gpl,
    (length(line) - length(replace(line, 'Licensed under CC BY-NC 4.0.', ''))) // length('Licensed under CC BY-NC 4.0.') AS cc
  FROM lines),
per AS (SELECT doc_id, sum(mit) AS mit, sum(apache) AS apache, sum(gpl) AS gpl, sum(cc) AS cc FROM hit GROUP BY doc_id)
SELECT d.doc_id, concat_ws(';', CASE WHEN apache > 0 THEN 'Apache-2.0' END, CASE WHEN cc > 0 THEN 'CC-BY-NC-4.0' END, CASE WHEN gpl > 0 THEN 'GPL-3' END, CASE WHEN mit > 0 THEN 'MIT' END) AS licences,
  CAST(coalesce(mit + apache + gpl + cc, 0) AS BIGINT) AS n_sentences
FROM documents d LEFT JOIN per USING (doc_id)
"""
