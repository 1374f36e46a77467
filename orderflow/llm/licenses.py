"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised to lower-case letters and digits, and known ones are
replaced by their identifiers. The sequence of identifiers is then matched against ordered rules: each rule
is a sequence that stands for a license, and what an earlier rule has matched is not matched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm._shared import table

# Wordings of public licenses, normalised. ``*`` stands for up to ``MOST_WORDS`` words, as of a holder's name.
SENTENCES = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd_use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_name": "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    "apache_under": "licensed under the apache license version 2 0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "gpl3_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl3_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl3_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "apache_terms": "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution",
    "gpl3_text": "gnu general public license version 3 29 june 2007",
    "gpl2_text": "gnu general public license version 2 june 1991",
    "lgpl3_text": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21_text": "gnu lesser general public license version 2 1 february 1999",
    "agpl3_text": "gnu affero general public license version 3 19 november 2007",
    "mpl_text": "mozilla public license version 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "epl_under": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "epl_text": "eclipse public license v 2 0 the accompanying program is provided under the terms of this eclipse public license agreement",
    "cc0_text": "creative commons legal code cc0 1 0 universal",
    "cc0_under": "to the extent possible under law * has waived all copyright and related or neighboring rights to",
    "mpl_subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl3_under": "licensed under the gnu general public license version 3",
    "gpl2_work": "this work is licensed under the gnu general public license version 2",
    "mit_released": "released under the mit license",
    "mit_under": "licensed under the mit license",
    "mit_project": "this project is licensed under the mit license",
    "apache_project": "this project is licensed under the apache license 2 0",
    "apache_short": "licensed under the apache license version 2 0",
    "bsd3_under": "licensed under the bsd 3 clause license",
    "cc_by": "licensed under cc by 4 0",
    "cc_by_sa": "licensed under cc by sa 4 0",
    "cc_by_nc": "licensed under cc by nc 4 0",
}
#: Licenses of an SPDX line, by their identifiers. Of an expression each license has an identifier of its own.
SPDX = {
    "spdx_mit": "MIT",
    "spdx_apache": "Apache-2.0",
    "spdx_gpl3": "GPL-3.0-only",
    "spdx_gpl3_later": "GPL-3.0-or-later",
    "spdx_bsd3": "BSD-3-Clause",
    "spdx_bsd2": "BSD-2-Clause",
    "spdx_gpl2": "GPL-2.0-only",
    "spdx_gpl2_later": "GPL-2.0-or-later",
    "spdx_lgpl21": "LGPL-2.1-only",
    "spdx_lgpl21_later": "LGPL-2.1-or-later",
    "spdx_lgpl3": "LGPL-3.0-only",
    "spdx_lgpl3_later": "LGPL-3.0-or-later",
    "spdx_agpl3": "AGPL-3.0-only",
    "spdx_agpl3_later": "AGPL-3.0-or-later",
    "spdx_mpl": "MPL-2.0",
    "spdx_isc": "ISC",
    "spdx_epl": "EPL-2.0",
    "spdx_unlicense": "Unlicense",
    "spdx_cc0": "CC0-1.0",
}
MOST_WORDS = 12
#: A text without any of these words holds no known sentence.
WORDS = ("licens", "permission", "redistributi", "copyright", "warrant", "unencumbered", "creative commons")
#: In order: license, and the identifiers that stand for it.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache_under", "apache_comply")),
    ("GPL-3.0-or-later", ("gpl3_free", "gpl_hope")),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope")),
    ("LGPL-3.0-or-later", ("lgpl3_free",)),
    ("LGPL-2.1-or-later", ("lgpl21_free",)),
    ("AGPL-3.0-or-later", ("agpl3_free", "gpl_hope")),
    ("AGPL-3.0-or-later", ("agpl3_free",)),
    ("Apache-2.0", ("apache_terms",)),
    ("GPL-3.0-only", ("gpl3_text",)),
    ("GPL-2.0-only", ("gpl2_text",)),
    ("LGPL-3.0-only", ("lgpl3_text",)),
    ("LGPL-2.1-only", ("lgpl21_text",)),
    ("AGPL-3.0-only", ("agpl3_text",)),
    ("MPL-2.0", ("mpl_text",)),
    ("Unlicense", ("unlicense",)),
    ("EPL-2.0", ("epl_under",)),
    ("EPL-2.0", ("epl_text",)),
    ("CC0-1.0", ("cc0_text",)),
    ("CC0-1.0", ("cc0_under",)),
    ("ISC", ("isc_grant",)),
    ("MPL-2.0", ("mpl_subject",)),
    ("GPL-3.0-or-later", ("gpl3_free",)),
    ("GPL-2.0-or-later", ("gpl2_free",)),
    ("GPL-3.0-only", ("gpl3_work",)),
    ("GPL-3.0-only", ("gpl3_under",)),
    ("GPL-2.0-only", ("gpl2_work",)),
    ("MIT", ("mit_released",)),
    ("MIT", ("mit_under",)),
    ("MIT", ("mit_project",)),
    ("Apache-2.0", ("apache_project",)),
    ("Apache-2.0", ("apache_short",)),
    ("BSD-3-Clause", ("bsd3_under",)),
    ("CC-BY-4.0", ("cc_by",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    *((name, (i,)) for i, name in SPDX.items()),
)
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What ends a sentence: a line end, or a stop, dash, comma or bracket; many do not end one, so known sentences may go over them.
_STOP = r"[.!?:;,]*[\x0A\x0D]+|[.!?:;,]+[\x20\x09-\x0D]+|\x20*[(\[{<>}\])]+|\x20+-+\x20+"
#: What stands between two words of a known sentence.
_GAP = "(?: |\n\n)"
_ANY = f"[a-z0-9]+(?:{_GAP}[a-z0-9]+){{0,{MOST_WORDS - 1}}}?"
_SPDX = "spdx license identifier "


def _normal(words: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in words.lower()).split())


def _pattern(sentence: str) -> str:
    return _GAP.join(_ANY if w == "*" else w for w in sentence.split())


def _known() -> str:
    """A known sentence from one stop to another, or an SPDX line with its licenses; of several that begin at one place the longest."""
    names = "|".join(_pattern(_normal(x)) for x in sorted(SPDX.values(), key=len, reverse=True))
    line = _pattern(_SPDX) + f"{_GAP}(?:{names})(?:{_GAP}(?:or|and){_GAP}(?:{names}))*"
    return "\n(?:" + "|".join([line, *map(_pattern, sorted(SENTENCES.values(), key=len, reverse=True))]) + ")\n"


_KNOWN = _known()
_SPDX_IDS = {_normal(s).replace(" or later", " orlater"): f"<{i}>" for i, s in SPDX.items()}
#: Open sentences, with words of a name, by their beginning and end.
_OPEN = {i: s for i, s in SENTENCES.items() if "*" in s}


def _sequence(text: Column) -> Column:
    """Identifiers of the known sentences in a text, in order."""
    low = F.translate(text, _CAPITALS + "\x01", _SMALL + " ")
    may = F.lit(False)
    for w in WORDS:
        may = may | F.contains(low, F.lit(w))
    words = F.regexp_replace(F.regexp_replace(low, _STOP, "\x01"), "[^a-z0-9\x01]+", " ")
    stops = F.regexp_replace(F.concat(F.lit("\x01"), words, F.lit("\x01")), " ?\x01[ \x01]*", "\n\n")
    table_ = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() if i not in _OPEN for x in (s, f"<{i}>")))
    spdx = F.create_map(*(F.lit(x) for name, i in _SPDX_IDS.items() for x in (name, i)))
    found = F.regexp_extract_all(stops, F.lit(_KNOWN), 0)

    def ids(sentence: Column) -> Column:
        plain = F.trim(F.regexp_replace(sentence, "\n+", " "))
        out = F.element_at(table_, plain)
        for i, s in _OPEN.items():
            first, last = s.split("*")
            out = F.when(F.startswith(plain, F.lit(first)) & F.endswith(plain, F.lit(last)), F.lit(f"<{i}>")).otherwise(out)
        each = F.split(F.substring(F.replace(plain, F.lit(" or later"), F.lit(" orlater")), len(_SPDX) + 1, 1 << 30), " (?:or|and) ")
        return F.when(F.startswith(plain, F.lit(_SPDX)), F.array_join(F.transform(each, lambda x: F.element_at(spdx, x)), "")).otherwise(out)

    return F.when(may, F.array_join(F.transform(found, ids), "")).otherwise("")


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, sentence_ids, licenses, n_matches, n_leftover``.

    ``sentence_ids`` are the recognised sentences in order. A sentence begins and ends at a line end, a full stop, comma, bracket or the
    like, and may have others within, as in wrapped license texts or "free software: you". An SPDX line has one for each license of its
    expression. ``licenses`` are those of the
    rules that matched, in the rules' order, each once; ``n_matches`` counts matches, ``n_leftover`` recognised
    sentences that belong to none. Null and empty texts match nothing; null ids and repeated rows are
    given as they come; other columns are not read.
    """
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in RULES))
    start = F.struct(F.col("sentence_ids").alias("left"), F.array().cast("array<string>").alias("names"), F.lit(0).cast("long").alias("n"))
    times = lambda a, r: F.floor((F.length(a["left"]) - F.length(F.replace(a["left"], r["ids"], F.lit("")))) / F.length(r["ids"]))
    step = lambda a, r: F.when(~F.contains(a["left"], r["ids"]), a).otherwise(
        F.struct(
            F.replace(a["left"], r["ids"], F.lit("/")).alias("left"),
            F.array_union(a["names"], F.array(r["name"])).alias("names"),
            (a["n"] + times(a, r)).alias("n"),
        )
    )
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), _sequence(F.coalesce(text_col, F.lit(""))).alias("sentence_ids"))
    done = found.withColumn("m", F.when(F.col("sentence_ids") != "", F.aggregate(rules, start, step)).otherwise(start))
    return done.select(
        "doc_id",
        "sentence_ids",
        F.array_join("m.names", ",").alias("licenses"),
        F.col("m.n").alias("n_matches"),
        F.length(F.regexp_replace("m.left", "[^<]", "")).cast("long").alias("n_leftover"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licenses."""
    return license_matches(table(spark, sf_dir, "documents"))


def op2_oracle() -> str:
    """The same rows in DuckDB SQL."""
    entries = lambda pairs: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs) + "}"
    known = entries((s, f"<{i}>") for i, s in SENTENCES.items() if i not in _OPEN)
    open_ = " ".join(f"WHEN starts_with(x, '{s.split('*')[0]}') AND ends_with(x, '{s.split('*')[1]}') THEN '<{i}>'" for i, s in reversed(_OPEN.items()))
    spdx = f"array_to_string(list_transform(string_split_regex(replace(substr(x, {len(_SPDX) + 1}), ' or later', ' orlater'), ' (?:or|and) '), lambda y: {entries(_SPDX_IDS.items())}[y]), '')"
    rules = ", ".join(f"({k}, '{name}', '{''.join(f'<{i}>' for i in seq)}')" for k, (name, seq) in enumerate(RULES))
    return f"""
    WITH RECURSIVE d AS (
        SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{_CAPITALS}' || chr(1), '{_SMALL} ') AS t FROM documents),
    w AS (SELECT rid, doc_id, chr(1) || regexp_replace(regexp_replace(t, '{_STOP}', chr(1), 'g'), '[^a-z0-9\x01]+', ' ', 'g') || chr(1) AS t FROM d),
    k AS (SELECT rid, doc_id, regexp_extract_all(regexp_replace(t, ' ?\x01[ \x01]*', chr(10) || chr(10), 'g'), '{_KNOWN}') AS found FROM w),
    q AS (SELECT rid, doc_id, coalesce(array_to_string(list_transform(list_transform(found, lambda s: trim(regexp_replace(s, chr(10) || '+', ' ', 'g'))),
            lambda x: CASE WHEN starts_with(x, '{_SPDX}') THEN {spdx} {open_} ELSE {known}[x] END), ''), '') AS seq FROM k),
    r(k, name, ids) AS (VALUES {rules}),
    m AS (SELECT rid, doc_id, seq, seq AS rest, 0 AS k, []::VARCHAR[] AS names, 0::BIGINT AS n FROM q
          UNION ALL
          SELECT rid, doc_id, seq, replace(rest, ids, '/'), m.k + 1,
                 CASE WHEN contains(rest, ids) AND NOT list_contains(names, name) THEN list_append(names, name) ELSE names END,
                 n + (length(rest) - length(replace(rest, ids, ''))) // length(ids)
          FROM m JOIN r ON r.k = m.k)
    SELECT doc_id, seq AS sentence_ids, array_to_string(names, ',') AS licenses, n::BIGINT AS n_matches,
           length(regexp_replace(rest, '[^<]', '', 'g'))::BIGINT AS n_leftover
    FROM m WHERE k = {len(RULES)}
    """
