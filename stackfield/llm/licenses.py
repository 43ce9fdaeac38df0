"""License scans by sentence rules.

A text is cut at sentence ends and blank lines; each piece is normalised (lower
case, signs and comment marks gone), and its runs of whole lines that are a known
license sentence, wrapped or not, become that sentence's identifiers, with the
version where it names one. The identifiers of a text, in
their order, are matched against ordered rules; the first rule that matches at a
place takes its identifiers. A projection: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The beginning of the notices of the Free Software Foundation.
_FREE = r"(([a-z0-9]+ ){1,8}is free software,? )?you (can|may) redistribute it and or modify it under the terms of (the )?"
_ISSUED = r",? as published by the free software foundation"
_VERSION = r",? (either )?v(ersion )?([0-9])( [0-9])?( of the licen[sc]e)?"


def _notice(license: str) -> tuple[str, str]:
    """The notice with any later version, and the one without."""
    return f"{_FREE}{license}({_VERSION})?{_ISSUED}({_VERSION})?,? or,? (at your option,? )?any later version", f"{_FREE}(version [0-9]( [0-9])? of the )?{license}({_VERSION})?{_ISSUED}({_VERSION})?( only)?"


_NOTICES = {"AGPL": _notice("(gnu )?affero general public licen[sc]e"), "LGPL": _notice("(gnu )?(lesser|library) general public licen[sc]e"), "GPL": _notice("gnu general public licen[sc]e")}

# Sentence identifiers, and the normalised sentences (as patterns) that have them.
SENTENCES = [
    *((f"{name}{kind}", pattern) for name, both in _NOTICES.items() for kind, pattern in zip(("later", "notice"), both, strict=True)),
    ("AGPLv", r"(this (work|program|software|file|library) is )?(free software )?(licensed|released|distributed|available|redistributable)? ?(under )?(the )?(terms of )?(the )?(gnu )?affero general public licen[sc]e,? ?(as published by the free software foundation)?,? ?v(ersion )?([0-9]) ?(0)?"),
    ("LGPLv", r"(this (work|program|software|file|library) is )?(free software )?(licensed|released|distributed|available)? ?(under )?(the )?(terms of )?(the )?(gnu )?(lesser|library) general public licen[sc]e,? ?(as published by the free software foundation)?,? ?v(ersion )?([0-9](?: [0-9])?)"),
    ("GPLv", r"(this (work|program|software|file|library) is )?(free software )?(licensed|released|distributed|available)? ?(under )?(the )?(terms of )?(the )?gnu general public licen[sc]e,? ?(as published by the free software foundation)?,? ?v(ersion )?([0-9]) ?(0)?"),
    ("GPLshort", r"(this (work|program|software|file) is )?(licensed|released|distributed|available) under (the )?gpl ?v?([0-9])?( 0)?"),
    ("ApacheV", r"((this|the) (work|program|software|file|project) is )?(licensed|released|distributed|available) under the apache licen[sc]e,? ?v?(ersion )?([0-9]) ?(0)?( the licen[sc]e)?"),
    ("ApacheMayNot", r"you may not use this (file|software) except in compliance with the licen[sc]e"),
    ("MITname", r"((this|the) (work|program|software|file|project|code) is )?(licensed|released|distributed|available) under (the terms of )?the mit licen[sc]e"),
    ("MITperm", r"permission is hereby granted,? free of charge,? to any person obtaining a copy.*"),
    ("BSDname", r"((this|the) (work|program|software|file|project) is )?(licensed|released|distributed|available) under (the terms of )?(the |a )?(new |modified |simplified )?(([234]) clause )?bsd (([234]) clause )?(style )?licen[sc]e"),
    ("BSDredist", r"redistribution and use in source and binary forms,? with or without modification,? are permitted.*"),
    ("BSDendorse", r"(3 )?neither the name of .* may be used to endorse or promote products derived from this software.*"),
    ("BSDadvert", r"(3 )?all advertising materials mentioning features or use of this software must display the following acknowledge?ment.*"),
    ("CCnamed", r"((this|the) .* is |except where otherwise noted,? .* )?(licensed|released|distributed|available) under (a |the )?(terms of the )?creative commons attribution( (non ?commercial|share ?alike|no ?deriv(ative)?s|no ?derivative works))*( v?(ersion )?([0-9]) ([0-9]))?( (international|unported|generic|[a-z]+))?( public)?( licen[sc]e)?"),
    ("CCwaived", r"to the extent possible under law,? .* waived all copyright.*"),
    ("CC", r"((this|the) (work|text|document|file) is )?(licensed|released|distributed|available) under (a |the )?(cc|creative commons) ?((by|zero|0)( (nc|sa|nd))*)( ?v?([0-9]) ([0-9]))?.*"),
    ("MPLv", r"((this|the) .* )?(is |are )?(licensed|subject|available|released|distributed) (under|to) the (terms of the )?mozilla public licen[sc]e,? ?v(ersion)? ?([0-9])( ([0-9]))?"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("PublicDomain", r"(this (work|file|software) is )?(in|released into|dedicated to) the public domain"),
    ("OrLater", r"or (at your option )?any later version|either version [0-9] of the licen[sc]e,? or (at your option )?any later version"),
    ("AllRights", r"all rights reserved"),
    ("NoWarranty", r"(this|the) (software|program|file) is (provided|distributed) (as is|in the hope that it will be useful).*"),
]
#: Ordered rules: a pattern over identifiers, each between commas, and the license it names ($1 is its version).
RULES = [
    (r"AGPLlater([0-9]),", "AGPL-$1.0-or-later"), (r"AGPLnotice([0-9]),", "AGPL-$1.0"), (r"AGPL(?:later|notice),", "AGPL"),
    (r"LGPLlater([0-9](?:\.[0-9])?),", "LGPL-$1-or-later"), (r"LGPLnotice([0-9](?:\.[0-9])?),", "LGPL-$1"), (r"LGPL(?:later|notice),", "LGPL"),
    (r"GPLlater([0-9]),", "GPL-$1.0-or-later"), (r"GPLnotice([0-9]),", "GPL-$1.0"), (r"GPL(?:later|notice),", "GPL"),
    (r"AGPLv([0-9]),OrLater,", "AGPL-$1.0-or-later"), (r"AGPLv([0-9]),", "AGPL-$1.0"),
    (r"LGPLv([0-9](?:\.[0-9])?),OrLater,", "LGPL-$1-or-later"), (r"LGPLv([0-9](?:\.[0-9])?),", "LGPL-$1"),
    (r"GPLv([0-9]),OrLater,", "GPL-$1.0-or-later"), (r"GPLv([0-9]),", "GPL-$1.0"), (r"GPLshort([0-9]),", "GPL-$1.0"), (r"GPLshort,", "GPL"),
    (r"ApacheV([0-9]),(?:ApacheMayNot,)?", "Apache-$1.0"), (r"ApacheMayNot,", "Apache-like"),
    (r"MITname,(?:MITperm,)?", "MIT"), (r"MITperm,", "MIT"),
    (r"BSDredist,(?:[A-Za-z0-9.]+,)?BSDadvert,(?:(?:[A-Za-z0-9.]+,)?BSDendorse,)?", "BSD-4-Clause"),
    (r"BSDredist,(?:[A-Za-z0-9.]+,)?BSDendorse,", "BSD-3-Clause"), (r"BSDredist,", "BSD-2-Clause"), (r"BSDname([234]),", "BSD-$1-Clause"), (r"BSDname,", "BSD"),
    (r"CCwaived,", "CC0-1.0"), (r"CC0(?:v[0-9.]*)?,", "CC0-1.0"), (r"CC([A-Z-]+)v([0-9.]+),", "CC-$1-$2"), (r"CC([A-Z-]+),", "CC-$1"),
    (r"MPLv([0-9.]+),", "MPL-$1"), (r"Unlicense,", "Unlicense"), (r"PublicDomain,", "Public-Domain"),
]
#: A sentence can be a license sentence only if it has one of these, on one line or wrapped.
HINT = r"(?i)licen[sc]e|public\W+domain|permission|redistribution|later\W+version|compliance|endorse|rights\W+reserved|creative\W+commons|\bcc(?:0|by|zero)?\b|\bgpl|warrant|as\W+is|hope\W+that|advertising\W+materials|waived"
#: Sentence ends (not the point of 'v. 2.0') and lines without letters and digits.
ENDS = r"(?<=[.!?;])(?<!\b[vV]\.)\s+|\n[^\p{L}\p{N}\n]*\n\s*"
#: A license sentence in a normalised piece, whose line breaks are |: whole lines, however they are wrapped.
LINES = "(?<![^|])(?:" + "|".join(p.replace(" ", "[ |]").replace(".*", ".*?") for _, p in SENTENCES) + ")(?![^|])"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _group(pattern: str, what: str) -> int:
    """The number of the group that begins with what."""
    n = 0
    for i, c in enumerate(pattern):
        if c == "(" and pattern[i : i + 2] != "(?" and (i == 0 or pattern[i - 1] != "\\"):
            n += 1
            if pattern.startswith(what, i):
                return n
    return 0


def identifier_sql(s: str) -> str:
    """The identifier of a normalised sentence, or null."""
    whens = []
    for name, pattern in SENTENCES:
        whole = f"^{pattern}$"
        group = lambda w, whole=whole: f"regexp_extract({s}, {_q(whole)}, {_group(whole, w)})"
        if name.endswith(("later", "notice")):
            number = "([0-9](?: [0-9])?)" if name.startswith("LGPL") else "([0-9])"
            version = "regexp_extract(" + s + ", " + _q(r"terms of .*?\bv(?:ersion )?" + number) + ", 1)"
            made = f"concat('{name}', replace({version}, ' ', '.'))"
        elif name == "CCnamed":
            terms = "".join(f", if({s} rlike '{p}', '-{t}', '')" for p, t in (("non ?commercial", "NC"), ("share ?alike", "SA"), ("no ?deriv", "ND")))
            version = f"regexp_replace(regexp_extract({s}, '[0-9] [0-9]', 0), '([0-9]) ([0-9])', 'v$1.$2')"
            made = f"concat('CCBY'{terms}, {version})"
        elif name == "CC":
            kind = f"upper(replace({group('((by|zero|0)')}, ' ', '-'))"
            version = f"if({group('([0-9]) ([0-9])')} = '', '', concat('v', {group('([0-9]) ([0-9])')}, '.', regexp_extract({s}, {_q(whole)}, {_group(whole, '([0-9]) ([0-9])') + 1})))"
            made = f"concat('CC', if({kind} IN ('ZERO', '0'), '0', {kind}), {version})"
        elif name == "LGPLv":
            made = f"concat('LGPLv', replace({group('([0-9](?:')}, ' ', '.'))"
        elif name == "MPLv":
            second = f"regexp_extract({s}, {_q(whole)}, {_group(whole, '([0-9])') + 2})"
            made = f"concat('MPLv', {group('([0-9])')}, if({second} = '', '', concat('.', {second})))"
        elif name == "BSDname":
            first = _group(whole, "([234])")
            made = f"concat('BSDname', regexp_extract({s}, {_q(whole)}, {first}), regexp_extract({s}, {_q(whole)}, {first + 2}))"
        elif name in ("AGPLv", "GPLv", "GPLshort", "ApacheV"):
            made = f"concat('{name}', {group('([0-9])')})"
        else:
            made = f"'{name}'"
        whens.append(f"WHEN {s} rlike {_q(whole)} THEN {made}")
    return f"CASE {' '.join(whens)} END"


def _named(hits, pattern: str, name: str):
    return F.transform(hits, lambda h: F.regexp_replace(h, f"^{pattern}$", name))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, sentences (identifiers in their order) and
    licenses (distinct, sorted).

    Null and empty texts have none; equal texts have equal results; an empty
    table gives no rows; further columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = f"split(regexp_replace(text, {_q(r'\r\n?')}, {_q(chr(10))}), {_q(ENDS)})"
    cut = f"if(text rlike {_q(HINT)}, filter({pieces}, s -> s rlike {_q(HINT)}), cast(array() as array<string>))"
    norm = f"transform({cut}, s -> regexp_replace(translate(lower(s), '|', ' '), {_q('[^a-z0-9,]*' + chr(10) + '[^a-z0-9,]*')}, '|'))"
    norm = f"transform({norm}, s -> regexp_replace(s, '[^a-z0-9,|]+', ' '))"
    norm = f"transform({norm}, s -> regexp_replace(regexp_replace(s, ' ?,( |$)', ', '), {_q(r'[ ,]*[|][ ,]*')}, '|'))"
    norm = f"transform({norm}, s -> trim(BOTH ' ,|' FROM s))"
    lines = f"transform(flatten(transform({norm}, s -> regexp_extract_all(s, {_q(LINES)}, 0))), s -> translate(s, '|', ' '))"
    ids = f"filter(transform({lines}, s -> {identifier_sql('s')}), i -> i IS NOT NULL)"
    out = base.select("doc_id", F.expr(ids).alias("sentences"))
    line = F.when(F.size("sentences") > 0, F.concat(F.lit(","), F.array_join("sentences", ","), F.lit(",")))
    rest, made = line, []
    for pattern, name in RULES:
        whole = f"(?<=,){pattern}"
        hits = F.regexp_extract_all(rest, F.lit(whole), F.lit(0))
        made.append(_named(hits, pattern, name))
        rest = F.regexp_replace(rest, whole, "")
    licenses = F.array_sort(F.array_distinct(F.concat(*made)))
    return out.select("doc_id", "sentences", F.coalesce(licenses, F.array().cast("array<string>")).alias("licenses"))
