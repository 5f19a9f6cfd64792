"""License scan: sentences to identifiers, identifier sequences to licences.

A text is cut into sentences, each sentence is normalised and looked up in a
table of known licence sentences; the sequence of identifiers found is then
matched against rules in their order. A rule that matches uses up its
identifiers, so a later, more general rule cannot claim them again.

The tables are parameters; the defaults below name common licences. Texts
without any of the words that every known sentence holds skip the work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The notices of the GNU licences: sentences end behind "software:", behind "Foundation;" and where a line begins with "(at your option)".
GPL_FREE = r"^(.* is free software )?you can redistribute it and or modify it under the terms of the gnu general public license"
FSF = r" as published by the free software foundation (either )?"
GPL_FSF = GPL_FREE + FSF
LGPL_FREE = GPL_FREE.replace("general", "(lesser|library) general")
AGPL_FREE = GPL_FREE.replace("general", "affero general")

#: SPDX identifiers of licences, as they stand behind SPDX-License-Identifier.
SPDX = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Artistic-2.0 BSD-1-Clause BSD-2-Clause
BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0
CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0+
GPL-2.0-only GPL-2.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0
LGPL-3.0+ LGPL-3.0-only LGPL-3.0-or-later MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA OFL-1.1 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0
Ruby Unlicense UPL-1.0 W3C WTFPL X11 Zlib ZPL-2.1""".split()

#: Parts of Creative Commons licences, as (suffix of the SPDX identifier, words of the name).
CC_PARTS = [
    ("BY-NC-SA", "attribution non ?commercial share ?alike"), ("BY-NC-ND", "attribution non ?commercial no ?deriv(ative)?s"),
    ("BY-NC", "attribution non ?commercial"), ("BY-SA", "attribution share ?alike"),
    ("BY-ND", "attribution no ?deriv(ative)?s"), ("BY", "attribution"),
]


def _plain(name: str) -> str:
    """The pattern of a licence's name as it stands in a normalised sentence."""
    return name.lower().replace("-", " ").replace(".", r"\.").replace("+", r"\+")


#: An identifier that begins so names its licence itself and needs no rule.
NAMED = "is:"
_SPDX = [(NAMED + x, rf"^spdx license identifier {_plain(x)}( |$)") for x in sorted(SPDX, key=len, reverse=True)]
_CC = [
    (f"{NAMED}CC-{k}-{v}", rf"under (an? |the )?(terms of the )?(cc {_plain(k)} {_plain(v)}|creative commons {words} {_plain(v)})( |$)")
    for v in ("4.0", "3.0", "2.5", "2.0") for k, words in CC_PARTS
]

#: Known sentences, as (identifier, pattern of the normalised sentence).
#: A normalised sentence has lower-case ASCII letters, digits, dots and plus signs, single spaces.
SENTENCES = [
    ("copyright", r"^(portions )?copyright( c)? .*[0-9]{4}|^copyright c |^c copyright "),
    ("reserved", r"(^| )all rights reserved$"),
    ("spdx_mit", r"^spdx license identifier mit( [^0]|$)"),
    ("spdx_apache2", r"^spdx license identifier apache 2\.0( |$)"),
    ("spdx_gpl3", r"^spdx license identifier gpl 3\.0\+?( |$)"),
    *_SPDX,
    ("spdx_other", r"^spdx license identifier [a-z0-9]"),
    ("mit_ref", r"(released|licensed|distributed|available) under the (terms of the )?mit licen[sc]e$"),
    ("mit_grant", r"^permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"^the above copyright notice and this permission notice shall be included"),
    ("mit_asis", r"^the software is provided as is without warranty"),
    ("apache2_ref", r"licensed under the apache licen[sc]e version 2\.0( the license)?$"),
    ("apache2_comply", r"^you may not use this file except in compliance with the license"),
    ("apache2_copy", r"^you may obtain a copy of the license at"),
    ("apache2_asis", r"^unless required by applicable law or agreed to in writing"),
    ("gpl3_ref", r"licensed under the (terms of the )?gnu general public licen[sc]e version 3$"),
    ("gpl2_ref", r"licensed under the (terms of the )?gnu general public licen[sc]e version 2$"),
    ("lgpl_ref", r"licensed under the (terms of the )?gnu lesser general public licen[sc]e( version [0-9.]+)?$"),
    ("gpl_free_v3_later", GPL_FSF + r"version 3 of the license or (at your option )?any later version$"),
    ("gpl_free_v3_or", GPL_FSF + r"version 3 of the license or$"),
    ("gpl_free_v3", GPL_FSF + r"version 3( of the license)?$"),
    ("gpl_free_v2_later", GPL_FSF + r"version 2 of the license or (at your option )?any later version$"),
    ("gpl_free_v2_or", GPL_FSF + r"version 2 of the license or$"),
    ("gpl_free_v2", GPL_FSF + r"version 2( of the license)?$"),
    ("gpl_free", GPL_FREE),
    ("lgpl_free_v3", LGPL_FREE + FSF + r"version 3( |$)"),
    ("lgpl_free_v21", LGPL_FREE + FSF + r"version 2\.1( |$)"),
    ("lgpl_free", LGPL_FREE),
    ("agpl_free_v3", AGPL_FREE + FSF + r"version 3( |$)"),
    ("agpl_free", AGPL_FREE),
    ("gpl_v3_later", r"^(either )?version 3 of the license or (at your option )?any later version$"),
    ("gpl_v3_or", r"^(either )?version 3 of the license or$"),
    ("gpl_v2_later", r"^(either )?version 2 of the license or (at your option )?any later version$"),
    ("gpl_v2_or", r"^(either )?version 2 of the license or$"),
    ("gnu_v21", r"^(either )?version 2\.1 of the license( or)?( (at your option )?any later version)?$"),
    ("gnu_v3", r"^(either )?version 3 of the license$"),
    ("gpl_later", r"^(at your option )?any later version$"),
    ("gpl_warranty", r"^this (program|library|software) is distributed in the hope that it will be useful"),
    ("gpl_received", r"^you should have received a copy of the gnu ((lesser|library|affero) )?general public license"),
    ("bsd_redist", r"^redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"^(1\.? )?redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"^(2\.? )?redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", r"^(3\.? )?neither the name of .* nor the names of its contributors may be used to endorse"),
    ("bsd_asis", r"^this software is provided by the copyright holders and contributors as is"),
    ("ccbync4_ref", r"licensed under (the )?(cc by nc 4\.0|creative commons attribution noncommercial 4\.0( international)?( licen[sc]e)?)$"),
    ("ccbysa4_ref", r"licensed under (the )?(cc by sa 4\.0|creative commons attribution sharealike 4\.0( international)?( licen[sc]e)?)$"),
    ("ccby4_ref", r"licensed under (the )?(cc by 4\.0|creative commons attribution 4\.0( international)?( licen[sc]e)?)$"),
    *_CC,
    ("mpl2_notice", r"^this source code form is subject to the terms of the mozilla public license"),
    ("mpl2_copy", r"^if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc_grant", r"^permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted"),
    # The end of Apache's last sentence where something cuts it off from its head; it names no other licence.
    ("license_asis", r"^(software )?distributed under the license is distributed on an as is basis"),
    ("other_ref", r"(released|licensed|distributed) under (the )?.*licen[sc]e"),
]

#: Rules in order, as (licence, identifiers in sequence).
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "mit_asis"]),
    ("MIT", ["spdx_mit"]),
    ("MIT", ["mit_ref"]),
    ("MIT-incomplete", ["mit_grant"]),
    ("Apache-2.0", ["apache2_ref", "apache2_comply", "apache2_copy", "apache2_asis"]),
    ("Apache-2.0", ["spdx_apache2"]),
    ("Apache-2.0", ["apache2_ref"]),
    *[
        (f"GPL-{v}.0-or-later", [*grant, *rest])
        for v in (3, 2)
        for rest in (["gpl_warranty", "gpl_received"], [])
        for grant in (
            [f"gpl_free_v{v}_later"], [f"gpl_free_v{v}_or", "gpl_later"],
            ["gpl_free", f"gpl_v{v}_later"], ["gpl_free", f"gpl_v{v}_or", "gpl_later"],
        )
    ],
    ("GPL-3.0", ["gpl_free_v3", "gpl_warranty", "gpl_received"]),
    ("GPL-3.0", ["gpl_free_v3"]),
    ("GPL-2.0", ["gpl_free_v2", "gpl_warranty", "gpl_received"]),
    ("GPL-2.0", ["gpl_free_v2"]),
    *[
        (licence, [*grant, *rest])
        for rest in (["gpl_later", "gpl_warranty", "gpl_received"], ["gpl_warranty", "gpl_received"], ["gpl_later"], [])
        for licence, grant in (
            ("LGPL-2.1", ["lgpl_free_v21"]), ("LGPL-2.1", ["lgpl_free", "gnu_v21"]), ("LGPL-3.0", ["lgpl_free_v3"]),
            *[(f"{k.upper()}-3.0", [f"{k}_free", v]) for k in ("lgpl", "agpl") for v in ("gpl_v3_later", "gpl_v3_or", "gnu_v3")],
            ("AGPL-3.0", ["agpl_free_v3"]),
        )
    ],
    ("MPL-2.0", ["mpl2_notice", "mpl2_copy"]),
    ("MPL-2.0", ["mpl2_notice"]),
    ("ISC", ["isc_grant", "mit_asis"]),
    ("ISC", ["isc_grant"]),
    ("GPL-3.0", ["spdx_gpl3"]),
    ("GPL-3.0", ["gpl3_ref"]),
    ("GPL-2.0", ["gpl2_ref"]),
    ("LGPL", ["lgpl_ref"]),
    ("BSD-3-Clause", ["bsd_redist", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_asis"]),
    ("BSD-2-Clause", ["bsd_redist", "bsd_source", "bsd_binary", "bsd_asis"]),
    ("CC-BY-NC-4.0", ["ccbync4_ref"]),
    ("CC-BY-SA-4.0", ["ccbysa4_ref"]),
    ("CC-BY-4.0", ["ccby4_ref"]),
    ("All-rights-reserved", ["copyright", "reserved"]),
    ("All-rights-reserved", ["reserved"]),
    ("Unknown-licence", ["spdx_other"]),
    ("Unknown-licence", ["other_ref"]),
]

_GAP = r"[^A-Za-z0-9.+]+"
#: Every pattern above needs one of these; whichever letters are capital, whatever stands between words.
HINT = r"(?i)licen[sc]e|copyright|reserved|permission|warranty|redistribution|" + "|".join(
    x.replace(" ", _GAP) for x in ("this program", "later version", "applicable law", "neither the name", "creative commons", "cc by", "in the hope", "the mpl")
)

#: Marks of comments at the start of a line.
COMMENT = r"(^|\n)[ \t]*(#+|/?\*+/?|//+|--+|;+|%+|<!--+)[ \t]*"
#: A line that ends with such a word goes on, whatever the next begins with; the others go on before a small letter.
OPEN_LINE = r"\b([Tt]he|THE|[Oo]f|OF|[Uu]nder|UNDER|GNU|[Ll]esser|LESSER|Affero|General|GENERAL|Public|PUBLIC|Free|Mozilla|Creative|Commons|[Vv]ersion)[ \t\r]*\n[ \t]*([A-Za-z0-9\"])"
SPDX_HEAD = r"(?i)(//|/\*|#)?[ \t]*spdx-license-identifier[ \t]*:?[ \t]*\(?"
#: A claim to all rights in the midst of a licence's notice belongs to it: what stands beside a used identifier.
CLAIM = "((<copyright>)*<reserved>(<copyright>)*)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentences_of(text: Column) -> Column:
    """Normalised sentences of a text.

    Marks of comments at line starts are left out first. A sentence ends at . ! ? ; or : before a blank, and at a
    line's end unless the line ends with an open word or the next goes on with a small letter. An SPDX
    tag begins a sentence. Sentences that normalise to nothing are left out.
    """
    bare = F.regexp_replace(F.regexp_replace(text, SPDX_HEAD, "\nSPDX-License-Identifier "), COMMENT, "$1")
    joined = F.regexp_replace(F.regexp_replace(bare, OPEN_LINE, "$1 $2"), r"\n([ \t]*[a-z])", " $1")
    ended = F.regexp_replace(joined, r"([.!?;:][#*$%&|<>]*)[ \t\r]+", "$1\n")
    plain = lambda s: F.regexp_replace(
        F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), r"[^a-z0-9.+]+", " ")), r"[ .]+$", ""
    )
    return F.filter(F.transform(F.split(ended, "\n", -1), plain), lambda s: s != "")


def identifier_of(sentence: Column, sentences: list[tuple[str, str]] = SENTENCES) -> Column:
    """The identifier of the first pattern that finds itself in the sentence, or null."""
    return F.coalesce(*[F.when(sentence.rlike(p), F.lit(name)) for name, p in sentences])


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: list[tuple[str, str]] = SENTENCES,
    rules: list[tuple[str, list[str]]] = RULES,
    hint: str = HINT,
) -> DataFrame:
    """One row per row of `docs`: id, identifiers and licences (arrays), n_left.

    identifiers are in text order; licences in rule order, those that an identifier names itself in front, each once; n_left
    counts identifiers that no rule used. A claim to all rights beside a licence's own sentences is part of its notice. Of an
    SPDX expression the first licence counts. Rows without a licence sentence, with
    an empty or a null text get empty arrays and 0. Ids may be null or repeat;
    other columns are not used. `hint` must occur in every text that holds one
    of `sentences`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    out = docs.select(
        F.col(id_col).alias(id_col),
        F.when(text.rlike(hint), F.array_compact(
            F.transform(sentences_of(text), lambda s: identifier_of(s, sentences))
        )).otherwise(none).alias("identifiers"),
    )
    marks = F.array_join(F.transform("identifiers", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    itself = F.filter("identifiers", lambda x: F.startswith(x, F.lit(NAMED)))
    out = out.withColumns({
        "_left": F.regexp_replace(marks, f"<{NAMED}[^>]*>", "/"),
        "_found": F.transform(itself, lambda x: F.substring(x, len(NAMED) + 1, 1000)),
    })
    # No rule for such claims comes before the licences.
    claims = [rule for rule in rules if "reserved" in rule[1]]

    def apply(df: DataFrame, rule: tuple[str, list[str]]) -> DataFrame:
        name, ids = rule
        pattern = F.lit("".join(f"<{x}>" for x in ids))
        hit = F.contains(F.col("_left"), pattern)
        return df.withColumns({
            "_left": F.when(hit, F.replace(F.col("_left"), pattern, F.lit("/"))).otherwise(F.col("_left")),
            "_found": F.when(hit, F.array_append("_found", F.lit(name))).otherwise(F.col("_found")),
        })

    done = reduce(apply, [rule for rule in rules if rule not in claims], out)
    beside = F.regexp_replace(F.regexp_replace(F.col("_left"), CLAIM + "/", "/"), "/" + CLAIM, "/")
    done = reduce(apply, claims, done.withColumn("_left", beside))
    left = F.length("_left") - F.length(F.replace(F.col("_left"), F.lit("<"), F.lit("")))
    return done.select(
        id_col, "identifiers", F.array_distinct("_found").alias("licences"), left.cast("long").alias("n_left")
    )
