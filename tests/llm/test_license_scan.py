import re

import duckdb

from hubtrace.llm import queries
from hubtrace.llm.license_scan import HINT, NAMED, SENTENCES, SPDX, license_scan
from llm_docs import docs_of

MIT = """Copyright (c) 2020 Somebody
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files. The above copyright notice
and this permission notice shall be included in all copies.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""


GPL = """Copyright (C) 2021 Somebody

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""


def found(spark, *texts):
    rows = license_scan(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    return [(r["identifiers"], r["licences"], r["n_left"]) for r in rows]


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op1_license_scan"])
    got = queries.op1_license_scan(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert sum(bool(r["licences"]) for r in got) > 20


def test_sequence_of_sentences(spark):
    [(ids, licences, left)] = found(spark, MIT)
    assert ids == ["copyright", "mit_grant", "mit_notice", "mit_asis"]
    assert licences == ["MIT"] and left == 1


def test_notices_with_their_line_breaks(spark):
    later = ["gpl_warranty", "gpl_received"]
    two = GPL.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2")
    one_line = GPL.replace("or\n    (at", "or (at")
    only = GPL.replace(" of the License, or\n    (at your option) any later version.", ".")
    cut = GPL.replace("    (at your option) any later version.", "")
    two_clauses = BSD[: BSD.index("3. ")] + BSD[BSD.index("THIS"):]
    got = found(spark, GPL, two, one_line, only, cut, APACHE, BSD, two_clauses)
    assert got[0] == (["copyright", "gpl_free_v3_or", "gpl_later", *later], ["GPL-3.0-or-later"], 1)
    assert got[1] == (["copyright", "gpl_free", "gpl_v2_or", "gpl_later", *later], ["GPL-2.0-or-later"], 1)
    assert got[2] == (["copyright", "gpl_free_v3_later", *later], ["GPL-3.0-or-later"], 1)
    assert got[3] == (["copyright", "gpl_free_v3", *later], ["GPL-3.0"], 1)
    assert got[4][1] == []
    assert [x[1:] for x in got[5:]] == [(["Apache-2.0"], 0), (["BSD-3-Clause"], 0), (["BSD-2-Clause"], 0)]


FREE = "you can redistribute it and or modify it under the terms of the gnu general public license"
FSF = FREE + " as published by the free software foundation "
EXAMPLES = {
    "copyright": "copyright c 2020 somebody", "reserved": "all rights reserved",
    "spdx_mit": "spdx license identifier mit", "spdx_apache2": "spdx license identifier apache 2.0",
    "spdx_gpl3": "spdx license identifier gpl 3.0", "mit_ref": "released under the mit licence",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy",
    "mit_notice": "the above copyright notice and this permission notice shall be included",
    "mit_asis": "the software is provided as is without warranty",
    "apache2_ref": "licensed under the apache license version 2.0",
    "apache2_comply": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "apache2_asis": "unless required by applicable law or agreed to in writing",
    "gpl3_ref": "licensed under the gnu general public license version 3",
    "gpl2_ref": "licensed under the gnu general public license version 2",
    "lgpl_ref": "licensed under the gnu lesser general public license",
    "gpl_free_v3_later": FSF + "version 3 of the license or any later version",
    "gpl_free_v3_or": FSF + "either version 3 of the license or", "gpl_free_v3": FSF + "version 3 of the license",
    "gpl_free_v2_later": FSF + "version 2 of the license or any later version",
    "gpl_free_v2_or": FSF + "either version 2 of the license or", "gpl_free_v2": FSF + "version 2 of the license",
    "gpl_free": FREE, "gpl_v3_later": "version 3 of the license or any later version",
    "gpl_v3_or": "version 3 of the license or", "gpl_v2_later": "version 2 of the license or any later version",
    "gpl_v2_or": "version 2 of the license or", "gpl_later": "any later version",
    "gpl_warranty": "this program is distributed in the hope that it will be useful",
    "gpl_received": "you should have received a copy of the gnu general public license",
    "bsd_redist": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd_source": "redistributions of source code must retain the above copyright notice",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice",
    "bsd_endorse": "neither the name of x nor the names of its contributors may be used to endorse",
    "bsd_asis": "this software is provided by the copyright holders and contributors as is",
    "ccbync4_ref": "licensed under cc by nc 4.0", "ccbysa4_ref": "licensed under cc by sa 4.0",
    "ccby4_ref": "licensed under cc by 4.0", "other_ref": "distributed under the quux licence",
    "spdx_other": "spdx license identifier quux 1.0",
    "lgpl_free_v3": FSF.replace("general", "lesser general") + "either version 3 of the license",
    "lgpl_free_v21": FSF.replace("general", "lesser general") + "either version 2.1 of the license",
    "lgpl_free": FREE.replace("general", "library general"), "agpl_free": FREE.replace("general", "affero general"),
    "agpl_free_v3": FSF.replace("general", "affero general") + "version 3 of the license",
    "gnu_v21": "version 2.1 of the license or", "gnu_v3": "either version 3 of the license",
    "mpl2_notice": "this source code form is subject to the terms of the mozilla public license",
    "mpl2_copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "license_asis": "distributed under the license is distributed on an as is basis",
    **{NAMED + x: "spdx license identifier " + x.lower().replace("-", " ") for x in SPDX},
}
# Creative Commons licences by their names; those with an SPDX tag in SPDX stand there already.
EXAMPLES |= {
    name: "under a creative commons attribution" + "".join(
        f" {word}" for part, word in (("-NC", "noncommercial"), ("-ND", "noderivatives"), ("-SA", "sharealike")) if part in name
    ) + " " + name[-3:]
    for name, _ in SENTENCES if name.startswith(NAMED + "CC-")
}


def test_every_pattern_holds_a_hint(spark):
    """However words are separated and whichever letters are capital."""
    assert set(EXAMPLES) == {name for name, _ in SENTENCES}
    forms = (str, str.upper, str.title, lambda s: s.replace(" ", "-"), lambda s: re.sub(r" (?=[a-z])", "\n", s))
    texts = [form(s) + "." for s in EXAMPLES.values() for form in forms]
    names = [name for name in EXAMPLES for _ in forms]
    for name, got, text in zip(names, found(spark, *texts), texts):
        assert re.search(HINT, text) and got[0] == [name], text
    # The alternatives of the copyright pattern that do not begin with the word itself.
    [(ids, _, _)] = found(spark, "(c) Copyright 1999 X")
    assert ids == ["copyright"]


def commented(notice, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in notice.splitlines())


MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_notices_behind_comment_marks(spark):
    notices = {
        "GPL-3.0-or-later": GPL, "Apache-2.0": APACHE, "BSD-3-Clause": BSD, "MIT": MIT, "MPL-2.0": MPL, "ISC": ISC,
        "LGPL-2.1": GPL.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("Foundation, either version 3", "Foundation; either version 2.1"),
        "LGPL-3.0": GPL.replace("GNU General", "GNU Lesser General"),
        "AGPL-3.0": GPL.replace("GNU General", "GNU Affero General").replace("Foundation, either", "Foundation; either"),
    }
    marks = ["", "#", " *", "//", "--", ";;"]
    texts = [commented(x, m) + "\n\nimport os\n" for x in notices.values() for m in marks]
    names = [n for n in notices for _ in marks]
    for name, got, text in zip(names, found(spark, *texts), texts):
        assert got[1] == [name], (got, text)


def test_all_rights_reserved_inside_a_notice(spark):
    claim = "Copyright (c) 2015, Somebody\nAll rights reserved.\n\n"
    got = found(spark, claim + BSD, commented(claim + APACHE, "#"), APACHE + claim, claim, claim + "A text.\n" + claim)
    assert [x[1] for x in got] == [["BSD-3-Clause"], ["Apache-2.0"], ["Apache-2.0"], ["All-rights-reserved"], ["All-rights-reserved"]]


def test_spdx_tags_and_creative_commons(spark):
    got = found(
        spark,
        "// SPDX-License-Identifier: BSD-3-Clause\nint x;", "/* SPDX-License-Identifier: MIT */", "# SPDX-License-Identifier: Apache-2.0 and more words",
        "# SPDX-FileCopyrightText: 2020 X\n# SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: MIT-0",
        "SPDX-License-Identifier: Quux-9", "SPDX-License-Identifier: BSD-3-Clause-Clear", "SPDX-License-Identifier: (MPL-2.0 OR MIT)",
        "This text is made available under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under the terms of the Creative Commons\nAttribution-NonCommercial-NoDerivatives 4.0 licence", "Licensed under CC BY-SA 3.0.",
        "Software\ndistributed under the License is distributed on an \"AS IS\" BASIS.",
    )
    assert [x[1] for x in got] == [
        ["BSD-3-Clause"], ["MIT"], ["Apache-2.0"], ["LGPL-2.1-or-later"], ["MIT-0"], ["Unknown-licence"], ["BSD-3-Clause-Clear"],
        ["MPL-2.0"], ["CC-BY-SA-4.0"], ["CC-BY-NC-ND-4.0"], ["CC-BY-SA-3.0"], [],
    ]


def test_order_of_rules_and_leftovers(spark):
    got = found(
        spark,
        "All rights reserved.",
        "Copyright (c) 2001 X.\nAll rights reserved.",
        "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
        "Licensed under the Quux License.",
        "A licence is a text.", "", None,
    )
    assert [x[1] for x in got] == [
        ["All-rights-reserved"], ["All-rights-reserved"], ["MIT", "Apache-2.0"], ["Unknown-licence"], [], [], [],
    ]
    assert [x[2] for x in got] == [0] * 7


def test_odd_rows(odd_docs, no_docs):
    out = license_scan(odd_docs)
    assert out.columns == ["doc_id", "identifiers", "licences", "n_left"]
    assert out.count() == odd_docs.count() and license_scan(no_docs).count() == 0
