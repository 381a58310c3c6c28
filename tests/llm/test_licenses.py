import duckdb
import pytest

from tessera.llm.licenses import HINTS, KNOWN, ORACLE_SQL, RULES, SENTENCES, licenses, op8_licenses

MIT = """The MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
CASES = [
    (1, None, "", 0), (2, "", "", 0), (3, "A house. All rights were reserved.", "", 0),
    (4, "Released under the MIT License.\nTh of. Inth onston.", "MIT", 1),
    (5, "word\nLicensed under the Apache License, Version 2.0.\nword", "Apache-2.0", 1),
    (6, "Licensed under CC BY-NC 4.0. All rights reserved!", "CC-BY-NC-4.0 all-rights-reserved", 2),
    (7, "This work is licensed under the GNU General Public License, version 3.\n" * 3, "GPL-3.0-only", 3),
    (8, MIT, "MIT", 2), (8, MIT, "MIT", 2),
    (9, "// SPDX-License-Identifier: Apache-2.0", "Apache-2.0", 1), (10, "SPDX License Identifier GPL-3.0-or-later", "GPL-3.0-or-later", 1),
    (11, "a|b * all rights reserved. |reserved| ", "", 0), (12, "ALL RIGHTS\tRESERVED", "all-rights-reserved", 1),
    (13, "x. " * 30_000 + "Released under the MIT License. " + "y " * 30_000, "MIT", 1),
]


GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
NOTICES = [(GPL.format(":", ",", 3), "GPL-3.0-or-later"), (GPL.format(";", ";", 2), "GPL-2.0-or-later"), (GPL.format(";", ";", 3), "GPL-3.0-or-later"),
           (GPL.format(":", ",", 2), "GPL-2.0-or-later"), (BSD, "BSD-2-Clause"), (BSD + BSD_3, "BSD-3-Clause"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0")]


def test_published_notices(spark):
    rows = [(i, t) for i, (t, _) in enumerate(NOTICES)]
    got = licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licenses, r.n_matches) for r in got} == {i: (name, 1) for i, (_, name) in enumerate(NOTICES)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE_SQL).fetchall())


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
TAGS = [("// SPDX-License-Identifier: MIT\nimport x", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
        ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */\nint x;", "Apache-2.0 MIT"), ("SPDX-License-Identifier: (MIT AND BSD-3-Clause)", "BSD-3-Clause MIT"),
        ("spdx-license-identifier: GPL-2.0+ WITH Classpath-exception-2.0", "GPL-2.0-or-later"), ("SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1-only"),
        ("<!-- SPDX-License-Identifier: CC-BY-NC-ND-4.0 -->", "CC-BY-NC-ND-4.0"), ("SPDX-License-Identifier: MIT. All rights reserved.", "MIT all-rights-reserved"),
        ("a\n# SPDX-License-Identifier: ISC\nb\n# SPDX-License-Identifier: Zlib\n", "ISC Zlib"), ("SPDX-License-Identifier: LicenseRef-mine", ""),
        ("# SPDX-License-Identifier: Apache-2.0\n" + APACHE, "Apache-2.0"), ("SPDX-License-Identifier:", ""),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\nTERMS", "Apache-2.0"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright", "GPL-3.0-only"),
        ("GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n\n", "GPL-2.0-only"), ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999\n\n", "LGPL-2.1-only"),
        ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"), (LGPL, "LGPL-2.1-or-later")]


def test_tags_and_titles(spark):
    rows = [(i, t) for i, (t, _) in enumerate(TAGS)]
    got = licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {i: name for i, (_, name) in enumerate(TAGS)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE_SQL).fetchall())


FORMS = [("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
         ("This project is licensed under the MIT License.", "MIT"), ("Licensed under the GNU General Public License v3.0", "GPL-3.0-only"),
         ("Licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1-only"),
         (GPL.format(":", ",", 3).replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later"), ("ISC License", "ISC"), ("zlib License", "Zlib"),
         ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("Mozilla Public License Version 2.0\n====", "MPL-2.0"),
         ("Eclipse Public License - v 2.0", "EPL-2.0"), ("Boost Software License, Version 1.0.", "BSL-1.0")]


def test_published_sentences(spark):
    rows = [(i, t) for i, (t, _) in enumerate(FORMS)]
    got = licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {i: name for i, (_, name) in enumerate(FORMS)}


def test_cases(spark):
    df = spark.createDataFrame([(a, b, 1, []) for a, b, _, _ in CASES], "doc_id long, text string, licenses int, _ids array<int>")
    got = licenses(df).collect()
    assert sorted((r.doc_id, r.licenses, r.n_matches) for r in got) == sorted((a, c, d) for a, _, c, d in CASES)
    assert {r.doc_id: r.identifiers for r in got}[8] == "mit-title mit-grant mit-notice mit-as-is"
    assert licenses(df.limit(0)).count() == 0


def test_rules_are_whole():
    assert all(i in SENTENCES for _, seq in RULES for i in seq) and {i for _, seq in RULES for i in seq} <= set(SENTENCES)
    assert all(any(h in s for h in HINTS) for s in KNOWN) and len(KNOWN) == len(SENTENCES)
    for i, (_, seq) in enumerate(RULES):  # no rule is hidden by an earlier one within it
        assert not any(any(seq[k:k + len(s)] == s for k in range(len(seq))) for _, s in RULES[:i])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/{sf}/documents.parquet')")
    got = sorted(tuple(r) for r in op8_licenses(spark, f"/root/testdata/{sf}").collect())
    assert got == sorted(con.execute(ORACLE_SQL).fetchall())
    assert sum(r[2] for r in got) > 3


def test_sql_on_cases(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [c[:2] for c in CASES])
    df = spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string")
    assert sorted(tuple(r) for r in licenses(df).collect()) == sorted(con.execute(ORACLE_SQL).fetchall())


def test_no_python_in_the_plan(spark):
    from pyspark.sql import functions as F
    plan = licenses(spark.range(3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
