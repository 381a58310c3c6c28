"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised and mapped to the identifier
of a known licence sentence, or to none.  The identifiers of neighbouring
sentences form a sequence, and ordered rules claim stretches of it: an earlier
rule takes its matches before a later one is tried, so the sentences of a long
notice aren't read as the short ones they contain.  Everything happens within
the row of a text; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import let, read

# fixed values: sentences of public licence notices, by identifier, as they
# are normalised, but for the dot of version numbers
SENTENCES = {
    "mit-name": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-2-name": "licensed under the apache license version 2.0",
    "apache-2-the-license": "licensed under the apache license version 2.0 the license",
    "apache-2-compliance": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at",
    "apache-2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-3-name": "this work is licensed under the gnu general public license version 3",
    "gpl-2-name": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-free-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    # the same notices as BREAK cuts them, at a colon, semicolon or "v. "
    "gpl-program": "this program is free software",
    "gpl-3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-either-3": "either version 3 of the license or at your option any later version",
    "gpl-either-2": "either version 2 of the license or at your option any later version",
    "gpl-version-3": "version 3 of the license",
    "gpl-version-2": "version 2 of the license",
    "gpl-useful": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-even": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-2-terms-v": "this source code form is subject to the terms of the mozilla public license v",
    "apache-2-url": "http www apache org licenses license 2.0",
    "lgpl-library": "this library is free software",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl-either-2.1": "either version 2.1 of the license or at your option any later version",
    "lgpl-2.1-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl-useful": "this library is distributed in the hope that it will be useful but without any warranty",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "lgpl-received": "you should have received a copy of the gnu lesser general public license along with this library",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-2-terms": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "cc-by-name": "licensed under cc by 4.0",
    "cc-by-sa-name": "licensed under cc by sa 4.0",
    "cc-by-nc-name": "licensed under cc by nc 4.0",
    "cc-by-nd-name": "licensed under cc by nd 4.0",
    "cc0-name": "this work is dedicated to the public domain under cc0 1.0",
    "reserved": "all rights reserved",
}

#: Published forms of one sentence each: licence, its sentences.
FORMS = (
    ("MIT", ("this project is licensed under the mit license", "this software is licensed under the mit license", "this project is released under the mit license", "distributed under the mit license")),
    ("Apache-2.0", ("this project is licensed under the apache license 2.0", "this project is licensed under the apache license version 2.0", "licensed under the apache license 2.0", "licensed under the apache 2.0 license", "released under the apache license version 2.0", "apache license version 2.0", "apache license version 2.0 january 2004", "apache license version 2.0 january 2004 http www apache org licenses")),
    ("GPL-3.0-only", ("licensed under the gnu general public license v3.0", "licensed under the gnu general public license version 3", "this project is licensed under the gnu general public license v3.0", "gnu general public license version 3", "gnu general public license v3.0", "gnu general public license version 3 29 june 2007")),
    ("GPL-2.0-only", ("licensed under the gnu general public license v2.0", "licensed under the gnu general public license version 2", "this project is licensed under the gnu general public license v2.0", "gnu general public license version 2", "gnu general public license v2.0", "gnu general public license version 2 june 1991")),
    ("LGPL-3.0-only", ("licensed under the gnu lesser general public license v3.0", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3", "gnu lesser general public license version 3 29 june 2007")),
    ("LGPL-2.1-only", ("licensed under the gnu lesser general public license v2.1", "licensed under the gnu lesser general public license version 2.1", "gnu lesser general public license version 2.1", "gnu lesser general public license version 2.1 february 1999")),
    ("AGPL-3.0-only", ("licensed under the gnu affero general public license v3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3", "gnu affero general public license version 3 19 november 2007")),
    ("AGPL-3.0-or-later", ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",)),
    ("LGPL-3.0-or-later", ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",)),
    ("MPL-2.0", ("mozilla public license version 2.0", "licensed under the mozilla public license 2.0", "licensed under the mozilla public license version 2.0", "this project is licensed under the mozilla public license 2.0")),
    ("BSD-3-Clause", ("bsd 3 clause license", "licensed under the bsd 3 clause license", "this project is licensed under the bsd 3 clause license")),
    ("BSD-2-Clause", ("bsd 2 clause license", "licensed under the bsd 2 clause license", "this project is licensed under the bsd 2 clause license")),
    ("ISC", ("isc license", "licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies")),
    ("Zlib", ("zlib license", "licensed under the zlib license", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions")),
    ("Unlicense", ("the unlicense", "this is free and unencumbered software released into the public domain")),
    ("EPL-2.0", ("eclipse public license v 2.0", "licensed under the eclipse public license 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at")),
    ("BSL-1.0", ("boost software license version 1.0", "distributed under the boost software license version 1.0")),
    ("CC-BY-4.0", ("this work is licensed under a creative commons attribution 4.0 international license", "creative commons attribution 4.0 international license")),
    ("CC-BY-SA-4.0", ("this work is licensed under a creative commons attribution sharealike 4.0 international license",)),
    ("CC-BY-NC-4.0", ("this work is licensed under a creative commons attribution noncommercial 4.0 international license",)),
    ("CC-BY-ND-4.0", ("this work is licensed under a creative commons attribution noderivatives 4.0 international license",)),
    ("CC-BY-NC-ND-4.0", ("this work is licensed under a creative commons attribution noncommercial noderivatives 4.0 international license", "licensed under cc by nc nd 4.0")),
    ("CC-BY-NC-SA-4.0", ("this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license", "licensed under cc by nc sa 4.0")),
)
#: Licences by the identifiers of tag lines; older identifiers of some.
TAGGED = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
          "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Zlib",
          "Unlicense", "EPL-2.0", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC0-1.0")
OLDER = {f"{family}": f"{family}-only" for family in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
OLDER |= {f"{family}+": f"{family}-or-later" for family in OLDER}


def _tag_sentence(identifier: str) -> str:
    return "spdx license identifier " + identifier.lower().replace("-", " ")


SENTENCES |= {f"spdx-{name}".lower(): _tag_sentence(name) for name in [*TAGGED, *OLDER]}
SENTENCES |= {f"{name}-form-{k}".lower(): form for name, forms in FORMS for k, form in enumerate(forms)}
#: The one identifier of a licence's forms: that of an earlier sentence, or the first form's.
OWN = {"MIT": "mit-licensed", "Apache-2.0": "apache-2-name", "GPL-3.0-only": "gpl-3-name", "GPL-2.0-only": "gpl-2-name", "MPL-2.0": "mpl-2-terms",
       "CC-BY-4.0": "cc-by-name", "CC-BY-SA-4.0": "cc-by-sa-name", "CC-BY-NC-4.0": "cc-by-nc-name", "CC-BY-ND-4.0": "cc-by-nd-name"}
FORM_OF = {f"{name}-form-{k}".lower(): OWN.get(name, f"{name}-form-0".lower()) for name, forms in FORMS for k in range(len(forms))}
FORM_OF |= {f"spdx-{old}".lower(): f"spdx-{name}".lower() for old, name in OLDER.items()}

#: (licence, identifiers in order); the first rule that matches claims the sentences.
RULES = (
    ("Apache-2.0", ("apache-2-the-license", "apache-2-compliance", "apache-2-copy", "apache-2-url", "apache-2-as-is", "apache-2-see")),
    ("GPL-3.0-or-later", ("gpl-program", "gpl-3-terms", "gpl-useful", "gpl-even", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-program", "gpl-2-terms", "gpl-useful", "gpl-even", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-program", "gpl-terms", "gpl-either-3", "gpl-useful", "gpl-even", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-program", "gpl-terms", "gpl-either-2", "gpl-useful", "gpl-even", "gpl-details")),
    ("LGPL-2.1-or-later", ("lgpl-library", "lgpl-terms", "lgpl-either-2.1", "lgpl-useful", "gpl-even", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl-library", "lgpl-2.1-terms", "lgpl-useful", "gpl-even", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl-library", "lgpl-terms", "gpl-either-3", "lgpl-useful", "gpl-even", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl-terms", "lgpl-either-2.1")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-terms",)),
    ("LGPL-3.0-or-later", ("lgpl-terms", "gpl-either-3")),
    ("GPL-3.0-or-later", ("gpl-3-terms",)),
    ("GPL-2.0-or-later", ("gpl-2-terms",)),
    ("GPL-3.0-or-later", ("gpl-terms", "gpl-either-3")),
    ("GPL-2.0-or-later", ("gpl-terms", "gpl-either-2")),
    ("GPL-3.0-only", ("gpl-terms", "gpl-version-3")),
    ("GPL-2.0-only", ("gpl-terms", "gpl-version-2")),
    ("MPL-2.0", ("mpl-2-terms-v",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-2-the-license", "apache-2-compliance", "apache-2-copy", "apache-2-as-is", "apache-2-see")),
    ("Apache-2.0", ("apache-2-the-license", "apache-2-compliance")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-free-2", "gpl-hope", "gpl-details")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-free-2",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-title", )),
    ("MIT", ("mit-title-short",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-licensed",)),
    ("Apache-2.0", ("apache-2-the-license",)),
    ("Apache-2.0", ("apache-2-name",)),
    ("GPL-3.0-only", ("gpl-3-name",)),
    ("GPL-2.0-only", ("gpl-2-name",)),
    ("MPL-2.0", ("mpl-2-terms",)),
    ("CC-BY-4.0", ("cc-by-name",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-name",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-name",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-name",)),
    ("CC0-1.0", ("cc0-name",)),
    *((name, (f"spdx-{name}".lower(),)) for name in TAGGED),
    *((name, (f"{name}-form-0".lower(),)) for name, _ in FORMS if name not in OWN),
    ("all-rights-reserved", ("reserved",)),
)

_SPACE = r"[\x20\x09-\x0D]"
#: A sentence ends at a mark that white space or the end follows, at a colon
#: or semicolon before white space, and at an empty line; the number of a list
#: item that follows is no sentence of its own.
BREAK = rf"([.!?]+({_SPACE}+|$)|[:;]{_SPACE}+|\n{_SPACE}*\n)({_SPACE}*\(?[0-9]{{1,2}}[.)]{_SPACE}+)?"
#: A tag line's mark, and the expression that stands after it: identifiers joined by OR, AND or WITH.
TAG = r"(?i)spdx-license-identifier:[\x20\t]*"
_ID = r"[A-Za-z0-9]([A-Za-z0-9.+-]*[A-Za-z0-9+])?"
EXPRESSION = rf"^([\x20\t(]*{_ID}([\x20\t()]+(OR|AND|WITH)[\x20\t(]+{_ID})*[\x20\t)]*)"
OPERAND, EXCEPTION = r"[\x20\t()]+(OR|AND)[\x20\t()]+", r"[\x20\t)]+WITH[\x20\t].*"
#: Each known sentence holds one of these; a text without any has none of them.
HINTS = ("licens", "redistribution", "permission", "reserved", "cc0", "software", "warranty")
# the same text for Java's and for RE2's regular expressions
_DOT, _REST = r"([0-9])\.([0-9])", r"[^\p{L}\p{N}+_]+"
KNOWN = {text.replace(".", "_"): FORM_OF.get(name, name) for name, text in SENTENCES.items()}
WORDS = {name: text.count(" ") + 1 for name, text in SENTENCES.items() if FORM_OF.get(name, name) == name}


def normalised(sentence: Column) -> Column:
    """Lower case; a dot between digits as _ (twice: matches don't overlap);
    anything else but letters, digits, + and _ as one space."""
    s = F.regexp_replace(F.lower(sentence), _DOT, "$1_$2")
    return F.trim(F.regexp_replace(F.regexp_replace(s, _DOT, "$1_$2"), _REST, " "))


def untagged(text: Column) -> Column:
    """A text whose tag lines are sentences of their own, one for each
    identifier of an expression, without the colon that would cut them;
    exceptions (WITH) don't change a licence."""
    def sentences(part: Column) -> Column:
        expression = F.regexp_extract(part, EXPRESSION, 1)
        operands = F.transform(F.split(expression, OPERAND), lambda o: F.concat(F.lit("SPDX-License-Identifier "), F.regexp_replace(o, EXCEPTION, "")))
        return F.concat(F.lit("\n\n"), F.array_join(operands, "\n\n"), F.lit("\n\n"), F.substr(part, F.length(expression) + 1))

    def tagged(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, TAG), lambda p, i: F.when(i == 0, p).otherwise(sentences(p))), "")

    return F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), tagged(text)).otherwise(text)


def identified(text: Column, lines: bool) -> Column:
    """Identifiers of a text's sentences in order, empty for unknown ones; a
    line break ends a sentence with ``lines`` and is a space without."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    parts = F.filter(F.transform(F.split(text, BREAK + (r"|\n" if lines else "")), normalised), lambda s: s != "")
    return F.transform(parts, lambda s: F.coalesce(F.try_element_at(known, s), F.lit("")))


def known_words(ids: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    return F.aggregate(ids, F.lit(0), lambda a, i: a + F.coalesce(F.try_element_at(words, i), F.lit(0)))


def claimed(ids: Column, rules) -> Column:
    """(license, matches) of each rule that matched, in the order of the
    rules.  The sequence is one string of |identifier| marks; what a rule
    matches becomes an unknown sentence before the next rule is tried."""
    sequence = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "")
    start = F.struct(sequence.alias("left"), F.array().cast("array<struct<license:string,matches:int>>").alias("found"))
    table = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(_mark(seq)).alias("mark")) for name, seq in rules])

    def step(a: Column, r: Column) -> Column:
        def taken(rest: Column) -> Column:
            n = F.length(rest) - F.length(F.replace(rest, F.lit("*"), F.lit("")))
            row = F.struct(r["license"].alias("license"), n.cast("int").alias("matches"))
            return F.struct(F.replace(rest, F.lit("*"), F.lit("||")).alias("left"), F.array_append(a["found"], row).alias("found"))

        return F.when(F.contains(a["left"], r["mark"]), let(F.replace(a["left"], r["mark"], F.lit("*")), taken)).otherwise(a)

    return F.aggregate(table, start, step, lambda a: a["found"])


def _mark(sequence) -> str:
    return "".join(f"|{i}|" for i in sequence)


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """``key``, licenses (sorted, distinct, joined by a blank; empty if there
    is none), n_matches, n_sentences (known licence sentences), identifiers
    (their sequence, joined by a blank) of every row.

    A tag line (``SPDX-License-Identifier: MIT OR Apache-2.0``) gives the
    licences of its expression.  A text is read line by line and across its line breaks (for notices that
    are set in lines); the reading that knows more words counts, the first of
    equals.  Null, empty and other texts without a known sentence have no
    licence.  Equal texts get equal results, repeated rows stay separate; an
    empty table gives an empty result; other columns are not read.
    """
    none = F.array().cast("array<string>")

    def both(t: Column) -> Column:
        return let(identified(t, True), lambda a: let(identified(t, False), lambda b: F.when(known_words(b) > known_words(a), b).otherwise(a)))

    def hinted(t: Column) -> Column:
        low = F.lower(t)
        return let(low, lambda x: _any([F.contains(x, F.lit(h)) for h in HINTS]))

    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), let(t, lambda x: F.when(hinted(x), let(untagged(x), both)).otherwise(none)).alias("_ids"))
    own = F.filter("_ids", lambda i: i != "")
    found = F.when(F.size(own) > 0, claimed(F.col("_ids"), rules)).otherwise(F.array().cast("array<struct<license:string,matches:int>>"))
    return rows.select("_key", own.alias("_own"), found.alias("_found")).select(
        F.col("_key").alias(key),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_found", lambda f: f["license"]))), " ").alias("licenses"),
        F.aggregate("_found", F.lit(0), lambda a, f: a + f["matches"]).cast("long").alias("n_matches"),
        F.size("_own").cast("long").alias("n_sentences"),
        F.array_join("_own", " ").alias("identifiers"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(read(spark, sf_dir, "documents", "doc_id", "text"))


def _sql() -> str:
    """The same over DuckDB's lists; a column for each rule's rest and count."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def ids(pattern: str) -> str:
        dot = f"regexp_replace(regexp_replace(lower(p), {quoted(_DOT)}, '\\1_\\2', 'g'), {quoted(_DOT)}, '\\1_\\2', 'g')"
        parts = f"list_transform(regexp_split_to_array(t, {quoted(pattern)}), lambda p: trim(regexp_replace({dot}, {quoted(_REST)}, ' ', 'g')))"
        return f"list_transform(list_filter({parts}, lambda s: s <> ''), lambda s: coalesce(known[s], ''))"

    def as_map(pairs) -> str:
        return "MAP {" + ", ".join(f"{quoted(k)}: {v}" for k, v in pairs) + "}"

    hints = " OR ".join(f"contains(lower(t), {quoted(h)})" for h in HINTS)
    steps, counts = [], []
    for i, (name, seq) in enumerate(RULES):
        left = "s" if i == 0 else f"replace(r{i - 1}, '*', '||')"
        steps.append(f"replace({left}, {quoted(_mark(seq))}, '*') AS r{i}, length(r{i}) - length(replace(r{i}, '*', '')) AS n{i}")
        counts.append(f"CASE WHEN n{i} > 0 THEN {quoted(name)} END")
    total = " + ".join(f"n{i}" for i in range(len(RULES)))
    return f"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
tags AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (
  SELECT doc_id, regexp_split_to_array(t, {quoted(TAG)}) AS p FROM given WHERE contains(lower(t), 'spdx-license-identifier:'))),
expr AS (SELECT *, regexp_extract(part, {quoted(EXPRESSION)}, 1) AS e FROM tags),
plain AS (SELECT doc_id, string_agg(CASE WHEN i = 1 THEN part ELSE chr(10) || chr(10) || array_to_string(list_transform(regexp_split_to_array(e, {quoted(OPERAND)}),
    lambda o: 'SPDX-License-Identifier ' || regexp_replace(o, {quoted(EXCEPTION)}, '')), chr(10) || chr(10)) || chr(10) || chr(10) || substr(part, length(e) + 1) END, '' ORDER BY i) AS t
  FROM expr GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(plain.t, given.t) AS t, {as_map((k, quoted(v)) for k, v in KNOWN.items())} AS known,
                      {as_map((k, v) for k, v in WORDS.items())} AS words FROM given LEFT JOIN plain USING (doc_id)),
read AS (SELECT doc_id, words, CASE WHEN {hints} THEN {ids(BREAK + '|' + chr(92) + 'n')} ELSE [] END AS a,
                CASE WHEN {hints} THEN {ids(BREAK)} ELSE [] END AS b FROM texts),
best AS (SELECT doc_id, CASE WHEN coalesce(list_sum(list_transform(b, lambda i: coalesce(words[i], 0))), 0)
                                > coalesce(list_sum(list_transform(a, lambda i: coalesce(words[i], 0))), 0) THEN b ELSE a END AS ids FROM read),
marked AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: '|' || i || '|'), '') AS s FROM best),
ruled AS (SELECT doc_id, ids, {', '.join(steps)} FROM marked)
SELECT doc_id,
       array_to_string(list_sort(list_distinct(list_filter([{', '.join(counts)}], lambda x: x IS NOT NULL))), ' ') AS licenses,
       CAST({total} AS BIGINT) AS n_matches,
       CAST(len(list_filter(ids, lambda i: i <> '')) AS BIGINT) AS n_sentences,
       array_to_string(list_filter(ids, lambda i: i <> ''), ' ') AS identifiers
FROM ruled"""


ORACLE_SQL = _sql()
