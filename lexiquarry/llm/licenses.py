"""Licence recognition by sentences and ordered rules, in DataFrame functions only.

A text is normalised (A-Z to lower case, everything but a-z and 0-9 to single blanks, so comment signs go) and searched
for known licence sentences. Sentences end at blank lines and after . ! ? before a blank or a line end. At single line
ends, after ; and after the stop of `v.` before a number a sentence may begin or end, or go on: wrapped texts are found
as well as one-line notices. Of the known sentences that begin at one place the longest holds. The identifiers
of a document, in order, are matched against ordered rules: each rule names a run of identifiers; where it stands, its
licence is found and the run is used up, so that a longer rule listed earlier wins over its parts.

Cases: a null or empty text has no sentences and the status `none`; a repeated sentence gives a repeated identifier
and a repeated match counts once; long texts are scanned whole; other columns pass, those named as a new one give way.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import fresh, quoted, without

# Known licence sentences, normalised, and their identifiers.
SENTENCES = {
    "released under the mit license": "MitNotice",
    "licensed under the mit license": "MitNotice",
    "this project is licensed under the mit license": "MitNotice",
    "the mit license mit": "MitTitle",
    "mit license": "MitTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitCondition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "licensed under the apache license version 2 0": "ApacheNotice",
    "licensed under the apache license version 2 0 the license": "ApacheNotice",
    "apache license version 2 0 january 2004": "ApacheTitle",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheBasis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "this work is licensed under the gnu general public license version 3": "Gpl3Notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3OrLaterGrant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2OrLaterGrant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "see the gnu general public license for more details": "GplSee",
    "you should have received a copy of the gnu general public license along with this program": "GplCopy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNames",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "Mpl2Copy",
    "licensed under cc by 4 0": "CcBy4Notice",
    "licensed under cc by sa 4 0": "CcBySa4Notice",
    "licensed under cc by nc 4 0": "CcByNc4Notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4Notice",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "Lgpl21OrLaterGrant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3OrLaterGrant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "see the gnu lesser general public license for more details": "GplSee",
    "you should have received a copy of the gnu lesser general public license along with this library": "GplCopy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3OrLaterGrant",
    "see the gnu affero general public license for more details": "GplSee",
    "you should have received a copy of the gnu affero general public license along with this program": "GplCopy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "Epl2Notice",
    "distributed under the boost software license version 1 0": "BoostNotice",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "Cc0Waiver",
    "this work is dedicated to the public domain under a cc0 1 0 universal license": "Cc0Waiver",
    "this software is provided as is without any express or implied warranty": "ZlibWarranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "ZlibOrigin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "ZlibAltered",
    "this notice may not be removed or altered from any source distribution": "ZlibNotice",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BsdAdvertising",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdDisclaimer",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BsdLiability",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
}
# Names of licences in identifier lines.
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "ISC", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Zlib", "Unlicense"]
SENTENCES |= {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower()): "Spdx:" + x for x in SPDX}
# Ordered rules, a run of identifiers and the licence it states.
RULES = [
    ("MitTitle MitGrant MitCondition MitWarranty MitLiability", "MIT"),
    ("MitGrant MitCondition MitWarranty MitLiability", "MIT"),
    ("BsdGrant BsdSource BsdBinary BsdAdvertising BsdNames BsdDisclaimer BsdLiability", "BSD-4-Clause"),
    ("BsdGrant BsdSource BsdBinary BsdAdvertising BsdNames", "BSD-4-Clause"),
    ("BsdGrant BsdSource BsdBinary BsdNames BsdDisclaimer BsdLiability", "BSD-3-Clause"),
    ("BsdGrant BsdSource BsdBinary BsdDisclaimer BsdLiability", "BSD-2-Clause"),
    ("ZlibWarranty ZlibLiability ZlibGrant ZlibOrigin ZlibAltered ZlibNotice", "Zlib"),
    ("ZlibGrant ZlibOrigin ZlibAltered ZlibNotice", "Zlib"),
    ("Agpl3OrLaterGrant GplWarranty GplSee GplCopy", "AGPL-3.0-or-later"),
    ("Agpl3OrLaterGrant", "AGPL-3.0-or-later"),
    ("Lgpl3OrLaterGrant GplWarranty GplSee GplCopy", "LGPL-3.0-or-later"),
    ("Lgpl3OrLaterGrant", "LGPL-3.0-or-later"),
    ("Lgpl21OrLaterGrant GplWarranty GplSee GplCopy", "LGPL-2.1-or-later"),
    ("Lgpl21OrLaterGrant", "LGPL-2.1-or-later"),
    ("Epl2Notice", "EPL-2.0"),
    ("BoostNotice", "BSL-1.0"),
    ("Cc0Waiver", "CC0-1.0"),
    ("MitTitle MitGrant MitCondition MitWarranty", "MIT"),
    ("MitGrant MitCondition MitWarranty", "MIT"),
    ("BsdGrant BsdSource BsdBinary BsdNames", "BSD-3-Clause"),
    ("BsdGrant BsdSource BsdBinary", "BSD-2-Clause"),
    ("ApacheNotice ApacheUse ApacheCopy ApacheBasis ApacheSee", "Apache-2.0"),
    ("ApacheNotice ApacheUse", "Apache-2.0"),
    ("Gpl3OrLaterGrant GplWarranty GplSee GplCopy", "GPL-3.0-or-later"),
    ("Gpl3OrLaterGrant", "GPL-3.0-or-later"),
    ("Gpl2OrLaterGrant GplWarranty GplSee GplCopy", "GPL-2.0-or-later"),
    ("Gpl2OrLaterGrant", "GPL-2.0-or-later"),
    ("Mpl2Notice Mpl2Copy", "MPL-2.0"),
    ("Mpl2Notice", "MPL-2.0"),
    ("IscGrant", "ISC"),
    ("UnlicenseGrant", "Unlicense"),
    ("ApacheNotice", "Apache-2.0"),
    ("ApacheTitle", "Apache-2.0"),
    ("Gpl3Notice", "GPL-3.0-only"),
    ("CcByNc4Notice", "CC-BY-NC-4.0"),
    ("CcBySa4Notice", "CC-BY-SA-4.0"),
    ("CcBy4Notice", "CC-BY-4.0"),
    ("MitNotice", "MIT"),
    ("MitTitle", "MIT"),
    *[("Spdx:" + x, x) for x in SPDX],
]
#: Every known sentence has one of these; other texts and sentences need no lookup.
CUES = "licen|warrant|copyright|redistribut|unencumbered|permission|mpl|misrepresent|acknowledg|notice|public domain|in no event|waived"
#: Sentence ends of the SQL, which takes a line for a sentence: equal on texts whose known sentences stand on one line.
SENTENCE_END = r"[.!?]*[\n\r]+|[.!?]+[ \t]+"
#: Marks of normalised text: a sentence can't go on over HARD, and may end or go on at SOFT.
HARD, SOFT = "|", "\n"
#: In turn: patterns and what takes their place. Each is linear in the text, long runs of signs and line ends included.
MARKS = [
    (r"\r\n?", SOFT),
    (r"\b(v|ver|version)\.[ \t\n]+(?=[0-9])", "$1" + SOFT),
    (r"[.!?][ \t\n]+", HARD),
    (r";", SOFT + "."),
    (r"[^a-z0-9|\n.]+", " "),
    (r"\n[ \n]*\n", HARD),
    (r"[.]+", " "),
    (r"\n[ \n]*", SOFT),
    (r" +", " "),
    (r"[ \n|]*\|[ \n|]*", HARD),
    (r" \n", SOFT),
    (r"([|\n])(?:rem|dnl) ", "$1"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def known_pattern() -> str:
    """A known sentence, the longest first, between marks; the number or letter of a list item may stand before it."""
    return "(?<=[|\n])(?:[0-9a-z] )?(" + "|".join(s.replace(" ", "[ \n]") for s in sorted(SENTENCES, key=lambda s: (-len(s), s))) + ")(?=[|\n])"


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df and sentence_ids (array), licences (array, in the order of the rules), unmatched (array), licence_status."""
    new = ["sentence_ids", "licences", "unmatched", "licence_status"]
    kept = [quoted(f.name) for f in without(df, new)]
    known = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    low = F.translate(F.coalesce(quoted(text_col).cast("string"), F.lit("")), UPPER, LOWER)

    marked = F.concat(F.lit(HARD), F.translate(low, HARD, ","), F.lit(HARD))
    for pattern, mark in MARKS:
        marked = F.regexp_replace(marked, pattern, mark)
    at = F.regexp_extract_all(marked, F.lit(known_pattern()), F.lit(1))
    ids = F.transform(at, lambda s: F.element_at(known, F.translate(s, SOFT, " ")))
    ids = F.when(low.rlike(CUES), ids).otherwise(F.array().cast("array<string>"))
    out, work = df.select(*kept, ids.alias("sentence_ids")), fresh(df, "__m")

    def matched(ids_: Column) -> Column:
        """Names of the rules that match, and the sequence that is left: each rule in turn uses up its runs."""
        rules = F.array(*[F.struct(F.lit(" " + r.replace(" ", "  ") + " ").alias("run"), F.lit(n).alias("name")) for r, n in RULES])
        start = F.struct(F.concat(F.lit(" "), F.array_join(ids_, "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("names"))

        def step(acc, r):
            hit = F.contains(acc["left"], r["run"])
            return F.struct(F.when(hit, F.replace(acc["left"], r["run"], F.lit(" | "))).otherwise(acc["left"]).alias("left"), F.when(hit, F.array_append(acc["names"], r["name"])).otherwise(acc["names"]).alias("names"))

        return F.aggregate(rules, start, step)

    out = out.withColumn(work, F.when(F.size("sentence_ids") > 0, matched(F.col("sentence_ids"))))
    licences = F.coalesce(F.array_distinct(F.col(work)["names"]), F.array().cast("array<string>"))
    unmatched = F.coalesce(F.filter(F.split(F.trim(F.col(work)["left"]), "[ |]+"), lambda s: s != ""), F.array().cast("array<string>"))
    status = F.when(F.size("sentence_ids") == 0, "none").when(F.size("licences") == 0, "unknown").when(F.size("unmatched") > 0, "partial").otherwise("recognised")
    return out.withColumns({"licences": licences, "unmatched": unmatched}).withColumn("licence_status", status).drop(work)


def oracle_sql() -> str:
    """The digest of scan() over documents, in DuckDB SQL."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    sql = f"""WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SENTENCE_END}') AS parts FROM documents),
cut AS (SELECT r, generate_subscripts(parts, 1) AS pos, unnest(parts) AS s FROM docs),
hits AS (SELECT r, list(id ORDER BY pos) AS ids FROM cut JOIN known ON trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) = sentence WHERE regexp_matches(s, '{CUES}') GROUP BY r),
s0 AS (SELECT r, ids, ' ' || array_to_string(ids, '  ') || ' ' AS x FROM hits)"""
    for k, (run, _) in enumerate(RULES):
        needle = " " + run.replace(" ", "  ") + " "
        sql += f",\ns{k + 1} AS (SELECT * REPLACE (replace(x, '{needle}', ' | ') AS x), contains(x, '{needle}') AS f{k} FROM s{k})"
    n = len(RULES)
    names = ", ".join(f"CASE WHEN f{k} THEN '{name}' END" for k, (_, name) in enumerate(RULES))
    first = "list_filter([" + names + "], lambda z: z IS NOT NULL)"
    sql += f""",
named AS (SELECT r, ids, x, {first} AS every FROM s{n}),
done AS (SELECT r, ids, list_filter(every, lambda z, i: list_position(every, z) = i) AS licences, list_filter(string_split_regex(trim(x), '[ |]+'), lambda z: z <> '') AS unmatched FROM named)
SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(licences, ','), '') AS licences,
coalesce(len(unmatched), 0)::BIGINT AS n_unmatched, CASE WHEN ids IS NULL THEN 'none' WHEN len(licences) = 0 THEN 'unknown' WHEN len(unmatched) > 0 THEN 'partial' ELSE 'recognised' END AS licence_status
FROM docs LEFT JOIN done USING (r)"""
    return sql
