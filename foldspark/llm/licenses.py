"""License recognition by sentence rules.

A text is cut into sentences, each is normalised (lower case, letters and digits only) and looked up among known
license sentences. A known sentence may also run over several of the pieces: line breaks, comment signs and the dot of an
abbreviation ("v. 2.0") cut it there. The identifiers found, in the order of the text, form a sequence. License rules are ordered:
each rule is a run of identifiers, longer and more specific ones first, and a matched run is consumed before
the next rule looks. Sentences left over are reported as unknown uses of license language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAKS = r"\n+|[.;:!?]+[\x20\x09]+|[.;:!?]+$"

# Identifier of each known sentence, normalised as by ``normalise``. Texts of public licenses.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MITRef",
    "licensed under the mit license": "MITRef",
    "this project is licensed under the mit license": "MITRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "this work is licensed under the gnu general public license version 3": "GPL3Ref",
    "licensed under the gnu general public license version 3": "GPL3Ref",
    "licensed under the gnu general public license version 2": "GPL2Ref",
    "this program is free software": "GPLFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLTerms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3Terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2Terms",
    "either version 3 of the license or at your option any later version": "GPL3Later",
    "either version 2 of the license or at your option any later version": "GPL2Later",
    "licensed under cc by nc 4 0": "CCBYNC4Ref",
    "licensed under cc by 4 0": "CCBY4Ref",
    "licensed under cc by sa 4 0": "CCBYSA4Ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBY4Ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2Ref",
    "all rights reserved": "AllRights",
}

# Ordered rules: license and the run of identifiers that proves it.
RULES = [
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("GPL-3.0-or-later", ["GPLFree", "GPLTerms", "GPL3Later"]),
    ("GPL-2.0-or-later", ["GPLFree", "GPLTerms", "GPL2Later"]),
    ("GPL-3.0-or-later", ["GPLFree", "GPL3Terms"]),
    ("GPL-2.0-or-later", ["GPLFree", "GPL2Terms"]),
    ("Apache-2.0", ["ApacheRef", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef", "ApacheComply"]),
    ("MIT", ["MITRef", "MITGrant", "MITNotice"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("MIT", ["MITRef"]),
    ("GPL-3.0-only", ["GPL3Ref"]),
    ("GPL-2.0-only", ["GPL2Ref"]),
    ("CC-BY-NC-4.0", ["CCBYNC4Ref"]),
    ("CC-BY-SA-4.0", ["CCBYSA4Ref"]),
    ("CC-BY-4.0", ["CCBY4Ref"]),
    ("MPL-2.0", ["MPL2Ref"]),
]


def normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " "))


def _run(ids: list[str]) -> str:
    return "".join(f"<{x}>" for x in ids)


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """One row a document: doc_id, n_sentences, sentence_ids, licenses (sorted, comma-joined), n_unmatched.

    ``n_sentences`` counts the pieces between breaks. Null and empty texts have no sentences. Repeated rows are judged each; other columns are ignored.
    """
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    cut = F.split(F.coalesce("text", F.lit("")), BREAKS)
    rows = docs.select("doc_id", F.filter(F.transform(cut, normalise), lambda x: x != "").alias("s"))
    # one pass over the pieces, a line each: whole pieces that make up a known sentence, the longest first
    inner = "|".join(x.replace(" ", "[ \\n]") for x in sorted(sentences, key=len, reverse=True))
    lines = F.concat(F.lit("\n"), F.array_join("s", "\n"), F.lit("\n"))
    runs = F.regexp_extract_all(lines, F.lit(f"\\n({inner})(?=\\n)"), F.lit(1))
    found = F.transform(runs, lambda x: F.get(F.transform(F.array(F.replace(x, F.lit("\n"), F.lit(" "))), lambda y: known[y]), F.lit(0)))
    rows = rows.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), found.alias("ids"))
    rows = rows.withColumn("left", F.concat(F.lit(""), F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")))
    hits = []
    for i, (name, ids) in enumerate(rules):
        rows = rows.withColumn(f"r{i}", F.when(F.contains("left", F.lit(_run(ids))), F.lit(name)))
        rows = rows.withColumn("left", F.replace("left", F.lit(_run(ids)), F.lit("|")))
        hits.append(f"r{i}")
    names = F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return rows.select(
        "doc_id",
        "n_sentences",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(names, ",").alias("licenses"),
        F.regexp_count("left", F.lit("<")).cast("bigint").alias("n_unmatched"),
    )
