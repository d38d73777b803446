"""License scans by sentences (operator 9).

A text is cut into sentences, which may run over several lines; each is normalised (lower case, runs of anything but letters and digits become one space) and
looked up in the known license sentences. What remains of a document is the sequence of the identifiers found, in order.
Ordered rules over identifier sequences then name the licenses: a rule holds where its sequence occurs in a row, and
the identifiers it uses up are not seen by later rules. So specific rules (a grant followed by its exception) come first.

Everything is an expression on one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences as the licenses and the usual notices have them, by identifier.
SENTENCES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "apache-notice": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: Apache-2.0"],
    "apache-llvm": ["with LLVM Exceptions", "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl3-later": ["SPDX-License-Identifier: GPL-3.0-or-later", "either version 3 of the License, or (at your option) any later version"],
    "gpl-program": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-classpath": ["As a special exception, the copyright holders of this library give you permission to link this library with independent modules to produce an executable"],
    "cc-by-nc-notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-notice": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "all-rights": ["All rights reserved"],
}

# Ordered: an earlier rule uses up its sentences.
RULES = [
    ("Apache-2.0 WITH LLVM-exception", ["apache-notice", "apache-llvm"]),
    ("Apache-2.0 WITH LLVM-exception", ["apache-llvm"]),
    ("GPL-3.0-only WITH Classpath-exception-2.0", ["gpl3-notice", "gpl-classpath"]),
    ("GPL-3.0-or-later", ["gpl-program"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("proprietary", ["all-rights"]),
]

# A sentence ends at . ! ? ; before white space, at a line without letters or digits, or else at any line end that it doesn't run over;
# colons end none, since notices continue after them.
STOP = r"[.!?;]+[\x20\x09-\x0D]+"
END = "\x02"


def normal(sentence: str) -> str:
    """The Python twin of the normalisation, for the table of known sentences."""
    return " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).split())


def _known() -> dict[str, str]:
    return {normal(s): name for name, sentences in SENTENCES.items() for s in sentences}


def _text_column(text: Column, known: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order.

    The text is normalised with its line ends and sentence ends kept. A known sentence fills one line, or several from the start of the first to
    the end of the last one; comment marks at line starts fold away like other punctuation. The longest sentence from a line on counts.
    """
    if not known:
        return F.array().cast("array<string>")
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    steps = [
        (END, " "), (r"\r\n?", "\n"), (STOP, END), (rf"[^\p{{L}}\p{{N}}\n{END}]+", " "), (r"\n *\n[ \n]*", END),
        (rf"[ \n]*{END}[ \n{END}]*", END), (r" *\n *", "\n")]
    lines = F.lower(text)
    for pattern, to in steps:
        lines = F.regexp_replace(lines, pattern, to)
    lines = F.concat(F.lit(END), F.trim(lines), F.lit(END))
    sentences = "|".join(k.replace(" ", "[ \n]") for k in sorted(known, key=lambda k: (-len(k), k)) if k)
    found = F.regexp_extract_all(lines, F.lit(rf"[\n{END}]({sentences})(?=[\n{END}])"), F.lit(1))
    return F.transform(found, lambda s: F.element_at(lookup, F.translate(s, "\n", " ")))


def scan_licenses(docs: DataFrame, sentences: dict[str, list[str]] | None = None, rules: list | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, sentences (identifiers, comma-joined), licenses (names, comma-joined, sorted),
    n_licenses.

    Null and empty texts have no sentence. A text is read whole, also if it is one long sentence. Repeated rows give
    repeated rows. Names come out once each. Other columns are ignored.
    """
    known = {normal(s): n for n, of in (sentences or SENTENCES).items() for s in of}
    rest = F.concat(F.lit(","), F.array_join(F.transform("ids", lambda i: F.concat(i, F.lit(","))), ","), F.lit(","))
    found = docs.select(F.col("doc_id"), _text_column(F.coalesce("text", F.lit("")), known).alias("ids"))
    # ids stand as ",a,,b,"; a used sequence becomes ";" so that what stood around it doesn't join
    found = found.withColumn("rest", F.when(F.size("ids") > 0, rest.substr(F.lit(1), F.length(rest) - 1)).otherwise(F.lit("")))
    names = []
    for k, (name, sequence) in enumerate(rules or RULES):
        needle = "".join(f",{i}," for i in sequence)
        found = found.withColumn(f"rule{k}", F.contains("rest", F.lit(needle)))
        found = found.withColumn("rest", F.replace("rest", F.lit(needle), F.lit(";")))
        names.append(F.when(F.col(f"rule{k}"), F.lit(name)))
    licenses = F.array_sort(F.array_distinct(F.filter(F.array(*names), lambda n: n.isNotNull())))
    return found.select(
        "doc_id", F.array_join("ids", ",").alias("sentences"), F.array_join(licenses, ",").alias("licenses"),
        F.size(licenses).cast("long").alias("n_licenses"),
    )
