"""License scans by canonical digest lookup; built-in functions only.

A text is brought to a canonical form: lower case, copyright lines dropped (behind comment marks too, and those that
name a holder without a year), equivalent spellings made one, everything but letters and digits, so comment marks as well,
a single space. The SHA-256 of the whole form is looked up among the digests of known licence texts, and that of each
line that may be a notice among the digests of known notices. Known texts are a parameter: a dictionary, by default the
texts here and in ``license_texts``, and a folder of further text files named by licence.

Defined results: a null text or one without a letter or digit has no digest match (license_id null); several known
texts with one canonical form go by the first id in code-point order; repeated rows are judged one by one; an empty
table gives an empty table; extra columns are ignored. A very long text is canonical as a whole, in one row, a few times
its size. The digests of known texts that the driver holds are broadcast, 64 characters and an id each; with a folder Spark
decides by the table's size. Lines are looked up within the row that holds them; no row is split or gathered.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, literal_rows

# Public licence texts and notices, as their authors publish them.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
ISC = """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_BSD_HEAD = """Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ZERO_BSD = """Copyright (C) <year> by <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
TEXTS = {"MIT": MIT, "MIT-untitled": MIT.split("\n", 2)[2], "ISC": ISC, "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL, "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "0BSD": ZERO_BSD}
TEXTS |= {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}
#: Equivalent spellings, on canonical words; the right one counts.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense",
    "acknowledgement": "acknowledgment", "analogue": "analog", "authorisation": "authorization", "behaviour": "behavior", "cancelled": "canceled",
    "favour": "favor", "fulfil": "fulfill", "initialise": "initialize", "judgement": "judgment", "labour": "labor", "merchantibility": "merchantability",
    "non infringement": "noninfringement", "organisation": "organization", "recognise": "recognize", "whilst": "while", "wilful": "willful",
    "copyright owner": "copyright holder", "copyright owners": "copyright holders", "version 2 0": "version 2", "v 2 0": "version 2",
}
#: Words that follow a capital Copyright in licence prose; any other capital word there is a holder's name.
PROSE = ("Act", "Holder", "Interest", "Law", "Licen", "Notice", "Owner", "Right", "Statement")
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(]*(?:(?i:\(c\)|copyright[ \t]*(?:\(c\)|\x{a9}|[0-9<])|all rights reserved)|\x{a9}|Copyright[ \t]+\p{Lu})[^\n]*"
#: Lines without any of these are no notice; those with one are looked up.
NOTICE_HEAD = "licen[sc]e|spdx|released under"


def canonical(text: Column) -> Column:
    """Lower case without copyright lines, marks and spelling variants; words joined by one space."""
    t = F.coalesce(text, F.lit(""))
    for word in PROSE:
        t = F.replace(t, F.lit(f"Copyright {word}"), F.lit(f"copyright {word}"))
    t = F.lower(F.regexp_replace(t, COPYRIGHT_LINE, ""))
    t = F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))
    some = "|".join(sorted(SPELLINGS, key=lambda s: (-len(s), s)))
    return let(t, lambda x: F.when(x.rlike(f"(?:^| )(?:{some})(?: |$)"), _respelt(x)).otherwise(x))


def _respelt(t: Column) -> Column:
    fixed = F.concat(F.lit(" "), F.replace(t, F.lit(" "), F.lit("  ")), F.lit(" "))  # two spaces: neighbours may both match
    for wrong, right in SPELLINGS.items():
        fixed = F.replace(fixed, F.lit(" " + wrong.replace(" ", "  ") + " "), F.lit(" " + right.replace(" ", "  ") + " "))
    return F.trim(F.replace(fixed, F.lit("  "), F.lit(" ")))


def known(spark: SparkSession, texts: dict[str, str] = TEXTS, notices: dict[str, tuple[str, ...]] = NOTICES, folder: str | None = None) -> DataFrame:
    """(digest, notice, license_id): canonical digests of the licence texts and notices; files of a folder go by their stem."""
    rows = [(t, k, False) for k, t in texts.items()] + [(t, k, True) for k, ts in notices.items() for t in ts]
    table = literal_rows(spark, ("text", "license_id", "notice"), rows) if rows else spark.createDataFrame([], "text string, license_id string, notice boolean")
    if folder is not None:
        found = spark.read.text(folder, wholetext=True)
        stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[A-Za-z]+)?$", 1)
        table = table.unionByName(found.select(F.col("value").alias("text"), stem.alias("license_id"), F.lit(False).alias("notice")))
    return table.groupBy(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"), "notice").agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", texts: dict[str, str] = TEXTS, notices: dict[str, tuple[str, ...]] = NOTICES, folder: str | None = None) -> DataFrame:
    """One row per input row: id, canonical_sha256, canonical_chars, license_id, notice_ids (sorted, distinct)."""
    whole = known(df.sparkSession, texts, {}, folder).select(F.col("digest").alias("canonical_sha256"), "license_id")
    # A dozen notices: their digests become a literal map, and the lines of a row are looked up in place.
    fixed = known(df.sparkSession, {}, notices).collect() if notices else []
    notice_of = F.create_map(*[F.lit(x) for r in fixed for x in (r["digest"], r["license_id"])]).cast("map<string,string>")
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.lower(x).rlike(NOTICE_HEAD))
    digests = F.transform(lines, lambda x: F.sha2(canonical(x).cast("binary"), 256))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(digests, lambda d: F.try_element_at(notice_of, d)), lambda x: x.isNotNull())))
    form = let(canonical(F.col(text)), lambda x: F.struct(F.sha2(x.cast("binary"), 256).alias("canonical_sha256"), F.length(x).cast("long").alias("canonical_chars")))
    out = df.select(F.col(id_col), form.alias("form"), found.alias("notice_ids")).select(id_col, "form.*", "notice_ids")
    out = out.join(F.broadcast(whole) if folder is None else whole, "canonical_sha256", "left")  # texts that the driver holds
    return out.select(id_col, "canonical_sha256", "canonical_chars", F.when(F.col("canonical_chars") > 0, F.col("license_id")).alias("license_id"), "notice_ids")
