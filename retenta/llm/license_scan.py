"""Licence scan by canonical digests.

A text is brought to a canonical form (lower case, copyright statements dropped, equivalent
spellings made one, punctuation and white space reduced to single spaces) and hashed; the
digests of entire texts are hash-joined to those of known licences. The units that are
looked up are each document's whole text and each of its lines, since a notice usually
stands on a line of its own. The known list is fixed and small, so it is broadcast: the
notices below, the SPDX ids and the full texts in ``licenses``, with and without title.

Cases: null and empty texts and lines without letters match nothing; repeated rows are
scanned row by row; equal digests in the known list must not name different licences; an
empty table gives an empty table; other columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retenta.llm.staging import text_of

ROWS_AT_ONCE = 64

# Spellings that count as the same word (the first becomes the second).
SPELLINGS = [
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("organis", "organiz"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("fulfil ", "fulfill "),
    ("v 2 0", "version 2 0"),
    ("cc by nc", "creative commons by nc"),
]

# Texts of known licences and of the notices that stand for them.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice"
        ' shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY'
        " OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
        " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR"
        " THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED"
        ' "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF'
        " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL"
        " DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,"
        " NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the'
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
        ' law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES'
        " OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and"
        " limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: the full texts (a file a licence) and the SPDX ids
LICENSES = resources.files("retenta.llm") / "licenses"
# Title lines of texts that are known without one, or with another.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD License"],
}
END = "END OF TERMS AND CONDITIONS"
PLACEHOLDER = "Copyright [yyyy] [name of copyright owner]"

MARKS = ("copyright", "©", "(c)")
YEAR = re.compile("[0-9]{4}")
ALL_RIGHTS = re.compile(r"[\x20\t]*all rights reserved[.]?[\x20\t]*")
#: what is neither letter nor digit, but for line ends
PUNCTUATION = re.compile(r"[^\w\n]+")
#: where a notice begins on a line that also has a copyright statement
NOTICE = re.compile(
    r"(?:(?:this|the)\x20\w+(?:\x20\w+)?\x20is\x20)?(?:licen[cs]ed|released|distributed)\x20under|spdx-licen[cs]e-identifier|permission\x20is\x20hereby\x20granted"
    r"|permission\x20to\x20use,|redistribution\x20and\x20use\x20in|this\x20is\x20free\x20and\x20unencumbered"
)


def is_copyright_line(line: str) -> bool:
    """Whether a lower-case line names a copyright holder with a year or claims all rights."""
    first = min((at for mark in MARKS if (at := line.find(mark)) >= 0), default=-1)
    return (first >= 0 and YEAR.search(line, first) is not None) or ALL_RIGHTS.fullmatch(line) is not None


def without_copyright(line: str) -> str:
    """What a lower-case copyright line has besides its statement: the notice before the
    mark, or after it from the notice's beginning, or nothing."""
    first = min((at for mark in MARKS if (at := line.find(mark)) >= 0), default=0)
    before, after = NOTICE.search(line, 0, first), NOTICE.search(line, first)
    return f"{line[:first] if before else ''} {line[after.start():] if after else ''}".strip()


def spelled(form: str) -> str:
    for other, one in SPELLINGS:
        form = form.replace(other, one)
    return form


def canonical(text: str) -> tuple[str, list[str]]:
    """The forms whose digests identify a licence: of the entire text and of each line. Both
    take the same steps; a spelling of two words may run over a line's end in the former."""
    low = text.lower()
    if any(x in low for x in (*MARKS, "all rights reserved")):
        low = "\n".join(without_copyright(x) if is_copyright_line(x) else x for x in low.split("\n"))
    plain = PUNCTUATION.sub(" ", low.replace("_", " "))
    whole = " ".join(spelled(f" {' '.join(plain.split())} ").split())
    lines = spelled(f" {plain} ".replace("\n", " \n ")).split("\n")
    return whole, [" ".join(x.split()) for x in lines]


def digest(form: str) -> bytes | None:
    """SHA-256 of a canonical form; null where nothing is left of the text."""
    return hashlib.sha256(form.encode()).digest() if form else None


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): KNOWN, then the full texts, whole and up to their terms' end, with
    and without their first paragraph and with other titles, and the SPDX ids. Where two
    have the same form, the first holds."""
    found = list(KNOWN)
    texts = [(n, x) for n, x in KNOWN if n in ("MIT", "ISC") and len(x) > 400]
    files = sorted((f for f in LICENSES.iterdir() if f.name.endswith(".txt") and f.name != "spdx_ids.txt"), key=lambda f: f.name)
    texts += [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files]
    for name, text in texts:
        bodies = [text, re.sub(r"(?m)^\s*[123]\. (?=Redistrib|Neither)", "* ", text)] if name.startswith("BSD") else [text]
        if END in text:
            bodies.append(text[: text.index(END) + len(END)])
            bodies.append(text[: text.index(END)])
        bodies += [x.replace(PLACEHOLDER, "") for x in bodies if PLACEHOLDER in x]
        for body in bodies:
            _, _, rest = body.strip().partition("\n\n")
            plain = rest or body
            found += [(name, body), (name, plain), *[(name, f"{title}\n\n{plain}") for title in TITLES.get(name, [])]]
    found += [(x, f"SPDX-License-Identifier: {x}") for x in (LICENSES / "spdx_ids.txt").read_text().split()]
    first: dict[bytes, tuple[str, str]] = {}
    for name, body in found:
        first.setdefault(digest(canonical(body)[0]), (name, body))
    return list(first.values())


def known_digests(spark, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license), a row a digest, of a fixed list of texts."""
    rows = [(bytearray(d), name) for name, body in known or known_texts() if (d := digest(canonical(body)[0]))]
    return spark.createDataFrame(rows, "digest binary, license string").groupBy("digest").agg(F.min("license").alias("license"))


def digests(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``__digests``: of the entire text, then of each line."""
    chosen = docs.select(*[F.col(c) for c in keep], text_of(text).alias("__text"))
    schema = T.StructType([*[f for f in chosen.schema.fields if f.name != "__text"], T.StructField("__digests", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                found = []
                for value in part.column("__text"):
                    whole, lines = canonical(value.as_py())
                    found.append([digest(whole), *map(digest, lines)])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(found, pa.list_(pa.binary()))], [*keep, "__digests"])

    return chosen.mapInArrow(run, schema)


def scan(docs: DataFrame, known: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """For each row its ``keep`` columns, ``whole_license`` (the licence that the entire text
    is, or null), ``licenses`` (those of its lines, sorted, each once) and ``n_lines`` (how
    many lines are a licence's text). Kept columns of these names give way."""
    keep = [c for c in keep if c.lower() not in ("whole_license", "licenses", "n_lines", "__row", "__digests")]
    rows = digests(docs, keep, text).withColumn("__row", F.monotonically_increasing_id())
    found = (
        rows.select("__row", *keep, F.posexplode("__digests").alias("__unit", "__digest"))
        .join(F.broadcast(known.select(F.col("digest").alias("__digest"), F.col("license").alias("__license"))), "__digest", "left")
        .filter("__unit = 0 OR __license IS NOT NULL")  # a row keeps its first unit; lines without a licence end here
    )
    in_line = (F.col("__unit") > 0) & F.col("__license").isNotNull()
    return (
        found.groupBy("__row", *keep)
        .agg(
            F.max(F.when(F.col("__unit") == 0, F.col("__license"))).alias("whole_license"),
            F.array_sort(F.collect_set(F.when(in_line, F.col("__license")))).alias("licenses"),
            F.count(F.when(in_line, 1)).alias("n_lines"),
        )
        .drop("__row")
    )
