"""Licence identification by canonical digests: all Spark expressions, no Python on the executors.

A text is made canonical (case, punctuation, white space, copyright lines and equivalent spellings don't matter) and
its SHA-256 digest is hash-joined to those of known licence texts and notices. Both whole texts and their single lines
are looked up; a match means that the entire text, or the entire line, is the known one.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as the same word.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("non commercial", "noncommercial"), ("percent", "per cent"), ("merchantibility", "merchantability"), ("https", "http"), ("copyright holders", "copyright owners"), ("copyright holder", "copyright owner"))
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_TWO = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: SHA-256 digests of the canonical forms of whole licence texts as they are published, of the same without
#: their title, and of those with an appendix up to the end of their terms. Made by canonical(); a test makes them again.
FULL_TEXTS = {
    "Apache-2.0": (
        "7418686c7053aa062b5f4ba0ecd6a7e318f58c99e584c6faef82e5400e9ecd23",
        "675dc18f238f72930d98e1cb805e32df9085613bf6dccfb3d51b23e641f6c967",
        "e22c7971c97b3a0bbf2be043859105b303bf4d6ddfa29d6d427b5e0ee953ca34",
        "3a9547b952a88ca54c78d2b60cdd623f1fa1ab2f45765429bd811c4bd77e143d",
        "96e8ed74be80eab81f4c00b8f906e4f962b7c706dbadd8db22e2b6ae9d404877",
        "3223f9b5aa8abc89c1782d3a81a1d6b15faf80dd6b0ebb6415cc0d5f2da3e2f2",
    ),
    "Artistic-1.0-Perl": (
        "1357a9bd62a6cd762ce57365ccec76b0e1e966641d8088b1ac242233896ef822",
        "021a8d650350dc85d47f74be350ce6e0e3c86412324cdfe03cc91504363cd596",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
        "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32",
    ),
    "GFDL-1.2": (
        "84d1ed915e17aaa5b82f4ee40ec049ee8ad206bf2e5d2d146d1218be88602bbd",
        "8b1a4faa5cfb09ff71e6d7c194241622454a6a000ea9167237e0158d7299646c",
    ),
    "GFDL-1.3": (
        "d4a4f0fa89572488be676840e1bf655767a7dc5085a138f4abd486d1c1f5ae67",
        "1dbda19c7aa7e1d135ce652fa6c7ee15ce34901ad543ef0e649687611d95fc36",
    ),
    "GPL-1.0": (
        "88c0d32b6685976f91edcbb228c50498a7324b47880b82b90b4b86377ca82e38",
        "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9",
        "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0",
        "256e3d0ecfa732097e9a5b95aea8d52bd362751f607c737310f3dde263b7686f",
        "9c1cba0e3fa73a3af6aad956544deeda7b5f12c0251bbc82bd653495b9493dd8",
    ),
    "GPL-2.0": (
        "5147a46525fc36b30edbb3469564d4930add19b5b86c56d8d58e084575fd474a",
        "5e9874a182b8e50f136aed39c11d5b872aaa6c94c59b0780c37559869ffd0faa",
        "86098a2eb6cf32b7d85f76517aa2010296c2522588f6d7676bde1230c5ac9041",
        "df74d1d65189e3d4fe92e5b6d84a9591ee7a3460acfdb7914f9f390894824b94",
        "ed2838971ab3081a30bbbbc62522626c6737322758a881149c0c282f6776b0e5",
    ),
    "GPL-3.0": (
        "32d10c0db69b7ef80cac161389f3769156e6d1c8ed4ab85c436304f6a35e2809",
        "e7be52dd11d32bcd4f9b2533565f279d2a271123489364950a2eb799a9545bd9",
        "269d068058687f765d68282dcf5a4d0df2ebffa5be660a5748351d1aaeb192fa",
        "b9dc8966112066c071df18ef9b6e395a8da51ec9d30444629b4043e359b868f5",
        "564fc0bff911db6b69636a30f61b1e8dadd6b97b92e8061fdd112ae7c1d9f62b",
    ),
    "LGPL-2.0": (
        "a0bf38390cb2f2420aab34355ffae4e3a040e7648b7ba67f1e34044403228cf9",
        "c2cefe189596f86dbbdab4ca8b161c6262f8b0d574184ce87144b676eb4e7d0a",
        "3bb3f2f987ac797968f7655d8946e3fb45c8ed8e489b8090b8c2957416070991",
        "30913a2e1e0b7c556d1f0afd91152682987d924fdd3d4229e7829412ae7dbca8",
        "303f01e47e25c79e2f6b8ba49344172a19ecce0d8873a95ddb7064acc425aa37",
    ),
    "LGPL-2.1": (
        "775b78fea7d86d7b01dfe3028892476b10fc3f78b22fd69513911710f16d8da6",
        "0948f7f91046d0736fbe4b1285c1418c43656d51b8a98c2690fd48e68a51284e",
        "14d2766e74523a520125045c7df201c048aea2169d95faf662634c49a477ae7d",
        "80522cf615b67581bddbc5ef23a34b8da91f63960c0a6380b830fa8f17c488ec",
        "4b6c7487aa6d4349e99fdcc177fa3741d1237ff85e7906b1c8422d26d90b65a5",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
        "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7",
    ),
    "MPL-1.1": (
        "f7acdbee0d4664d81de2d7cd8ed816ec6b9a21e93ce84fb85ed3b6ec5ce41094",
        "539b3cf06c59325232c8a47dd6cc32bde761f94266607c2f1b3ee76463137dc7",
    ),
    "MPL-2.0": (
        "cdb5877b9b73b693216820ac5a0090510c6fd9df7c38876e551b865cce774ddd",
        "90fcd23b0846624d43b899aae459ed8041d0feb90c23f403907654edfa397784",
    ),
    "Unlicense": (
        "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229",
    ),
    "Zlib": (
        "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7",
    ),
}


def _bsd(clauses: tuple[str, ...], marks: tuple[str, ...]) -> str:
    return _BSD_HEAD + "".join(f"{m} {c}" for m, c in zip(marks, clauses, strict=True)) + _BSD_TAIL


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text): full texts of short licences, and the notices by which texts name a licence. Those of long
    licences are known by their digests alone (FULL_TEXTS)."""
    two, three = (_BSD_ONE, _BSD_TWO), (_BSD_ONE, _BSD_TWO, _BSD_THREE)
    out = [("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC), ("0BSD", _ZERO_BSD), ("Apache-2.0", _APACHE)]
    for name, clauses in (("BSD-2-Clause", two), ("BSD-3-Clause", three)):
        for marks in (("", "", ""), ("1.", "2.", "3."), ("*", "*", "*")):
            text = _bsd(clauses, marks[: len(clauses)])
            out += [(name, text), (name, f"BSD {len(clauses)}-Clause License\n{text}"), (name, f'BSD {len(clauses)}-Clause "{"Simplified" if len(clauses) == 2 else "New"}" License\n{text}')]
    named = [("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "the Apache License 2.0"), ("ISC", "the ISC License"), ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"), ("BSD-3-Clause", "the BSD License"), ("MPL-2.0", "the Mozilla Public License, Version 2.0"), ("Unlicense", "the Unlicense")]
    for title, code in (("GNU General Public License", "GPL"), ("GNU Lesser General Public License", "LGPL"), ("GNU Affero General Public License", "AGPL")):
        for version in ("2", "2.1", "3"):
            if (code, version) not in {("GPL", "2.1"), ("AGPL", "2"), ("AGPL", "2.1"), ("LGPL", "2")}:
                named += [(f"{code}-{version if '.' in version else version + '.0'}", f"the {title}, version {version}"), (f"{code}-{version if '.' in version else version + '.0'}", f"the {title} v{version}")]
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("3.0", "4.0"):
            named += [(f"CC-{kind}-{version}", f"CC {kind} {version}"), (f"CC-{kind}-{version}", f"a Creative Commons {kind} {version} License")]
    named += [("CC0-1.0", "CC0 1.0"), ("CC0-1.0", "CC0 1.0 Universal")]
    for code, name in named:
        out += [(code, f"{lead} {name}.") for lead in ("Released under", "Licensed under", "Distributed under", "Published under", "This work is licensed under", "This software is licensed under", "This file is licensed under", "This project is licensed under", "This document is licensed under", "This work is released under", "This software is released under")]
        out.append((code, f"SPDX-License-Identifier: {code}"))
    return out


def canonical(text: str) -> str:
    """The driver's form of the expression below, for the known texts."""
    out = re.sub(COPYRIGHT_LINE, " ", text.lower())
    out = re.sub(r"[^a-z0-9]+", " ", out).strip()
    for spelled, same in SPELLINGS:
        out = re.sub(rf"\b{spelled}\b", same, out)
    return out


def canonical_column(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))
    for spelled, same in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{spelled}\b", same)
    return out


def known_digests() -> list[tuple[str, str]]:
    """(digest, licence id), each digest once; a few hundred rows, from fixed texts."""
    out: dict[str, str] = {digest: code for code, digests in FULL_TEXTS.items() for digest in digests}
    for code, text in known_texts():
        out.setdefault(hashlib.sha256(canonical(text).encode()).hexdigest(), code)
    return sorted(out.items())


#: All known texts have one of these (a test holds them to it); a text or line without any can't match, and isn't digested.
CLUES = r"(?i)licen[cs]e|under cc|warrant"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, whole_license (of the entire text, null if unknown), n_license_lines, license_ids (of lines, sorted
    and comma-joined, empty if none) for every row.

    Null and empty texts match nothing; repeated rows and ids stay rows of their own; an empty table gives no rows;
    other columns are ignored. The known digests are a few hundred fixed rows, and all that is broadcast.
    """
    known = known_digests()
    small = F.broadcast(docs.sparkSession.createDataFrame(known, "digest string, whole_license string"))
    table = F.from_json(F.lit(json.dumps(dict(known))), "map<string,string>")
    body = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), body.alias("body")).withColumn("clue", F.col("body").rlike(CLUES))
    units = rows.select(
        "doc_id",
        F.when(F.col("clue"), F.sha2(canonical_column(F.col("body")), 256)).alias("digest"),
        F.when(F.col("clue"), F.filter(F.split("body", "\n"), lambda x: x.rlike(CLUES))).otherwise(F.array().cast("array<string>")).alias("lines"),
    )
    found = F.filter(F.transform("lines", lambda x: F.try_element_at(table, F.sha2(canonical_column(x), 256))), lambda x: x.isNotNull())
    joined = units.withColumn("found", found).join(small, "digest", "left")
    return joined.select("doc_id", "whole_license", F.size("found").cast("long").alias("n_license_lines"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("license_ids"))


def sql() -> str:
    """The same in DuckDB."""

    def form(x: str) -> str:
        out = f"trim(regexp_replace(regexp_replace(lower({x}), '{COPYRIGHT_LINE}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
        for spelled, same in SPELLINGS:
            out = f"regexp_replace({out}, '\\b{spelled}\\b', '{same}', 'g')"
        return out

    values = ", ".join(f"('{d}', '{c}')" for d, c in known_digests())
    return f"""
WITH known(digest, license) AS (VALUES {values}),
rows AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
lines AS (SELECT doc_id, sha256({form("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM rows) WHERE regexp_matches(line, '{CLUES}')),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ids FROM lines JOIN known USING (digest) GROUP BY doc_id)
SELECT r.doc_id, k.license AS whole_license, coalesce(f.n, 0) AS n_license_lines, coalesce(f.ids, '') AS license_ids
FROM (SELECT doc_id, CASE WHEN regexp_matches(body, '{CLUES}') THEN sha256({form("body")}) END AS digest FROM rows) r
LEFT JOIN known k ON k.digest = r.digest LEFT JOIN found f ON f.doc_id = r.doc_id"""
