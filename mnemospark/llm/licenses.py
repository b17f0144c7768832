"""License scan (native): canonical digests of texts, hash-joined to known ones.

A text is canonicalised (lower case, copyright lines dropped, punctuation and
white space folded to one space, equivalent spellings unified), digested with
SHA-256 as a whole, and joined to the digests of known licence texts.  The same
canonical digest of each line finds one-line notices inside other texts.

Everything is built from column functions.  The known table has a fixed number
of rows (``KNOWN`` and ``KNOWN_DIGESTS``; at most ``MOST_KNOWN`` when a caller
adds to it), so it is the one thing that is broadcast; documents are never
shuffled.

Defined results: a null text has a null digest and no licence; an empty text,
or one of punctuation only, has the digest of the empty canonical text, which
is no licence; repeated rows each get their result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import table

MOST_KNOWN = 10_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted"""
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_END = """. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. """
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""

#: Licence texts and one-line notices, each with its identifier.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT),
    ("MIT", "The MIT License (MIT) " + _MIT),
    ("ISC", _ISC_GRANT + _ISC_KEEP + _ISC_END),
    ("ISC", "ISC License " + _ISC_GRANT + _ISC_KEEP + _ISC_END),
    ("0BSD", _ISC_GRANT + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_END),
    ("Apache-2.0", _APACHE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)

#: Canonical digests of long licence texts, whole and without the appendix on how
#: to apply them.
KNOWN_DIGESTS = (
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.2", "84f3c9e8cdded0036378e7e6eb92ac6570731434d2fc46027f259264dc16501e"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GFDL-1.3", "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-1.1", "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
)

#: Spellings that count as the same (whole words, lower case).
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("authorised", "authorized"),
    ("noninfringement", "non infringement"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("https", "http"),
)
COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\p{N}\n]+(?:\(c\)|©|[0-9]{4})|\(c\)[^\p{L}\p{N}\n]*[0-9]{4}|©[^\n]*[0-9]{4}|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: A line can be a notice only if it holds one of these.
HINT = r"(?i)licen[cs]e"


def canonical(text: str) -> str:
    """The canonical form in plain Python, for the known texts (and for tests)."""
    body = re.sub(COPYRIGHT_LINE.replace(r"\p{L}\p{N}", r"A-Za-z0-9À-ɏ"), "", text).lower()
    words = re.findall(r"[^\W_]+", body)
    swap = dict(SPELLINGS)
    return " ".join(swap.get(w, w) for w in words)


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def folded(text: Column) -> Column:
    """Lower case, no copyright lines, punctuation and white space as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT_LINE, "")), NOT_WORD, " "))


def one_spelling(body: Column) -> Column:
    """Unify spellings; texts without any of them (nearly all) are passed through."""
    out = body
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, rf"(?<![^ ]){old}(?![^ ])", new)
    return F.when(body.rlike("|".join(old for old, _ in SPELLINGS)), out).otherwise(body)


def known_digests(
    known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS
) -> dict[str, str]:
    """digest -> identifier, of texts and of texts known by their digest alone."""
    if len(known) + len(digests) > MOST_KNOWN:
        raise ValueError(f"{len(known) + len(digests)} known texts; the broadcast side is bounded at {MOST_KNOWN}")
    return {d: name for name, d in digests} | {digest(t): name for name, t in known}


def lookup_of(names: dict[str, str]) -> Callable[[Column], Column]:
    """A function from digests to identifiers or null.  The table is one constant: small
    maps by the first byte of a digest, so a look-up doesn't pass all that is known."""
    parts: list[dict[str, str]] = [{} for _ in range(256)]
    for d, name in sorted(names.items()):
        parts[int(d[:2], 16)][d] = name
    maps = F.from_json(F.lit(json.dumps(parts)), "array<map<string,string>>")
    return lambda d: F.try_element_at(F.get(maps, F.conv(F.substring(d, 1, 2), 16, 10).cast("int")), d)


def license_scan(
    df: DataFrame,
    known: tuple[tuple[str, str], ...] = KNOWN,
    text: str = "text",
    digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS,
) -> DataFrame:
    """df with digest, license_id (of the whole text) and notice_ids (of lines)."""
    names = known_digests(known, digests)
    lookup = df.sparkSession.createDataFrame(sorted(names.items()), "_known string, license_id string")
    find = lookup_of(names)
    body = F.col(text)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(HINT))
    found = F.transform(lines, lambda x: find(F.sha2(one_spelling(folded(x)), 256)))
    ids = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    return (
        df.drop("digest", "license_id", "notice_ids", "_folded", "_known")
        .withColumn("_folded", folded(body))
        .withColumn("digest", F.sha2(one_spelling(F.col("_folded")), 256))
        .drop("_folded")
        .withColumn("notice_ids", F.when(body.isNull(), F.lit("")).otherwise(F.array_join(ids, ",")))
        .join(F.broadcast(lookup), F.col("digest") == F.col("_known"), "left")
        .drop("_known")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).select("doc_id", "digest", "license_id", "notice_ids")


def _duck_canonical(x: str) -> str:
    rx = COPYRIGHT_LINE.replace("'", "''")
    out = f"trim(regexp_replace(lower(regexp_replace({x}, '{rx}', '', 'g')), '{NOT_WORD}', ' ', 'g'))"
    out = f"(' ' || replace({out}, ' ', '  ') || ' ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


_VALUES = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests().items()))
SQL = f"""
with known(d, license_id) as (values {_VALUES}),
lines as (
  select distinct doc_id, sha256({_duck_canonical("line")}) as d
  from (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null) u
  where regexp_matches(line, '{HINT}')
), notices as (
  select doc_id, string_agg(license_id, ',' order by license_id) as ids
  from (select distinct doc_id, license_id from lines join known using (d)) n group by doc_id
)
select t.doc_id, t.digest, k.license_id, coalesce(n.ids, '') as notice_ids
from (select doc_id, sha256({_duck_canonical("text")}) as digest from documents) t
left join known k on k.d = t.digest left join notices n on n.doc_id = t.doc_id
"""
