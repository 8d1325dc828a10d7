"""License notices in documents: MinHash bands over overlapping windows, then exact shingle containment.  DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices as their licenses give them or as they are commonly written.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "BSD line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MIT licensed line": "Licensed under the MIT License.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0 line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}
#: Words of a shingle, the share of a template's shingles that a window must hold, the chance with which such a window is found.
SIZE, LEAST, CERTAIN = 5, 0.8, 0.9999
_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}))


def window(length: int) -> tuple[int, int]:
    """(words, step) of the windows for a template of so many words: each stretch of that length lies whole in one."""
    step = max(2, length // 4)
    return length + step - 1, step


def bands(length: int, certain: float = CERTAIN, least: float = LEAST, size: int = SIZE) -> int:
    """Bands, of one permutation each, with which a window that holds ``least`` of a template's shingles meets it in some.

    A permutation collides with the probability of the Jaccard similarity, which is smallest where the other words differ.
    """
    own = max(1, length - size + 1)
    held = math.ceil(least * own)
    whole = max(1, window(length)[0] - size + 1)
    alike = held / (whole + own - held)
    return 1 if alike >= 1 else math.ceil(math.log(1 - certain) / math.log(1 - alike))


def anchors(templates: dict[str, str], least: float = LEAST, size: int = SIZE) -> list[str]:
    """Words of which a text must hold one to match any template: shingles without them are too few for a match."""
    out: set[str] = set()
    for text in templates.values():
        w = words(text)
        open_ = [set(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
        most = math.ceil(least * len(open_))
        open_ = [s for s in open_ if not s & out]
        while len(open_) >= most:
            out.add(max(sorted({x for s in open_ for x in s}), key=lambda x: (min(len(x), 6), sum(x in s for s in open_), len(x))))
            open_ = [s for s in open_ if not s & out]
    return sorted(out)


def _shingles(w: Column, size: int) -> Column:
    """Hashes of the shingles of a word array, in place; with fewer words, none."""
    n = F.size(w) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def _keys(length: Column, count: Column, found: Column) -> Column:
    """A key for each band: length, number of the band, and the smallest hash of any shingle under the band's permutation."""
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.xxhash64(length, k, F.array_min(F.transform(found, lambda x: F.xxhash64(x, k)))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, size: int = SIZE, certain: float = CERTAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license that it holds: doc_id, license, containment (of the best window), windows, first_word.

    Words are runs of ASCII letters and digits, lower-cased.  Texts without any anchor word hold too few of any template's
    shingles and are passed over.  The others are cut into windows for each length of template, of which those without any
    template's shingle can't match either; the rest that meet a template in a band are compared with it shingle by shingle.
    Null and empty texts match nothing; rows with equal ids are one document.  Templates need at least ``size`` words.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    lengths = {name: len(words(t)) for name, t in templates.items()}
    if not templates or min(lengths.values()) < size:
        raise ValueError(f"a template needs {size} words")
    known = spark.createDataFrame([(name, lengths[name], bands(lengths[name], certain, least, size), words(t)) for name, t in templates.items()], "license string, length int, count int, w array<string>")
    known = known.select("license", "length", "count", F.array_distinct(_shingles(F.col("w"), size)).alias("own"))
    fixed = known.withColumn("keys", _keys(F.col("length"), F.col("count"), F.col("own"))).collect()  # one row a template
    own = spark.createDataFrame([(r.license, r.own) for r in fixed], "license string, own array<bigint>")
    table = spark.createDataFrame([(r.license, k) for r in fixed for k in r["keys"]], "license string, key bigint")
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    some = docs.select(F.col(id_col).alias("doc_id"), lower.alias("t"))
    any_of = None
    for a in anchors(templates, least, size):
        any_of = F.col("t").contains(a) if any_of is None else any_of | F.col("t").contains(a)
    split = some.filter(any_of).select("doc_id", F.regexp_extract_all("t", F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    hashed = split.select("doc_id", _shingles(F.col("w"), size).alias("h"))  # on a column: within the lambda an expression would be made anew for each word
    shingles = sorted({h for r in fixed for h in r.own})
    found = hashed.select("doc_id", "h", F.filter(F.transform("h", lambda x, i: F.when(x.isin(shingles), i)), lambda i: i.isNotNull()).alias("hits"))  # no filter on it: pushed down, it would make all anew for each word

    def starts(length: int) -> Column:
        """Where windows with a hit begin, a multiple of the step each."""
        wide, step = window(length)
        first = lambda p: F.greatest(F.lit(0), F.ceil((p - (wide - size)) / step)).cast("int") * step
        own = F.transform("hits", lambda p: F.sequence(first(p), (F.floor(p / step) * step).cast("int"), F.lit(step)))
        return F.transform(F.array_distinct(F.flatten(own)), lambda s: F.struct(F.lit(length).alias("length"), F.lit(wide).alias("wide"), F.lit(bands(length, certain, least, size)).alias("count"), s.alias("at")))

    places = found.select("doc_id", "h", F.explode(F.concat(*[starts(n) for n in sorted(set(lengths.values()))])).alias("w")).select("doc_id", "h", "w.*")
    cut = places.select("doc_id", "length", "count", "at", F.slice("h", F.col("at") + 1, F.col("wide") - size + 1).alias("found"))
    met = cut.select("doc_id", "length", "at", "found", F.explode(_keys(F.col("length"), F.col("count"), F.col("found"))).alias("key")).join(F.broadcast(table), "key")
    one = met.groupBy("doc_id", "license", "length", "at").agg(F.first("found").alias("found"))
    sized = one.join(F.broadcast(own), "license").withColumn("containment", F.size(F.array_intersect("found", "own")) / F.size("own"))
    return sized.filter(F.col("containment") >= least).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.count("*").alias("windows"), F.min("at").alias("first_word"))
