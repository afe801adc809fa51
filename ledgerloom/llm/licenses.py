"""License scans (operator 5): a positional rare-token index over licence templates.

Words are runs of ASCII letters, digits and non-ASCII characters with A-Z lower-cased. A first scan counts in how many
documents each template word stands, over all documents; a word's weight is its inverse document frequency. The index holds
the rare postings (word, template, position): of each template the positions of its highest weights, as many as it takes
for the rest to weigh less than the share that must be found, so every passage that matches holds one of them. A second
scan looks up the rare words of each whole text: a place and a posting propose a start (place minus position). Where a
template is proposed and its mandatory key phrase stands, word for word, near a proposed start, all its postings are
intersected with the text by relative position: a template word is found if it stands where the key phrase's place puts it,
or up to ``slack`` words before or after that, which is more the farther it is from the key phrase. So words that were put in,
left out or replaced do not unmatch what follows them. A template matches from ``MIN_SHARE`` of its weight on; a phrase
matches word for word only.

``labels`` are phrase labels and template labels, ``score`` the best share of a template's weight that was found (1 for a
phrase). Null and empty texts have no words, no labels and score 0; an empty table gives an empty result. Texts of any length are scanned whole, in
pieces of rows; repeated rows get equal results each; of passages that tie the score is the same, and all labels are given.
Extra columns are kept; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.decontaminate import NOT_WORD
from ledgerloom.llm.share import Shared
from ledgerloom.llm.text import U, flat, slices, word_hashes, words

# Phrases that stand for a licence on their own.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Short passages of public licence texts, and the phrase that must be found whole in each.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "except in compliance"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)

# Whole public licence texts and notices, and the phrase that must be found whole in each.
TEXTS = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "substantial portions of the software",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
        OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "with or without fee",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        "source and binary forms",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
        marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
        source distribution.""",
        "must not be misrepresented",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
        and by any means.""",
        "released into the public domain",
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "governing permissions and limitations",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "gnu general public license",
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
        "gnu lesser general public license",
    ),
    (
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        "gnu affero general public license",
    ),
)
MIN_SHARE = 0.7
SLACK = 3  # words by which a template word may be out of place beside the key phrase,
DRIFT = 16  # and one more for each so many words between them
CELLS = 1 << 20  # template positions compared at once


def hashes(text: str) -> np.ndarray:
    data, offsets = flat(pa.array([text], pa.large_string()))
    start, end, _ = words(data, offsets, NOT_WORD)
    return word_hashes(data, start, end)


@dataclass
class Template:
    label: str
    words: np.ndarray
    key: np.ndarray  # positions that must stand word for word
    slack: np.ndarray  # words by which each position may be out of place
    share: float  # of the weight that must be found
    phrase: bool


def templates(phrases: dict[str, str], longer: tuple[tuple[str, str, str], ...]) -> list[Template]:
    out = []
    for text, label in phrases.items():
        own = hashes(text)
        out.append(Template(label, own, np.arange(len(own)), np.zeros(len(own), np.int64), 1.0, True))
    for label, text, key in longer:
        own, must = hashes(text), hashes(key)
        at = next(i for i in range(len(own)) if len(own) >= i + len(must) and (own[i : i + len(must)] == must).all())
        place, key_at = np.arange(len(own)), np.arange(at, at + len(must))
        far = np.maximum(np.maximum(at - place, place - key_at[-1]), 0)
        out.append(Template(label, own, key_at, np.where(far > 0, SLACK + far // DRIFT, 0), MIN_SHARE, False))
    return out


class Index:
    """Postings of the templates' words; ``weigh`` chooses the rare ones by document frequency."""

    def __init__(self, phrases: dict[str, str] = PHRASES, longer: tuple[tuple[str, str, str], ...] = TEMPLATES + TEXTS):
        self.templates = templates(phrases, longer)
        self.vocabulary = np.unique(np.concatenate([t.words for t in self.templates]))
        self.named = [np.searchsorted(self.vocabulary, t.words) for t in self.templates]
        self.screen = np.zeros(1 << 16, bool)
        self.screen[(self.vocabulary >> U(48)).astype(np.int64)] = True
        self.weigh(np.zeros(len(self.vocabulary), np.int64), 0)

    def weigh(self, df: np.ndarray, docs: int) -> None:
        self.weight = np.log((docs + 1) / (df + 1)) + 1e-3
        word, template, position = [], [], []
        for i, (t, named) in enumerate(zip(self.templates, self.named, strict=True)):
            own = self.weight[named]
            order = np.argsort(-own, kind="stable")
            rest = own.sum() - np.cumsum(own[order])
            rare = order[: int(np.argmax(rest < t.share * own.sum() - 1e-9)) + 1]
            word.append(named[rare])
            template.append(np.full(len(rare), i))
            position.append(rare)
        word, template, position = (np.concatenate(x) for x in (word, template, position))
        order = np.argsort(word, kind="stable")
        self.template, self.position = template[order], position[order]
        self.postings = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))

    def propose(self, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, start, place) for each posting of each rare word, by template and start."""
        n = self.postings[at + 1] - self.postings[at]
        hit = np.repeat(np.arange(len(at)), n)
        k = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + self.postings[at][hit]
        template, start, place = self.template[k], place[hit] - self.position[k], place[hit]
        order = np.lexsort((start, template))
        return template[order], start[order], place[order]

    def find(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, vocabulary word) of template words among word hashes."""
        place = np.flatnonzero(self.screen[(own >> U(48)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, own[place])
        at[at == len(self.vocabulary)] = 0
        ok = self.vocabulary[at] == own[place]
        return place[ok], at[ok]

    def matches(self, own: np.ndarray, first: np.ndarray, place: np.ndarray, at: np.ndarray) -> Iterator[tuple[Template, int, int, float]]:
        """(template, row, start, share of its weight) of all matches among the words of a piece."""
        proposed, begin, origin = self.propose(place, at)
        origin = np.searchsorted(first, origin, "right") - 1
        wide = len(own) + 1
        stand = np.sort(at * wide + place)  # places by word
        cuts = np.searchsorted(proposed, np.arange(len(self.templates) + 1))
        for i in np.unique(proposed):
            t, named, mine = self.templates[i], self.named[i], slice(cuts[i], cuts[i + 1])
            anchor = int(t.key[np.argmax(self.weight[named[t.key]])])
            lo, hi = np.searchsorted(stand, (named[anchor] * wide, (named[anchor] + 1) * wide))
            spot = stand[lo:hi] - named[anchor] * wide
            row, start = np.searchsorted(first, spot, "right") - 1, spot - anchor
            # Starts proposed in the same row, at most the largest slack away.
            near, far = self._beside(row, start, origin[mine], begin[mine], int(t.slack.max()))
            ok = far > near
            for j in t.key:
                where = start + j
                ok &= (where >= first[row]) & (where < first[row + 1])
                ok &= own[np.clip(where, 0, len(own) - 1)] == t.words[j]
            row, start = row[ok], start[ok]
            weight = self.weight[named]
            step = max(1, CELLS // len(named))
            for c in range(0, len(start), step):
                r, b = row[c : c + step, None], start[c : c + step, None] + np.arange(len(named))
                least, most = np.maximum(b - t.slack, first[r]), np.minimum(b + t.slack, first[r + 1] - 1)
                found = np.searchsorted(stand, named * wide + least) < np.searchsorted(stand, named * wide + most, "right")
                share = ((found & (least <= most)) * weight).sum(1) / weight.sum()
                for k in np.flatnonzero(share >= t.share - 1e-12).tolist():
                    yield t, int(r[k, 0]), int(start[c + k]), min(float(share[k]), 1.0)

    @staticmethod
    def _beside(row: np.ndarray, start: np.ndarray, rows: np.ndarray, starts: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """For each (row, start) the range of the proposals, in order of row and start, that are of that row and near."""
        every = np.concatenate([start, starts])
        low = int(every.min()) - slack
        span = int(every.max()) + slack + 1 - low
        keys = np.sort(rows * span + (starts - low))
        mid = row * span + (start - low)
        return np.searchsorted(keys, mid - slack), np.searchsorted(keys, mid + slack, "right")


def _count(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(len(index.vocabulary), np.int64), 0
    for batch in batches:
        for piece in slices(batch, "text"):
            data, offsets = flat(piece.column("text"))
            start, end, first = words(data, offsets, NOT_WORD)
            place, at = index.find(word_hashes(data, start, end))
            row = np.searchsorted(first, place, "right") - 1
            df += np.bincount(np.unique(row * len(df) + at) % len(df), minlength=len(df))
            docs += piece.num_rows
    word, n = np.append(np.arange(len(df)), -1), np.append(df, docs)
    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])


def _scan(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "_text"):
            rows = piece.num_rows
            data, offsets = flat(piece.column("_text"))
            start, end, first = words(data, offsets, NOT_WORD)
            own = word_hashes(data, start, end)
            place, at = index.find(own)
            n_base, score = np.zeros(rows, np.int64), np.zeros(rows)
            least, most = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            base: list[set[str]] = [set() for _ in range(rows)]
            every: list[set[str]] = [set() for _ in range(rows)]
            for t, r, b, share in index.matches(own, first, place, at):
                every[r].add(t.label)
                score[r] = max(score[r], share)
                if t.phrase:
                    base[r].add(t.label)
                    n_base[r] += 1
                    least[r], most[r] = min(least[r], b - first[r]), max(most[r], b - first[r])
            none = most < 0
            added = [
                pa.array(np.diff(first).astype(np.int64)), pa.array(n_base),
                pa.array(least, mask=none), pa.array(most, mask=none),
                pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(sorted(x)) for x in every], pa.string()), pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *added], [*piece.schema.names[:-1], *ADDED.names])


ADDED = (
    T.StructType()
    .add("n_words", T.LongType()).add("n_base", T.LongType()).add("first_word", T.LongType()).add("last_word", T.LongType())
    .add("base_labels", T.StringType()).add("labels", T.StringType()).add("score", T.DoubleType())
)


def scan(docs: DataFrame, text_col: str = "text", index: Index | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    spark, names, index = docs.sparkSession, docs.columns, index or Index()
    text = F.col(f"`{text_col}`").cast("string")
    shared = Shared(spark, index)
    counts = docs.select(text.alias("text")).mapInArrow(lambda it: _count(it, shared.value), "word long, n long")
    df, total = np.zeros(len(index.vocabulary), np.int64), 0
    for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r["word"] < 0:
            total = r["n"]
        else:
            df[r["word"]] = r["n"]
    index.weigh(df, total)
    weighed = Shared(spark, index)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], text.alias("_text"))
    kind = T.StructType([*rows.schema.fields[:-1], *ADDED.fields])
    done = rows.mapInArrow(lambda it: _scan(it, weighed.value), kind)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in ADDED.names], *ADDED.names)
