"""License scans in SQL functions only, with a positional index of rare words.

Each template has a mandatory key phrase inside a longer notice. The document frequency of every licence word over all
documents gives its IDF, and a template is indexed under the highest-IDF word of its key phrase. In a file, only the
places of indexed words are looked at: a place and the word's offset in the template give where the template would
begin, the second rarest word must then stand at its own offset, and last the whole key phrase is verified. The score
is the IDF-weighted share of the notice's words that stand at their relative positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import word_array

# Label, the notice or licence text, its key phrase. Words are lower case; the first three keys are the base phrases.
TEMPLATES = (
    ("mit", "released under the mit license", "under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
     "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
     "see the license for the specific language governing permissions and limitations under the license", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
     "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
     "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
     "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose "
     "and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
     "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
     "permission is hereby granted free of charge to any person obtaining a copy"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
     "the free software foundation either version 2 of the license or at your option any later version",
     "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
     "the free software foundation either version 3 of the license or at your option any later version",
     "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
     "by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published "
     "by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
     "you can obtain one at https mozilla org mpl 2 0", "subject to the terms of the mozilla public license v 2"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
     "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in "
     "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
     "materials provided with the distribution", "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
     "copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "released under the isc license", "isc license"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "released under cc0 1 0 universal", "cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
     "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
     "free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
     "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter "
     "it and redistribute it freely subject to the following restrictions", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("mit", "the mit license", "the mit license"),
)
N_BASE = 3


def idf(files: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """ln((files + 1) / (files with the word + 1)) for each word, over all files (`words`); as many rows as words."""
    every = "\x00"  # no word: counts the files
    held = F.concat(F.array(F.lit(every)), F.array_intersect("words", F.array(*map(F.lit, vocabulary))))
    counts = {r.word: r.n for r in files.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = counts.get(every, 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def _phrase_at(words: Column, start: Column, phrase: list[str]) -> Column:
    return F.slice(words, start + 1, F.lit(len(phrase))) == F.array(*map(F.lit, phrase))


def scan(docs: DataFrame, templates: tuple = TEMPLATES, n_base: int = N_BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of `docs` (doc_id, text).

    n_base counts all places of the key phrases of the first `n_base` templates, first_word and last_word are the
    smallest and largest of their first words, counted from 0, or missing. Labels are distinct, sorted and joined with
    commas, empty if there are none. The score is 0 without a label, else that of the best place, up to 1. A missing
    text is empty and has no words; repeated rows repeat; an empty table gives an empty result.
    """
    files = docs.select("doc_id", word_array(docs["text"]).alias("words"))
    split = [(label, notice.split(), key.split()) for label, notice, key in templates]
    weight = idf(files, sorted({w for _, notice, _ in split for w in notice}))
    rare = []  # for each template, offsets in its key phrase by falling IDF
    for _, _, key in split:
        rare.append(sorted(range(len(key)), key=lambda i: (-weight[key[i]], i)))
    indexed = sorted({key[order[0]] for (_, _, key), order in zip(split, rare)})

    words, index = F.col("words"), F.array(*map(F.lit, indexed))
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(indexed))
    none = F.array().cast("array<struct<w: string, i: int>>")
    files = files.select("doc_id", "words", F.when(F.arrays_overlap(words, index), hits).otherwise(none).alias("hits"))
    nowhere = F.array().cast("array<int>")
    places, scores = [], []
    for n, ((_, notice, key), order) in enumerate(zip(split, rare)):
        first, second = order[0], order[min(1, len(order) - 1)]
        starts = F.transform(F.filter("hits", lambda h: h["w"] == key[first]), lambda h: h["i"] - first)
        fits = lambda s: (s >= 0) & (F.get(words, s + second) == key[second]) & _phrase_at(words, s, key)
        places.append(F.when(F.size("hits") > 0, F.filter(starts, lambda s: F.when(s >= 0, fits(s)).otherwise(False))).otherwise(nowhere).alias(f"t{n}"))
        lead = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        whole = sum(weight[w] for w in notice)

        def share(s: Column) -> Column:
            begin = F.greatest(s - lead, F.lit(0))
            cut = begin - (s - lead)  # words of the notice that would stand before the file
            there = F.slice(words, begin + 1, F.lit(len(notice)) - cut)
            pattern = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(weight[w]).alias("x")) for w in notice])
            same = F.zip_with(F.slice(pattern, cut + 1, F.lit(len(notice)) - cut), there, lambda p, w: F.when(p["w"] == w, p["x"]).otherwise(0.0))
            got = F.aggregate(same, F.lit(0.0), lambda a, x: a + x)
            return F.least(F.lit(1.0), F.round(got / whole, 6)) if whole > 0 else F.lit(1.0)

        best = F.aggregate(f"t{n}", F.lit(0.0), lambda a, s: F.greatest(a, share(s)))
        scores.append(F.when(F.size(f"t{n}") > 0, best).otherwise(0.0))
    files = files.select("doc_id", "words", *places)
    base = F.concat(*[F.col(f"t{n}") for n in range(n_base)])

    def labels(upto: int) -> Column:
        found = F.array(*[F.when(F.size(f"t{n}") > 0, F.lit(split[n][0])) for n in range(upto)])
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(found))), ",")

    return files.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        labels(n_base).alias("base_labels"),
        labels(len(split)).alias("labels"),
        F.greatest(*scores).alias("score"),
    )
