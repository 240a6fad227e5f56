"""Licence statements by a positional index of rare words, in DataFrame functions only.

Templates are licence wordings: whole notices, headings and identifier lines. One pass over the texts writes the positional
index: per file the places of the templates' words, function words left out. Document frequencies come from the index, and a
word weighs log(1 + N / (df + 1)): words in few documents count most, and none weighs nothing. Of a template the words with
the highest weight are looked up in the file; each occurrence gives the place where the template would start (its position less the
word's in the template), and places that only one looked-up word gives are dropped: the postings are intersected by relative
position. What is left has to hold the template's mandatory key phrase at its place. The share of the template's weight that
stands at its places is the score, and a label is given from ``LEAST_SCORE`` on. So the frequencies of the corpus decide what is
looked up and how much a missing word costs, while a notice that stands whole scores 1 however many documents have it.
Fixed base phrases are found apart from this, at every place where their words follow one another. The templates are literals
of bounded size, so everything happens inside the row and no shuffle depends on the texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from granary.llm.common import staged, text_column

# fixed values: phrase and label
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_GNU = "under the terms of the gnu {}general public license as published by the free software foundation"
# label, wording, mandatory key phrase; fixed values from the licences' own notices and identifiers
TEMPLATES = [
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "mit license", "mit license"),
    ("mit", "license mit", "license mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0 january 2004", "apache license version 2 0"),
    ("apache-2.0", "license apache 2 0", "apache 2 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", _GNU.format("") + " either version 2 of the license", "gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", _GNU.format("") + " either version 3 of the license", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2.0", _GNU.format("") + " version 2 of the license", "gnu general public license as published by the free software foundation version 2"),
    ("gpl-3.0", _GNU.format("") + " version 3 of the license", "gnu general public license as published by the free software foundation version 3"),
    ("gpl-2.0", "license gpl 2 0", "gpl 2 0"),
    ("gpl-3.0", "license gpl 3 0", "gpl 3 0"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("lgpl", _GNU.format("lesser "), "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("agpl", _GNU.format("affero "), "gnu affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2.0", "license mpl 2 0", "mpl 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "dedicated to the public domain under the creative commons cc0 1 0 universal", "creative commons cc0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    *[(label, f"spdx license identifier {name}", f"license identifier {name}") for label, name in (("mit", "mit"), ("apache-2.0", "apache 2 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("mpl-2.0", "mpl 2 0"), ("bsd", "bsd"), ("cc0", "cc0"))],
]
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOOKED_UP = 3  # words of a template, the rarest ones, whose occurrences are looked up
LEAST_SCORE = 0.6


# never looked up: too frequent in any corpus
FUNCTION_WORDS = frozenset("a and any are as by either for from in into is nc nd of on or sa the this to under use v with without 0 1 2 3 4".split())
VOCABULARY = sorted({w for _, wording, _ in TEMPLATES for w in wording.split()} - FUNCTION_WORDS)
_HITS = "array<struct<w:string,i:int>>"


def word_array(text_col: str = "text") -> Column:
    """Words of the whole text in lower case; null is the empty text.

    Lower case of other letters than A-Z moves no word limit. The one that turns into an ASCII letter is the Kelvin
    sign, into k: no base phrase has a k, and one template word ("sharealike").
    """
    return F.array_remove(F.split(F.lower(text_column(text_col)), GAP), "")


def positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index: (doc_id, n_words, at0.., hits, words), with the words of files that have hits only."""
    words = F.col("words")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), word_array(text_col).alias("words"))
    # words padded by spaces of their own, so that a contained phrase is a phrase of whole words
    rows = rows.withColumn("padded", F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))
    vocabulary = F.array(*map(F.lit, VOCABULARY))

    def places(phrase: str) -> Column:
        parts = phrase.split()
        runs = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: _all(F.get(words, i + j) == F.lit(w) for j, w in enumerate(parts)))
        return F.when(F.contains("padded", F.lit(_padded(phrase))), runs).otherwise(F.array().cast("array<int>"))

    placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    hits = F.when(F.arrays_overlap(words, vocabulary), F.filter(placed, lambda x: F.array_contains(vocabulary, x["w"]))).otherwise(F.array().cast(_HITS))
    rows = rows.withColumns({"hits": hits, **{f"at{i}": places(p) for i, p in enumerate(BASE)}})
    kept = F.when(F.size("hits") > 0, words).alias("words")
    return rows.select("doc_id", F.size(words).cast("long").alias("n_words"), *[f"at{i}" for i in range(len(BASE))], "hits", kept)


def weights(index: DataFrame) -> dict[str, float]:
    """log(1 + N / (df + 1)) of the words of the vocabulary: smoothed, so that the most frequent word still weighs something."""
    counted = index.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("word")).groupBy("word").count()
    df = {r[0]: r[1] for r in counted.collect()}  # at most the vocabulary
    total = index.count()
    return {w: math.log(1 + total / (df.get(w, 0) + 1)) for w in VOCABULARY} if total else dict.fromkeys(VOCABULARY, 1.0)


def looked_up(wording: str, weight: dict[str, float]) -> tuple[dict[str, int], list[str]]:
    """The first place of each word of a template that has a weight, and its rarest words."""
    template = wording.split()
    at = {w: template.index(w) for w in dict.fromkeys(template) if w in weight}
    return at, sorted(at, key=lambda w: (-weight[w], w))[:LOOKED_UP]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    Null and empty texts have no words, no places and no labels (empty strings). Repeated rows stay. Texts of any length are read
    whole. A notice that stands whole keeps its label however many documents have it.
    """
    index = staged(positions(docs, id_col, text_col), "positions")
    weight = weights(index)
    scores = {}
    for i, (_, wording, key) in enumerate(TEMPLATES):
        scores[f"score{i}"] = F.when(F.size("hits") > 0, _score(wording, key, weight)).otherwise(F.lit(0.0))
    rows = index.withColumns(scores)
    every = F.concat(*[f"at{i}" for i in range(len(BASE))])
    base = [F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values())]
    own = [F.when(F.col(f"score{i}") >= LEAST_SCORE, F.lit(label)) for i, (label, _, _) in enumerate(TEMPLATES)]
    best = F.greatest(*[F.col(c) for c in scores], F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(base + own).alias("labels"),
        F.least(F.lit(1.0), best).alias("score"),
    )


def _padded(phrase: str) -> str:
    return " " + "  ".join(phrase.split()) + " "


def _all(conditions) -> Column:
    first, *rest = conditions
    for c in rest:
        first = first & c
    return first


def _joined(labels: list[Column]) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")


def _score(wording: str, key: str, weight: dict[str, float]) -> Column:
    """The largest share of a template's weight at one place of the file that its rarest words agree on and that has the key phrase."""
    template, key_words = wording.split(), key.split()
    at, rarest = looked_up(wording, weight)
    total = sum(weight[w] for w in at)
    begin = next(i for i in range(len(template)) if template[i : i + len(key_words)] == key_words)

    def starts(w: str) -> Column:
        return F.transform(F.filter("hits", lambda x: x["w"] == F.lit(w)), lambda x: x["i"] - at[w])

    postings = [starts(w) for w in rarest]
    candidates = F.array_distinct(F.concat(*postings)) if len(postings) > 1 else postings[0]

    def stands(s: Column, w: str) -> Column:
        return F.coalesce(F.get("words", s + at[w]) == F.lit(w), F.lit(False))

    agreed = lambda s: sum((stands(s, w).cast("int") for w in rarest), F.lit(0)) >= min(2, len(rarest))
    found = F.filter(candidates, lambda s: agreed(s) & (s + begin >= 0) & _all(F.get("words", s + begin + j) == F.lit(w) for j, w in enumerate(key_words)))
    share = lambda s: sum((F.when(stands(s, w), F.lit(weight[w])).otherwise(F.lit(0.0)) for w in at), F.lit(0.0)) / F.lit(total)
    return F.coalesce(F.array_max(F.transform(found, share)), F.lit(0.0))
