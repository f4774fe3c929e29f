"""Licence scans by a positional index of rare licence words.

The templates below are short notices and the telling sentences of common licences. The index holds, for every rare word of
the templates (in few of them, so with a high inverse document frequency), its template and position. A text's rare words
are looked up, the rarest first; postings whose position relative to the text agrees, within `DRIFT` words, point to a
place where the template may stand. There the template is laid over the text: the share of its words that are found at
their place must reach `LEAST`, and its mandatory phrases must stand there word by word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import prepare

DRIFT, LEAST, RARE = 2, 0.6, 3

# Phrases that count as they stand, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Label, template, mandatory phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
            "as published by the free software foundation", ("redistribute it and or modify it", "gnu general public license")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("creative-commons", "this work is licensed under a creative commons attribution international license", ("creative commons attribution",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
            ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
            ("with or without fee is hereby granted",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
)

#: A-Z lower-cased, word characters as they are, every other byte a space; bytes of non-ASCII characters belong to words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Index:
    """Rare words of the templates with their postings."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.templates = [(label, words_of(text), [words_of(p) for p in phrases]) for label, text, phrases in templates]
        self.base: dict[bytes, list[tuple[list[bytes], str]]] = defaultdict(list)
        for phrase, label in base:
            self.base[words_of(phrase)[0]].append((words_of(phrase), label))
        found = Counter(w for _, words, _ in self.templates for w in set(words))
        self.idf = {w: math.log(len(self.templates) / n) for w, n in found.items()}
        common = math.log(len(self.templates) / RARE) - 1e-9
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.templates):
            rarest = max(self.idf[w] for w in words)
            for q, w in enumerate(words):
                if self.idf[w] >= common or self.idf[w] == rarest:  # every template has a word in the index
                    self.postings[w].append((t, q))
        self.known = frozenset(self.postings) | frozenset(self.base)

    def _places(self, words: list[bytes], at: list[int]):
        """Templates and where each may begin, the places that most and rarest words point to first."""
        votes: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for p in at:
            for t, q in self.postings.get(words[p], ()):
                votes[t][p - q] += self.idf[words[p]]
        for t, places in votes.items():
            for place in sorted(places, key=lambda o: (-places[o], o)):
                yield t, place

    def match(self, words: list[bytes], at: list[int]) -> dict[str, tuple[float, int]]:
        """Best (share of the template, first word) for every label that the method gives."""
        best: dict[str, tuple[float, int]] = {}
        full = set()
        for t, place in self._places(words, at):
            label, template, phrases = self.templates[t]
            if t in full:
                continue
            low, high = place - DRIFT, place + DRIFT
            span = words[max(0, low):high + len(template) + 1]
            if not all(_stands(span, p) for p in phrases):
                continue
            near = range(low, high + 1)
            share = sum(any(0 <= q + o < len(words) and words[q + o] == w for o in near) for q, w in enumerate(template)) / len(template)
            if share >= LEAST and share > best.get(label, (0.0, 0))[0]:
                best[label] = (share, max(0, place))
            if share == 1.0:
                full.add(t)
        return best

    def scan(self, text: str | None) -> dict:
        """n_words; base places (word, label); matches: label -> (share, first word)."""
        words = words_of(text)
        if self.known.isdisjoint(words):
            return {"n_words": len(words), "places": [], "matches": {}}
        at = [p for p, w in enumerate(words) if w in self.known]
        places = [(p, label) for p in at for phrase, label in self.base.get(words[p], ()) if words[p:p + len(phrase)] == phrase]
        return {"n_words": len(words), "places": places, "matches": self.match(words, at)}


def _stands(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[i:i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


SCHEMA = "n_words long, places array<struct<word: long, label: string>>, matches array<struct<label: string, share: double, word: long>>"


def licences(text_col: str = "text") -> Column:
    """Struct n_words, places (base phrases), matches (templates)."""

    @F.pandas_udf(SCHEMA)
    def scan(texts: pd.Series) -> pd.DataFrame:
        index = Index()
        made = [index.scan(t) for t in texts]
        return pd.DataFrame({
            "n_words": [m["n_words"] for m in made],
            "places": pd.Series([[{"word": w, "label": label} for w, label in m["places"]] for m in made], dtype=object),
            "matches": pd.Series([[{"label": k, "share": s, "word": w} for k, (s, w) in sorted(m["matches"].items())] for m in made], dtype=object),
        })

    return scan(F.col(text_col))


def find_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its id, n_words, places (word, label) of base phrases in order, matches (label, share, word) of templates.

    Null texts count as empty; texts without licence words have no places and no matches; repeated rows are scanned alike;
    further columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col), licences(text_col).alias("found")).select(id_col, "found.*")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and ends of the base places, labels, and score: 1 for a base phrase, else the best share of a template."""
    words, base = F.transform("places", lambda p: p["word"]), F.transform("places", lambda p: p["label"])
    shares = F.transform("matches", lambda m: m["share"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        id_col, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0))).alias("score"))
