import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nodetide.llm import licences as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
INDEX = L.Index()


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for phrase, label in L.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())
    return len(words), places


PIECES = st.sampled_from(["CC", "by", "BY-NC", "general", "Public", "license", "all", "rights", "reserved", " ", ", ", "\n", "-", "é", "K", "ccé", "4.0", "x_y", "\x00", "🙂", "mit"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=30))
def test_words_and_base_places(pieces):
    text = " ".join(pieces) if len(pieces) % 2 else "".join(pieces)
    got = INDEX.scan(text)
    assert (got["n_words"], sorted(got["places"])) == plain(text)


@pytest.mark.parametrize("label,template,phrases", L.TEMPLATES)
def test_every_template_is_found(label, template, phrases):
    filler = "Some prose about the sea and of all that is in it. " * 40
    for text in (template, f"{filler}\n{template.upper()}.\n{filler}", " ".join(w + "&&&" for w in template.split())):
        assert INDEX.scan(text)["matches"][label][0] == 1.0
    words = template.split()
    if len(words) > 12:  # a word more and a word less elsewhere
        changed = next(c for c in (" ".join([*words[:i], "really", *words[i:]]) for i in range(1, len(words))) if all(p in c for p in phrases))
        assert INDEX.scan(changed)["matches"][label][0] >= L.LEAST


def test_phrases_are_mandatory():
    assert not INDEX.scan("released under the mit agreement")["matches"]
    assert not INDEX.scan("The apache tribe and a version of the license 2 0 licensed")["matches"]
    assert not INDEX.scan("Copyright of all that rights had reserved once")["matches"]
    assert set(INDEX.scan("Licensed under CC BY-NC 4.0.")["matches"]) == {"cc-by-nc"}


def test_frame_and_edges(spark):
    long = "word " * 400_000 + "All rights reserved. Released under the MIT License."
    texts = ["Licensed under CC BY 4.0. CC BY", None, "", "nothing here", long, "GNU General Public License", "permission " * 5000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y"), (None, "All Rights Reserved", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = L.digest(L.find_licences(df)).collect()
    assert len(got) == len(rows)
    for r, (doc_id, text, _) in zip(got, rows):
        n, places = plain(text)
        starts = [p for p, _ in places]
        assert (r.doc_id, r.n_words, r.n_base) == (doc_id, n, len(places))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if places else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[4].labels == "mit,reserved" and got[0].labels == "cc-by,cc-by-4.0" and got[3].score == 0
    assert L.find_licences(df.limit(0)).count() == 0
