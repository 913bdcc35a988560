import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semgraph.llm.lookalikes import LETTERS, SHAPES, Model, consistent_forms, count_bigrams, look_classes, plain, recovery, same_looking_pairs, shapes, train
from semgraph.llm.tokens import RANKS, encoding, token_counts

WORDS = {"scope": 9, "peace": 5, "cocoa": 4, "Token": 3, "сорока": 6, "снова": 5, "весна": 4, "код": 3, "όταν": 3, "κώδικας": 2, "ресурс": 3}
MODEL = Model(count_bigrams({plain(w): n for w, n in WORDS.items()}))

SAME = [
    ("scope", "sсоре"), ("café", "café"), ("ａｂｃ１２", "abc12"), ("a b　c", "a b c"), ("x​y﻿z­", "xyz"), ("conﬁdence", "confidence"), ("ﾊﾟｰｻｰ", "パーサー"), ("Kept", "Kept"),
    ("κόµβος", "κόμβος"), ("á", "а́"), ("한", "한"), ("ᄃ‎ᅡ", "다"), ("Τοken", "Token"), ("օver", "over"), ("siɡn", "sign"), ("a\r\nb", "a\nb"), ("снова", "cнoвa"), ("ё", "ё"),
]
DIFFERENT = [("naive", "naïve"), ("Paris", "paris"), ("a  b", "a b"), ("a\nb", "a b"), ("файл", "фаил"), ("x²", "x2"), ("①", "1"), ("½", "1/2"), ("—", "-"), ("0", "O"), ("l", "1"), ("ß", "β"), ("α", "a"), ("к", "k"), ("rn", "m"), ("!", "ǃ")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert MODEL.form(a) == MODEL.form(b) and shapes(a) == shapes(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_visible_difference(a, b):
    assert MODEL.form(a) != MODEL.form(b) and shapes(a) != shapes(b)


def test_script_consistent_forms():
    assert MODEL.form("ѕсоре") == "scope" and MODEL.form("cнoвa") == "снова" and MODEL.form("pecypc") == "ресурс"


def test_marks_go_with_their_letter():
    words = {plain(w): n for w, n in {"όρια": 9, "όταν": 5, "récope": 3, "operator": 9, "ёрш": 2, "сорок": 9}.items()}
    model = Model(count_bigrams(words))
    for w in words:
        assert model.best(w) == w
    assert model.form("óρια") == "όρια" and model.form("réсоре") == "récope"


def test_words_of_several_scripts_go_with_the_word_before():
    model = Model(count_bigrams({plain(w): n for w, n in {"Το": 3, "To": 9, "όταν": 5, "token": 9, "а": 2, "a": 9, "снова": 5}.items()}))
    assert model.form("όταν To") == "όταν Το" and model.form("token Το") == "token To" and model.form("снова a, token а") == "снова а, token a"
    assert model.form("Το") == "To"


def test_table_is_bounded():
    assert len(SHAPES) < 60 and len(set("".join(SHAPES))) == sum(map(len, SHAPES))
    assert LETTERS < 2000


def brute(model, token):
    """The best score over all readings."""
    from itertools import product

    options = [next((s for s in SHAPES if c in s), c) for c in token]

    def score(reading):
        letter, total = "^", 0.0
        for c in [*reading, "$"]:
            total += model.step(letter, c)
            letter = letter if c == "\u0301" else c
        return total

    return max(score(r) for r in product(*options)), score


@settings(max_examples=80, deadline=None)
@given(st.text("aсоерхxyв́Tи", min_size=1, max_size=7))
def test_viterbi_finds_the_best_reading(token):
    best, score = brute(MODEL, token)
    assert score(MODEL.best(token)) == pytest.approx(best)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aаbсc eé́​ＡAА\n\tοﬁfi"), max_size=12), st.text(st.sampled_from("aаbсc eé́​ＡAА\n\tοﬁfi"), max_size=12))
def test_forms_are_equal_iff_looks_are(a, b):
    assert (MODEL.form(a) == MODEL.form(b)) == (shapes(a) == shapes(b))
    assert MODEL.form(MODEL.form(a)) == MODEL.form(a)


def test_pairs_against_brute_force(spark):
    rnd = random.Random(4)
    texts = [None, "", "​", " "] + [rnd.choice(["scope", "sсоре", "ѕcope", "Scope", "peace", "pеace", "long " + "x" * 50_000, "lоng " + "x" * 50_000]) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, form string")
    got = {tuple(r) for r in same_looking_pairs(consistent_forms(df, "doc_id", "text", digests_only=True)).collect()}
    real = [(i, t) for i, t in enumerate(texts) if t]
    assert got == {(i, j) for i, a in real for j, b in real if i < j and a != b and shapes(a) == shapes(b)}
    classes, members = (x.collect() for x in look_classes(consistent_forms(df, "doc_id", "text", digests_only=True)))
    mixed = {i for pair in got for i in pair}
    assert {r.doc_id for r in members} == mixed and sum(r.n_docs for r in classes) == len(mixed)
    for r in members:
        assert r.text_id == min(i for i, t in real if t == texts[r.doc_id]) and r.class_id == min(i for i, t in real if shapes(t) == shapes(texts[r.doc_id]))
    assert {(r.class_id, r.n_texts) for r in classes} == {(c, len({m.text_id for m in members if m.class_id == c})) for c in {m.class_id for m in members}}
    forms = {r.doc_id: r.form for r in consistent_forms(df, "doc_id", "text").collect()}
    assert forms[0] is None and forms[1] == "" and forms[2] == "" and forms[3] == " "
    assert train(df.limit(0), "text") == {} and same_looking_pairs(consistent_forms(df.limit(0), "doc_id", "text", digests_only=True)).count() == 0


def test_recovery_of_held_out_words(spark):
    df = spark.createDataFrame([(i, f"scope peace сорока снова όταν κώδικας {'оперa' if i % 7 == 0 else ''}") for i in range(60)] + [(None, None), (61, "")], "doc_id long, text string")
    got = {r.script: r for r in recovery(df, "doc_id", "text").collect()}
    assert set(got) == {"Latin", "Cyrillic", "Greek"} and all(r.n_found == r.n_ambiguous > 0 and r.n_tokens >= r.n_ambiguous for r in got.values())
    assert recovery(df.limit(0), "doc_id", "text").count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "é" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, "text", ["doc_id"]).collect()}
    enc = encoding(RANKS)
    for r in df.collect():
        ids = enc.encode_ordinary(r.text or "")
        assert enc.decode(ids) == (r.text or "") and got[r.doc_id] == len(ids)


def test_characters_held_to_be_safe_are():
    """Every character that is not looked up is the same as if it were, and texts of all others are, too."""
    from semgraph.llm import lookalikes as L

    every = [chr(o) for o in range(0x110000) if not 0xD800 <= o <= 0xDFFF]
    safe = [c for c in every if not L._OTHER.match(c)]
    assert len(safe) > 30_000 and all(L._plain(c) == unicodedata.normalize("NFD", c) for c in safe)
    for c in every[::7]:
        want = unicodedata.normalize("NFD", f"a{c}b".translate(L._TABLE).replace("\r\n", "\n").replace("\r", "\n"))
        assert plain(f"a{c}b") == want
