import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import lookalikes as k

SAME = [
    ("résumé", "résumé"), ("naïve", "nai​̈ve"), ("a b", "a b"), ("a b", "a　b"), ("co-op", "co‐op"), ("co-op", "co‑op"),
    ("word", "wo­rd"), ("word", "﻿word"), ("ABC 123", "ＡＢＣ　１２３"), ("file", "ﬁle"), ("vi", "ⅵ"), ("plain", "𝗉𝗅𝖺𝗂𝗇"), ("mono", "𝚖𝚘𝚗𝚘"),
    ("scope", "ѕсоре"), ("TAX", "ΤΑΧ"), ("ëi", "ёi"), ("первый", "первый"), ("가", "가"), ("K", "K"), ("کتاب", "ﮐﺘﺎﺏ"),
]
SAME += list(zip("ν ρ α γ ѵ Ѵ Ү ү ӕ ԍ ո ս Ս Օ օ յ ց Ꭺ Ꮪ ꓮ Ⲟ ϲ Ϲ ɑ ɡ ı − ‒ ․ ∶".split(), "v p a y v V Y y æ ɢ n u U O o j g A S A O c C a g i - - . :".split()))
SAME += [("nаïve", "naïve"), ("ό", "ó"), ("ᴛ", "т")]
APART = [("σ", "o"), ("η", "n"), ("ω", "w"), ("κ", "k"), ("χ", "x"), ("β", "ß"), ("м", "m"), ("т", "t"), ("в", "b"), ("п", "n"), ("ь", "b"), ("—", "-"), ("–", "−"), ("‘a’", "'a'"), ("“a”", '"a"'), ("İ", "I"), ("ſ", "s"), ("ſ", "f"), ("Һ", "H"), ("з", "3"), ("б", "6"), ("…", "..."), ("·", "."), ("×", "x"), ("ℓ", "l")]
DIFFERENT = [
    ("a", "A"), ("e", "é"), ("2", "²"), ("4", "④"), ("a b", "ab"), ("a\nb", "a b"), ("a\nb", "a\n\nb"), ("l", "1"), ("O", "0"), ("b", "𝐛"), ("a–b", "a-b"), ("и", "u"), ("ß", "ss"), ("a\tb", "a b"), ("a b", "a b"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert k.one_form(a) == k.one_form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT + APART)
def test_different(a, b):
    assert k.one_form(a) != k.one_form(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_settled_and_composed(t):
    one = k.one_form(t)
    assert k.one_form(one) == one
    assert k.one_form(unicodedata.normalize("NFD", t)) == one
    assert one.count("\n") == t.count("\n")


@given(st.text(st.characters(min_codepoint=32, max_codepoint=126)))
def test_ascii_stays(t):
    assert k.one_form(t) == t


def test_pairs(spark):
    rows = [(1, "file scope", "x"), (2, "ﬁle ѕсоре", "x"), (3, "file scope", "x"), (4, "file\u00a0scope", "x"), (5, None, "x"), (6, "", "x"), (7, " ", "x"), (8, " ", "x"), (9, "​", "x"), (10, "File scope", "x"), (2, "ﬁle ѕсоре", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = {(r.a, r.b) for r in k.same_looking(df).collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4)}
    out = {r.doc_id: (r.text, r.changed) for r in k.normalized(df).collect()}
    assert out[2] == ("file scope", True) and out[5] == (None, False) and out[1] == ("file scope", False) and out[9] == ("", True)
    assert k.same_looking(df.where("false")).count() == 0


def test_long_text():
    t = "word ѕсоре " * 200_000
    assert k.one_form(t) == "word scope " * 200_000


def test_classes_are_the_pairs_without_copies(spark):
    rows = [(i, "scope") for i in range(5)] + [(9, "ѕсоре"), (10, "ѕсоре"), (11, "alone"), (12, "alone"), (13, None), (14, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in k.look_alike_classes(docs).collect()}
    assert got == {(i, 0, 2) for i in [*range(5), 9, 10]}
    assert k.same_looking(docs).count() == 10 and k.look_alike_classes(docs.where("false")).count() == 0
