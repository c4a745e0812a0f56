import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm.lookalike import load

alike = load()
look, folded, words, token_kind = alike.look, alike.folded, alike.words, alike.token_kind


@pytest.mark.parametrize(
    "a,b",
    [
        ("Привет", "Пpивeт"),
        ("мир", "м​и­р"),
        ("йод", "йод"),
        ("ёлка", "ёлка"),
        ("ёлка", "ëлка"),
        ("a b", "a b"),
        ("a b", "a b"),
        ("ＶＰＮ １２", "VPN 12"),
        ("Олег", "Οлег"),
        ("TECT", "ТЕСТ"),
        ("﻿x", "x"),
        ("օ", "o"),
        ("ⲟ", "o"),
        ("Ꭺ", "A"),
        ("ꓐ", "B"),
        ("ɡ", "g"),
        ("ⅼ", "l"),
        ("ı", "i"),
        ("𝐀", "A"),
        ("ℝ", "R"),
        ("οօо", "ooo"),
    ],
)
def test_same_look(a, b):
    assert a != b and look(a) == look(b) and folded(a) == folded(b) and words(a) == words(b)


@pytest.mark.parametrize("a,b", [("Кот", "кот"), ("ёлка", "елка"), ("о", "0"), ("l", "1"), ("а.", "а!"), ("—", "-"), ("a\nb", "a b"), ("‼", "!!"), ("²", "2")])
def test_different_look(a, b):
    assert look(a) != look(b)


def test_everyday_letters_keep_apart():
    for letters in ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω"):
        both = letters + letters.upper()
        assert len({look(c) for c in both}) == len(both)


def test_classes_are_shipped_and_made_once():
    import pickle

    assert pickle.loads(pickle.dumps(alike)) is alike


def test_nothing_to_do():
    assert look(None) is None and folded(None) is None and words(None) == []
    assert look("") == "" and words("") == []
    plain = "Обычный текст, «кавычки» — и VPN.\n\tДа"
    assert look(plain) == plain


def test_kinds():
    assert token_kind("слово") == "single"
    assert token_kind("сад") == "single" and token_kind("сор") == "whole"
    assert token_kind("словo") == "mixed_resolved"
    assert token_kind("VPNщик") == "mixed"


def test_script_spelling_is_consistent():
    assert look("The") == "The" and look("Тһе") == "The" and look("TEСT") == "ТЕСТ" and words("The THE the") == ["the", "тне", "the"]
    assert look("Bот") == "Вот" and look("VРN") == "VPN"
    assert look("VPNщик") == look("VPNщик")


@given(st.text(alphabet=st.sampled_from([*"абвёйо orpVPN12.,\n ​̆̈Οο１ｅ👍", *(c for c in alike.class_of if len(alike.spellings[alike.class_of[c]]) > 3)]), max_size=40))
def test_form_is_stable(text):
    form = look(text)
    assert look(form) == form
    assert look(unicodedata.normalize("NFD", text)) == form
    swapped = "".join(next((c for c in alike.spellings.get(alike.class_of.get(ch), {}).values() if c != ch), ch) for ch in text)
    assert look(swapped) == form


@given(st.text(max_size=30))
def test_any_text(text):
    assert look(look(text)) == look(text)
    assert all(unicodedata.category(c)[0] in "LN" for w in words(text) for c in w)
