"""Surrogates of entities in any script, of few letters, and of signs: no crash, no leak, none like its entity."""

from __future__ import annotations

import random

import pytest

from lumenkg.llm import pii

ALPHABETS = ["abcxyzABC", "пароль", "ПАРОЛЬ", "秘密田中", "كلمةسر", "סיסמה", "λέξη", "パスワード", "암호", "0123456789", "٠١٢٣", "éüßñ", "=-_+.~/", "々ーﾞ", "Ａｂ１"]


def secrets(seed: int) -> str:
    rng = random.Random(seed)
    value = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(6, 20)))
    return f"Here {rng.choice(['password', 'token', 'secret', 'api_key'])}{rng.choice([': ', '=', ' = '])}{value} ends."


@pytest.mark.parametrize("seed", range(300))
def test_any_secret(seed):
    text = secrets(seed)
    for a, b, kind, canon in pii.entities(text):
        own, head = text[a:b], pii._head(canon)
        assert kind == "secret" and any(map(str.isalnum, own))
        for draw in range(40):
            new = pii.rendered(kind, pii.surrogate(b"k", kind, canon, draw), own)
            if new != own:
                break
        assert new != own and not pii._shares(new[len(head) :], own[len(head) :])


@pytest.mark.parametrize("value", ["геслогесло", "пароль12", "秘密の言葉です秘密", "كلمةالسر12", "αβγδεζηθ", "éééééééé", "٠١٢٣٤٥٦٧"])
def test_secrets_of_other_scripts_are_replaced_as_a_whole(value):
    text = f"password: {value} y"
    (found,) = pii.entities(text)
    new = pii.replaced(text, [found], b"k", {}, {})
    kept = set(value) & set(new[len("password: ") : -2])
    assert len(new) == len(text) and sum(a == b for a, b in zip(value, new[10:], strict=False)) <= 3, (new, kept)


@pytest.mark.parametrize("text", ["x password: ======== y", "password = ________________", "token: ----------"])
def test_signs_to_fill_in_are_no_secrets(text):
    assert pii.entities(text) == []


@pytest.mark.parametrize(("text", "name"), [("時々東京田中さんが来た", "東京田中"), ("東京都田中さん", "田中"), ("営業部長谷川様", "長谷川"), ("中村さん", "中村"), ("佐々木さん", "佐々木"), ("渋谷区役所佐藤先生", "役所佐藤"), ("ー々様", None), ("々さん", None)])
def test_names_before_honorifics(text, name):
    found = [text[a:b] for a, b, _, _ in pii.entities(text)]
    assert found == ([name] if name else []) or (name is None and all(pii.script_of(f) for f in found))
    assert name is None or name not in pii.replaced(text, pii.entities(text), b"k", {}, {})


TEXTS = ["x password: ======== y", "password: геслогесло", "password = ________________", "時々東京田中さんが来た", "password: пароль12", "東京都田中さん", "", None, "Mr Ωmega and Frau Δelta, Mrs 田中 and Sr. محمد, Dr É", "々さん ー様 ーーさん", "a@b.cc " * 500]


def test_whole_tables_of_such_texts(spark):
    rows = [(k, t, "own") for k, t in enumerate(TEXTS + [secrets(s) for s in range(300)])] * 2
    got = pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string, draw string").repartition(4), b"k").collect()
    assert len(got) == len(rows) and all(r.draw == "own" for r in got)
    for r in got:
        for a, b, kind, _ in pii.entities(rows[r.doc_id][1]):
            assert rows[r.doc_id][1][a:b] not in r.text or len(rows[r.doc_id][1][a:b]) < 3, (rows[r.doc_id], r.text, kind)
    same: dict = {}
    for r in got:
        assert same.setdefault(r.doc_id, r.text) == r.text


def test_more_entities_than_short_forms(spark):
    """Emails of one letter: there are more entities than surrogates of their length."""
    rows = [(k, f"{c}@{d}.cc") for k, (c, d) in enumerate((c, d) for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwxyz")]
    rows += [(1000 + k, f"password: ========{k}") for k in range(10)]
    got = pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()
    assert len({r.text for r in got}) == len(rows) and not {r.text for r in got} & {r[1] for r in rows}
