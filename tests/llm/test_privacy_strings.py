"""Strings that must not stay: cards beside other digits, prefixed secrets, addresses after words in v."""

import pytest

from mosaique.llm import privacy

CARD = "4785380592391139"


@pytest.mark.parametrize("text", [
    f"{CARD} 123", f"12 {CARD}", f"{CARD} 12/27 123", "4785 3805 9239 1139 123", "1234 4785 3805 9239 1138 99", f"pay {CARD} {CARD} now", f"1234 5678 {CARD} 12 34",
])
def test_cards_beside_other_digits(text):
    for digits in (CARD, "4785380592391138"):
        asked = text.replace(CARD, digits)
        found = [e for e in privacy.detect(asked) if e.kind == "card"]
        assert found and all(len(e.value) == 16 for e in found)
        new = privacy.rewrite(asked, b"key", {})[0]
        assert digits not in new and len(new) == len(asked)


def test_other_digits_around_a_card_stay():
    new = privacy.rewrite(f"12 {CARD}, then {CARD} 123.", b"key", {})[0]
    assert new.startswith("12 ") and new.endswith(" 123.")
    assert privacy.detect("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22") == []


@pytest.mark.parametrize("text,secret", [
    ("DB_PASSWORD=correcthorse9", "correcthorse9"), ("client_secret: 8f3kd02mfk20", "8f3kd02mfk20"), ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG", "wJalrXUtnFEMI/K7MDENG"),
    ("password: correcthorse", "correcthorse"), ("my.db.passwd=batterystaple", "batterystaple"), ('"SECRET_KEY": "abc123def456"', "abc123def456"),
])
def test_secrets_with_a_prefix_or_without_a_digit(text, secret):
    assert [(e.kind, e.value) for e in privacy.detect(text)] == [("secret", secret)]
    assert secret not in privacy.rewrite(text, b"key", {})[0]


def test_words_without_a_value_stay():
    assert privacy.detect("The token: something without digits. Monkey: bananas99999") == []


@pytest.mark.parametrize("text,found", [("srv 10.0.0.1", 1), ("dev 10.0.0.1", 1), ("srv10.0.0.1", 1), ("v 10.0.0.1", 0), ("v10.0.0.1", 0), ("Version 10.0.0.1", 0), ("ver. 10.0.0.1", 0)])
def test_addresses_after_words_in_v(text, found):
    assert len([e for e in privacy.detect(text) if e.kind == "ipv4"]) == found


@pytest.mark.parametrize("text,parts", [
    ("Jennifer Smith met Kevin Brown.", ["Jennifer", "Smith", "Kevin", "Brown"]), ("Peter Wałęsa", ["Peter", "Wałęsa"]), ("Anna Dvořák", ["Anna", "Dvořák"]),
    ("Call Peter Novák today", ["Peter", "Novák"]), ("Dr Lovelace and Prof. Dr. Zuse", ["Lovelace", "Zuse"]), ("Dr. Kevin McDonald", ["Kevin", "McDonald"]),
    ("Maria de la Cruz", ["Maria", "Cruz"]), ("John F. Kennedy", ["John", "Kennedy"]), ("Mary O'Brien", ["Mary", "O'Brien"]), ("Jean-Luc Picard", ["Jean-Luc", "Picard"]), ("Виктор Цой", ["Виктор", "Цой"]),
])
def test_whole_names(text, parts):
    assert [text[e.begin : e.end] for e in privacy.detect(text)] == parts
    new = privacy.rewrite(text, b"key", {})[0]
    assert not any(part in new for part in parts)


def test_words_that_are_no_names():
    for text in ("Peters Smithfield is a place", "The Committee Of Ten met", "anna went home", "Dr. who", "Anna Dvořák2"):
        assert "dvo" not in [e.value for e in privacy.detect(text)] and (text.startswith("Anna") or privacy.detect(text) == [])


def test_given_names_are_in_one_list_each():
    names = [n.lower() for group in privacy.GIVEN.values() for n in group]
    assert len(names) == len(set(names)) > 900
