"""Given names alone, names with accents, and e-mail addresses in long runs of letters."""

import re
import time

import pytest
from hypothesis import given, strategies as st

from mosaique.llm import privacy

KEY = b"k" * 32


def replaced(text):
    return privacy.rewrite(text, KEY, {})[0]


def test_later_mentions_of_a_given_name():
    text = replaced("Anna Müller came. Later Anna left, and ANNA wrote to Müller.")
    assert not re.search("Anna|ANNA|Müller", text)
    first = re.match(r"(\w+) (\w+) came\. Later (\w+) left, and (\w+) wrote to (\w+)\.", text)
    assert first[1] == first[3] == first[4].capitalize() and first[2] == first[5]


def test_a_given_name_alone_is_no_person():
    assert replaced("Later Anna left.") == "Later Anna left."
    assert replaced("Peter Miller came. Later Anna left.").endswith("Later Anna left.")


@pytest.mark.parametrize("name", ["María García", "Tomàs Weber", "Hélena Weber", "Anna-María López"])
def test_accents_do_not_hide_a_name(name):
    text = replaced(f"Then {name} came.")
    assert not any(part in text for part in re.split("[ -]", name)) and text.startswith("Then ") and text.endswith(" came.")


def test_spellings_of_one_given_name_agree():
    text = replaced("María García came and Maria left.")
    found = re.match(r"(\S+) \S+ came and (\S+) left\.", text)
    assert found[1].lower() == found[2].lower() != "maria"


@pytest.mark.parametrize("text", ["a" * 1_000_000 + "@", "@" + "a" * 1_000_000, "a." * 500_000 + "@b", "a@" * 500_000, "@" * 1_000_000, "a@" + "b." * 500_000, "a@" + "-" * 1_000_000])
def test_long_runs_take_no_longer_than_their_length(text):
    begun = time.process_time()
    assert list(privacy._emails(text)) == []
    assert time.process_time() - begun < 1


PLAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+'-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")


@given(st.text(alphabet="aB1.@-_ '", max_size=60))
def test_the_addresses_are_those_of_one_plain_pattern(text):
    assert list(privacy._emails(text)) == [m.span() for m in PLAIN.finditer(text)]
