"""Digits of other scripts, padded addresses, many entities, the stored ledger, and a whole table against plain rules."""

import os
import re
import time

import pytest

from mosaique.llm import privacy, queries

ARABIC, WIDE = (str.maketrans("0123456789", "".join(chr(zero + k) for k in range(10))) for zero in (0x660, 0xFF10))


def rewritten(text, key=b"key"):
    return privacy.rewrite(text, key, {})[0]


@pytest.mark.parametrize("address", ["8.8.8.00", "192.168.001.010", "10.0.0.07", "0.0.0.0", "255.255.255.255", "1.2.3.000"])
def test_addresses_with_leading_zeros(address):
    new = rewritten(f"from {address} on").split()[1]
    assert new != address and [len(a) for a in new.split(".") if a[0] == "0"] <= [3] * 4
    plain = ".".join(str(int(x)) for x in address.split("."))
    assert [int(x) for x in new.split(".")] == [int(x) for x in rewritten(f"from {plain} on").split()[1].split(".")]


@pytest.mark.parametrize("digits", [ARABIC, WIDE])
@pytest.mark.parametrize("value", ["829-555-4386", "+49 30 123456", "123-45-6789", "4041894974608795", "42.144.35.254", "GB82WEST12345698765432"])
def test_digits_of_other_scripts(digits, value):
    other = value.translate(digits)
    new, plain = rewritten(f"is {other} here"), rewritten(f"is {value} here")
    assert other not in new and new == f"is {plain[3:-5].translate(digits)} here"


@pytest.mark.parametrize("text", ["²³¹ 555-1234", "٣٤٥ ٢٢", "1²3.4.5.6", "০১২৩-৪৫-৬৭৮৯", "+١ ٨٢٩ ٥٥٥ ٤٣٨٦", "퟿ 12.12.12.012", "Mr. ΣΑΣ and Mr. SMITH"])
def test_odd_texts_do_not_fail(text):
    rewritten(text)


def test_names_in_capitals_behind_a_title():
    new = rewritten("Mr. SMITH came. Then Smith left, and SMITH was gone. NASA stayed.")
    assert "smith" not in new.lower() and new.endswith("NASA stayed.")
    one, two, three = (re.search(p, new)[1] for p in (r"Mr\. (\w+)", r"Then (\w+)", r"and (\w+)"))
    assert one == three == two.upper() and "ΣΑΣ" not in rewritten("Mr. ΣΑΣ left")


def test_many_entities_in_one_text():
    text = " ".join(f"Mr. Na{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}son wrote to a{k}@mail{k % 7}.org." for k in range(10_000))
    begun = time.time()
    found = privacy.detect(text)
    assert len(found) == 20_000 and time.time() - begun < 5
    assert all(a.end <= b.begin for a, b in zip(found, found[1:], strict=False))


def test_ledger_holds_no_values(spark):
    docs = spark.createDataFrame([(1, "Mr. John Smith, js@b.com, 42.144.35.254")], "doc_id long, text string")
    rows = privacy.ledger(docs, b"k").collect()
    assert len(rows) == 4 and {r.kind for r in rows} == {"given", "name", "email", "ipv4"}
    held = b" ".join(bytes(x) for r in rows for x in (r.value, r.surrogate))
    assert not any(x in held for x in (b"smith", b"Smith", b"js@b.com", b"42.144")) and all(len(r.value) == len(r.surrogate) == 16 for r in rows)


def test_key_of_the_session(spark):
    docs = spark.createDataFrame([(1, "write to js@b.com")], "doc_id long, text string")
    before = spark.conf.get(privacy.KEY_SETTING, None)
    try:
        spark.conf.unset(privacy.KEY_SETTING)
        one, two = (privacy.replace(docs).first().text for _ in range(2))
        spark.conf.set(privacy.KEY_SETTING, "another key")
        assert one == two != privacy.replace(docs).first().text == privacy.replace(docs, b"another key").first().text
    finally:
        if before:
            spark.conf.set(privacy.KEY_SETTING, before)
        else:
            spark.conf.unset(privacy.KEY_SETTING)


def luhn(digits):
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def test_whole_table_against_plain_rules(spark, sf_dir):
    """Every match of plain patterns changes, keeps its shape, and maps one to one over the whole table; the rest stays."""
    folder = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    new = {r.doc_id: r.text for r in queries.op5_privacy(spark, folder).collect()}
    patterns = {
        "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}",
        "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])",
        "card": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){3}(?![\d-])",
        "access_key": r"\bAKIA[A-Z0-9]{16}\b",
    }
    shape = {"ipv4": lambda x: 4 == len(x.split(".")) and all(0 <= int(n) < 256 for n in x.split(".")), "card": lambda x: re.sub(r"\d", "0", x), "email": lambda x: (re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", x.split("@")[0]))), x.rpartition(".")[2]), "access_key": len}
    assert set(old) == set(new)
    found = 0
    for kind, pattern in patterns.items():
        there, back = {}, {}
        plain = (lambda x: re.sub(r"\D", "", x)) if kind == "card" else str.lower if kind == "email" else str
        for doc_id, text in old.items():
            a, b = re.findall(pattern, text or ""), re.findall(pattern, new[doc_id] or "")
            assert len(a) == len(b), (doc_id, kind, a, b)
            for x, y in zip(a, b, strict=True):
                found += 1
                assert x != y and shape[kind](x) == shape[kind](y), (x, y)
                assert kind != "card" or luhn(plain(x)) == luhn(plain(y))
                assert there.setdefault(plain(x), plain(y)) == plain(y) and back.setdefault(plain(y), plain(x)) == plain(x)
    assert found > 50
    untouched = [d for d, t in old.items() if t and not re.search(r"[@=:]|\d{3}|\d\.\d", t) and not re.search(r"\b(?:Mr|Mrs|Ms|Dr)\b", t)]
    assert sum(old[d] == new[d] for d in untouched) >= 0.99 * len(untouched)
