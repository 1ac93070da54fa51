from __future__ import annotations

import hashlib
import hmac as plain
import re

from larkspur.llm.pii import hmac, luhn, mod97, pseudonymise
from pyspark.sql import functions as F

TEXTS = [
    "Mail anna.berg@mail7.example.com or ANNA.BERG@mail7.example.com, call +1 (017) 555-7713 or +1-017-555-7713.",
    "From 10.20.30.40 to 10.20.30.41 and 10.20.30.40 again; version 1.2.3 and 1.2.3.4.5 stay.",
    "Cards 4111 1111 1111 1111 and 4111111111111111, ssn 123-45-6789, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"",
    "Mr John Smith met Mrs Smith; Herr Müller saw Frau Müller. г-жа Иванова и г-н Петров.",
    "IBAN DE89 3704 0044 0532 0130 00 and password: hunter2hunter2!",
    "Nothing here: 2024, 12345, 3.14, a@b, x = 1, MR SMITH.",
    "anna.berg@other.example.org wrote to bob@mail7.example.com",
    "", None, "word " * 20000 + "bob@mail7.example.com" + " word" * 20000,
]


def run(spark, texts=TEXTS, key="k"):
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in enumerate(texts)], "doc_id long, text string, _rid string, _id string, n_entities int")
    return {r.doc_id: r for r in pseudonymise(docs, key).collect()}


def test_detection_and_format(spark):
    got = run(spark)
    assert {i: r.n_entities for i, r in got.items()} == {0: 4, 1: 3, 2: 4, 3: 6, 4: 2, 5: 0, 6: 2, 7: 0, 8: 0, 9: 1}
    for i, t in enumerate(TEXTS):
        if not got[i].n_entities:
            assert got[i].text == t
    mask = lambda t: re.sub(r"\d", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", t)))
    for i in (0, 2, 6):
        assert mask(got[i].text).replace("9", "a") == mask(TEXTS[i]).replace("9", "a") and got[i].text != TEXTS[i]
    assert re.fullmatch(r"IBAN DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d and password: [a-z]{6}\d[a-z]{6}\d!", got[4].text)
    assert "version 1.2.3 and 1.2.3.4.5 stay" in got[1].text
    assert got[9].text.startswith("word " * 20000) and len(got[9].text) == len(TEXTS[9])


def test_coreference_and_distinctness(spark):
    got = run(spark)
    one, two = re.findall(r"\S+@[\w.]+\w", got[0].text)
    assert one.lower() == two.lower() and two.split("@")[0].isupper()
    a, b, c = re.findall(r"\d+\.\d+\.\d+\.\d+(?= to| and|;| again)", got[1].text)[:3]
    assert a == c != b
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[2].text)
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111"
    phones = re.findall(r"\+1[ -]\(?\d{3}\)?[ -]\d{3}-\d{4}", got[0].text)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    domains = [x.split("@")[1].lower() for i in (0, 6) for x in re.findall(r"\S+@[\w.]+\w", got[i].text)]
    assert domains[0] == domains[1] == domains[3] != domains[2]
    assert domains[0].endswith(".com") and domains[2].endswith(".org")


def test_accounts_stay_valid(spark):
    """By the plain rule; a number that was not valid need not become so."""
    real = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"]
    got = run(spark, [f"to {x}." for x in real])
    for i, x in enumerate(real):
        new = got[i].text[3:-1]
        bare = new.replace(" ", "")
        assert new != x and len(new) == len(x) and new[:2] == x[:2] and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    assert spark.range(1).select(mod97(F.lit("de89370400440532013000")).alias("m")).first()["m"] == 1


def test_hmac(spark):
    for key in ("k", "long" * 50):
        assert spark.range(1).select(hmac(key, F.lit("päss")).alias("h")).first()["h"] == plain.new(key.encode(), "päss".encode(), hashlib.sha512).hexdigest()


def test_cutting_marks_in_texts(spark):
    """Texts that hold the characters at which texts are cut come back as they were, but for their entities."""
    got = run(spark, ["a\u0001\u0003b 1 \u0001\u0002", "\u0001bob@mail7.example.com\u0003\u0001"])
    assert got[0].text == "a\u0001\u0003b 1 \u0001\u0002" and got[1].n_entities == 1
    assert re.fullmatch("\u0001[a-z]{3}@[a-z]{4}\\d\\.[a-z]{7}\\.com\u0003\u0001", got[1].text)


def test_names(spark):
    words = run(spark)[3].text.replace(";", "").replace(".", "").split()
    latin = [w for w in words if re.fullmatch(r"[A-Z][a-z]+", w) and w not in ("Mr", "Mrs", "Herr", "Frau")]
    john, smith, smith2, m1, m2 = latin
    assert smith == smith2 and m1 == m2 and len({john, smith, m1, "Smith", "John"}) == 5 and john.endswith("us")
    assert len(re.findall(r"г-жа [А-Я][а-я]+|г-н [А-Я][а-я]+", run(spark)[3].text)) == 2 and "Иванова" not in run(spark)[3].text


def test_many_collide(spark):
    """Of octets of one digit there are few: all surrogates still differ, and none is a real value."""
    ips = [f"{a}.{b}.7.7" for a in range(1, 10) for b in range(1, 10)]
    got = run(spark, [f"at {x} it" for x in ips])
    new = [r.text.split()[1] for r in got.values()]
    assert len(set(new)) == len(ips) and not set(new) & set(ips)


def test_short_local_parts_of_one_domain(spark):
    """All addresses of a form that has no more: as written they still differ, and none is a real one."""
    real = [f"{a}.{n:02}@mail7.example.com" for a in "abcdefghijklmnopqrstuvwxyz" for n in range(100)] + [f"e{a}.{n:02}@mail7.example.com" for a in "abcd" for n in range(100)]
    got = run(spark, [" ".join(real[i : i + 100]) for i in range(0, len(real), 100)] + [real[5].upper()])
    new = [x for i in range(len(real) // 100) for x in got[i].text.split()]
    assert len(new) == len(real) == len(set(new)) and not set(new) & set(real) and len({x.split("@")[1] for x in new}) == 1
    assert got[len(real) // 100].text.lower() == new[5]


def test_key_luhn_native(spark):
    assert run(spark, TEXTS[:2])[0].text == run(spark, TEXTS[:2])[0].text != run(spark, TEXTS[:2], "other")[0].text
    card = re.findall(r"\d{16}", run(spark)[2].text)[0]
    assert spark.range(1).select(luhn(F.lit(card), F.lit(16)).alias("s")).first()["s"] % 10 == 0
    plan = pseudonymise(spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string"), "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_and_odd(odd, empty):
    assert pseudonymise(empty, "k").collect() == []
    assert pseudonymise(odd, "k").count() == odd.count()
