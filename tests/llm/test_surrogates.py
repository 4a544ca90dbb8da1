import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, surrogates

from .conftest import SMALL

TEXTS = {
    1: "Mr. John Smith met Mrs. Anna Weber. Later Mr. Smith called +1 (017) 555-7713 or +1-017-555-7713; mail a.b7@mail.example.com A.B7@MAIL.EXAMPLE.COM.",
    2: "card 4111111111111111 and 4111 1111 1111 1111, ip 97.51.17.173 ssn 123-45-6789 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"",
    3: None, 4: "", 5: "DE89 3704 0044 0532 0130 00 господин Иван Петров.", 6: "The year 2024 had 365 days and version 2.0.1 of it.", 7: "Call +1 (017) 555-7713.",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def run(spark, texts, key="key", **more):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r for r in surrogates.pseudonymise(docs, key, **more).collect()}


def test_format_type_and_coreference(spark):
    got = run(spark, TEXTS)
    one = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Later Mr\. (\w+) called (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1-\d{3}-\d{3}-\d{4}); "
                       r"mail ([a-z]\.[a-z]\d@\w+\.\w+\.com) ([A-Z]\.[A-Z]\d@\w+\.\w+\.COM)\.", got[1].text)
    first, last, her, _, again, phone, dashed, mail, shout = one.groups()
    assert last == again and mail.upper() == shout and re.sub(r"\D", "", phone) == re.sub(r"\D", "", dashed)
    assert first in surrogates.FIRST["latin", "male"] and her in surrogates.FIRST["latin", "female"]
    assert got[7].text == f"Call {phone}."
    card, spaced = re.match(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4})", got[2].text).groups()
    assert card == spaced.replace(" ", "") and luhn(card) and card != "4111111111111111"
    assert all(int(x) < 256 for x in re.search(r"ip ([\d.]+) ", got[2].text).group(1).split("."))
    assert re.search(r'token = "[0-9a-f]{40}"', got[2].text)
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d господин [А-Я][а-я]+ [А-Я][а-я]+\.|DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d господин [А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+\.",
                        got[5].text)
    for doc in (3, 4, 6):
        assert got[doc].text == TEXTS[doc] and got[doc].n_mentions == 0
    assert run(spark, TEXTS, key="other")[7].text != got[7].text and run(spark, TEXTS)[1].text == got[1].text


def test_the_hint_holds_for_every_pattern(spark):
    samples = {"email": ["a@b.de"], "iban": ["GB29 NWBK ABCD EFGH", "DE89370400440532013000"], "ip": ["1.2.3.4"], "ssn": ["123-45-6789"],
               "secret": ["deadbeef" * 4, "AKIA" + "A" * 16, "ghp_" + "b" * 16, "sk-" + "c" * 16], "card": ["4111 1111 1111 1111"],
               "phone": ["+49 30 12 34 56 78", "+49-30-12-34-56", "+33 6 12 34 56 78", "+49 30 1 23 45 67", "+1 (17) 55 77", "(555) 123-4567", "555.123.4567"],
               "name": ["Mr. Abcd", "Herr Abcd", "господин Петров", "госпожа Анна", "Anna Abcd", "Иван Петров"]}
    assert set(samples) == set(surrogates.PATTERNS)
    rows = [(kind, value) for kind, values in samples.items() for value in values]
    got = spark.createDataFrame(rows, "kind string, value string").select("kind", "value", F.col("value").rlike(surrogates.HINT).alias("hint"), *[
        F.regexp_extract("value", p, 0).alias(k) for k, p in surrogates.PATTERNS.items()]).collect()
    for r in got:
        assert r.hint and (r[r.kind] if r.kind == "name" else r[r.kind] == r.value), r


def test_paired_and_single_digits_alone_and_beside_other_mentions(spark):
    numbers = ["+49 30 12 34 56 78", "+49-30-12-34-56", "+33 6 12 34 56 78"]
    got = run(spark, {**{k: f"call {n} or so" for k, n in enumerate(numbers)}, **{10 + k: f"call {n} or a@b.de" for k, n in enumerate(numbers)}})
    for k, number in enumerate(numbers):
        alone, beside = got[k].text[5:-6], got[10 + k].text.split(" or ")[0][5:]
        assert alone == beside != number and re.sub(r"\d", "", alone) == re.sub(r"\d", "", number)
        assert (got[k].n_mentions, got[10 + k].n_mentions) == (1, 2)


def test_bare_surnames_in_the_rest_of_the_text(spark):
    got = run(spark, {1: "Quandel was seen. Mr. John Quandel left; Quandel's car and QUANDEL stayed, Quandels too. Quandel Anna Weber.", 2: "Quandel alone."})
    one = re.fullmatch(r"(\w+) was seen\. Mr\. (\w+) (\w+) left; (\w+)'s car and (\w+) stayed, Quandels too\. (\w+) (\w+) (\w+)\.", got[1].text).groups()
    assert one[0] == one[2] == one[3] == one[5] != "Quandel" and one[4] == one[0].upper() and got[1].n_mentions == 8
    assert got[2].text == "Quandel alone." and got[2].n_mentions == 0


def test_distinct_entities_stay_distinct(spark):
    people = {k: f"Mr. Q{chr(97 + k % 26)}{chr(97 + k // 26)}name left." for k in range(120)}
    got = run(spark, people)
    assert len({r.text for r in got.values()}) == 120 and not {r.text for r in got.values()} & set(people.values())
    entities = spark.range(3000).select(F.lit("ssn").alias("kind"), F.lpad(F.col("id").cast("string"), 4, "0").alias("entity"))
    made = surrogates.assign(entities, "k").collect()
    assert len(made) == 3000 == len({r.surrogate for r in made}) and not {r.surrogate for r in made} & {r.entity for r in made}


def test_a_format_that_is_used_up(spark):
    """All 26 x 26 addresses of one form, as entities and in texts; one address of another form alone; one digit left of a hundred."""
    mails = [f"{a}@{b}.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = run(spark, {k: f"mail {m} now" for k, m in enumerate(mails)} | {1000: f"again {mails[5]}"})
    shown = [got[k].text[5:-4] for k in range(676)]
    assert sorted(shown) == mails and all(a != b for a, b in zip(shown, mails)) and got[1000].text == f"again {shown[5]}"
    few = [("ssn", f"{i:02d}") for i in range(100)] + [("ssn", "7"), ("phone", "12345")]
    made = {r.entity: r.surrogate for r in surrogates.assign(spark.createDataFrame(few, "kind string, entity string"), "k", attempts=2).collect()}
    assert sorted(v for k, v in made.items() if len(k) == 2) == [f"{i:02d}" for i in range(100)] and all(k != v for k, v in made.items())
    assert len(set(made.values())) == 102


def test_one_left_over_changes_places(spark):
    left = spark.createDataFrame([("ssn", "11")], "kind string, entity string")
    settled = spark.createDataFrame([("ssn", "22", "90"), ("ssn", "33", "91"), ("ssn", "444", "555")], "kind string, entity string, surrogate string")
    got = sorted((r.entity, r.surrogate) for r in surrogates.exchange(left, settled, "k").collect())
    assert got == [("11", "90"), ("22", "11"), ("33", "91"), ("444", "555")]


def test_a_key_is_needed(spark, nothing):
    with pytest.raises(ValueError):
        surrogates.pseudonymise(nothing, "")
    assert surrogates.session_key(spark) == surrogates.session_key(spark)


PRIVATE = r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\d.])\d{16}(?!\d)|\b[0-9a-f]{40}\b|(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d.])"


def test_query_leaves_no_private_data_and_nothing_else_changed(spark, documents):
    before = {r.doc_id: r.text for r in documents.collect()}
    after = {r.doc_id: r.text for r in queries.op8_surrogates(spark, SMALL).collect()}
    assert set(before) == set(after)
    seen, mapping = 0, {}
    for doc, text in before.items():
        found = re.findall(PRIVATE, text)
        seen += len(found)
        pieces = re.split(PRIVATE, text)
        at = 0
        for piece in pieces:  # the text between mentions is as before, in order
            at = after[doc].index(piece, at) + len(piece)
        rest = after[doc]
        for mention in found:
            assert mention not in rest
        if len(found) == 1:
            start = len(pieces[0])
            mapping.setdefault(found[0], set()).add(rest[start: len(rest) - len(pieces[1])])
    assert seen and all(len(v) == 1 for v in mapping.values())


def test_corner_cases(corner, nothing):
    out = surrogates.pseudonymise(corner, "key")
    assert out.count() == corner.count() and out.columns == [*corner.columns, "n_mentions"]
    assert sorted((r.text or "") for r in out.collect()) == sorted((r.text or "") for r in corner.collect())
    assert surrogates.pseudonymise(nothing, "key").count() == 0
