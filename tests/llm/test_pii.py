import datetime
import random
import re
import time

import pytest

from chronotopia.llm import pii as M

OWN = M.Pseudonyms(b"k")


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000, 4099])
def test_network_is_a_permutation_without_fixed_points(n):
    f = M.Feistel(b"k", "t", n)
    image = [f.encrypt(x) for x in range(n)]
    assert sorted(image) == list(range(n)) and all(x != y for x, y in enumerate(image))
    assert all(f.decrypt(y) == x for x, y in enumerate(image))


def test_large_domains_come_back():
    f, rng = M.Feistel(b"k", "t", 26**40), random.Random(1)
    for _ in range(50):
        x = rng.randrange(26**40)
        assert f.decrypt(f.encrypt(x)) == x != f.encrypt(x)


def test_formats_and_validity():
    text = "a on.19@mail5.example.com b +1 (771) 555-1655 c 4337166598464399 d 8.196.197.208. e 2001-02-28, 31.12.1999 f 078-05-1120 g GB82 WEST 1234 5698 7654 32 h 4337-1665-9846-4399 i 12/25/2020"
    new, spans = OWN.replace(text)
    assert [k for *_, k in spans] == ["mail", "phone", "card", "ip", "date", "date", "ssn", "iban", "card", "date"]
    for a, z, _ in spans:
        assert text[a:z] not in new
    assert re.fullmatch(r"a [a-z]{2}\.\d\d@mail5\.example\.com b \+1 \(\d{3}\) \d{3}-\d{4} c \d{16} d \d+\.\d+\.\d+\.\d+\. e \d{4}-\d\d-\d\d, \d\d\.\d\d\.\d{4} f \d{3}-\d\d-\d{4} g GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d h \d{4}-\d{4}-\d{4}-\d{4} i \d\d/\d\d/\d{4}", new)
    card = re.search(r"c (\d{16})", new)[1]
    assert M.luhn(card) and card == re.search(r"h ([\d-]+)", new)[1].replace("-", "")
    datetime.date.fromisoformat(re.search(r"\d{4}-\d\d-\d\d", new)[0])
    assert [k for *_, k in OWN.replace(new)[1]] == [k for *_, k in spans]
    assert OWN.replace(text)[0] == new


def test_what_is_not_valid_stays():
    for text in ("4337166598464398", "999.1.1.1", "2001-02-30", "Apache License, Version 2.0.", "666-01-0001", "1111111111111111", "GB82 WEST 1234 5698 7654 33", "", "no@", "3.14 15"):
        assert OWN.replace(text) == (text, [])
    assert OWN.replace(None) == (None, [])


def test_repeated_numbers_are_all_replaced():
    new, spans = OWN.replace(" ".join(["4337166598464399"] * 20) + " +1 (017) 555-7713 4337166598464399")
    assert len(spans) == 22 and "4337166598464399" not in new and len(set(new.split()[:20])) == 1


def test_query_on_edge_rows(spark, tmp_path):
    rows = [(1, "x@y.org", "a"), (1, "x@y.org", "a"), (2, None, None), (None, "", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, _pii string").write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op6_pii(spark, str(tmp_path)).collect()
    assert len(got) == 4 and sum(r.n_mail for r in got) == 2 and "x@y.org" not in [r.text for r in got]
    assert sum(r.text is None for r in got) == 1


def test_addresses_of_signs_and_of_any_length():
    for local in ("_", ".-%", "a" * 200, "x" * 63 + "." + "_" * 90, "A1%b"):
        text = f"to {local}@x.org and {local}@x.org"
        new, spans = OWN.replace(text)
        own = re.fullmatch(r"to ([A-Za-z0-9._%+-]+)@x\.org and \1@x\.org", new)
        assert len(spans) == 2 and own[1] != local and len(own[1]) == len(local)
    assert len({OWN.replace(f"{a}@x.org")[0] for a in "._%+-"}) == 5


def by_hand(text):
    """Spans by the plain rule: kind after kind, what meets no span before it and is valid."""
    found = []
    for kind in M.KINDS:
        for m in kind.pattern.finditer(text):
            if all(m.end() <= a or m.start() >= z for a, z, _ in found) and kind.replace(m, lambda name, x, n: x) is not None:
                found.append((m.start(), m.end(), kind.name))
    return sorted(found)


def test_spans_are_as_by_hand_and_the_key_undoes_all():
    rng = random.Random(4)
    parts = ["on.19@mail5.example.com", "+1 (771) 555-1655", "4337166598464399", "8.196.197.208", "2001-02-28", "31.12.1999", "078-05-1120", "GB82 WEST 1234 5698 7654 32", "1.2.3", "@", "a@b", "12/25/2020", "_@x.org", "no word", "é"]
    back = M.Pseudonyms(b"k")
    back.rank = lambda name, x, n: back.network(name, n).decrypt(x)
    for _ in range(200):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        new, spans = OWN.replace(text)
        assert spans == by_hand(text)
        assert back.replace(new)[0] == text


def test_a_long_text_of_addresses_takes_linear_time():
    text = " ".join(f"u{i}@x{i % 7}.org" for i in range(60_000))
    began = time.time()
    new, spans = OWN.replace(text)
    assert len(text) > 800_000 and len(spans) == 60_000 and len(set(new.split())) == 60_000 and time.time() - began < 60


def test_empty_table_and_key(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert M.op6_pii(spark, str(tmp_path)).collect() == []
    df = spark.createDataFrame([(1, "x@y.org")], "doc_id long, text string")
    one, two = (M.pseudonymize(df, k).first().text for k in (b"a", b"bc"))
    assert one.endswith("@y.org") and two.endswith("@y.org") and "x@y.org" not in (one, two)
    with pytest.warns(UserWarning):
        assert M.key_of(spark) == M.DEMO_KEY
