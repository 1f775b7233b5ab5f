import hashlib
import re

import pytest

from strandline.llm import pii

from .helpers import ODD, documents

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(s):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(s))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(out)]


TEXTS = [
    "a@b.cd_e@f.gh x@y.z@q.w.e a@b @c.d a@b..c %+-@x.y-.z",
    "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4 1.2.3 255.255.255.255 256.1.1.1 00000255.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111x 378282246310005 12345678901234567890123 4111  1111 1111 1111",
    "+1 (269) 555-3296 4524132264652876 +33 1 23 45 67 89 +12345 +1234567890. +1-1.+2.3 +1()2",
    "é😀 mail: bob@example.com, tel. +49 30 1234567; ip 10.0.0.1, 😀 4111111111111111",
    "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 1-2-3-4-5-6-7-8-9-0-1-2-3-4-5",
    "9" * 40 + " " + "1 " * 30 + "a" * 300 + "@" + "b." * 100 + "c",
]


def spans(found):
    return {r.doc_id: r for r in pii.digest(found).collect()}


def test_base_spans_are_those_of_the_rules(spark):
    d = documents(spark, [(k, t, "en", "a", 1) for k, t in enumerate(TEXTS)], clash=("c", "spans", "base", "kind"))
    found = spans(pii.spans(d))
    for k, t in enumerate(TEXTS):
        want, r = brute(t), found[k]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, r.spans)
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(kind) for w in want) for kind, _ in BASE]


def test_classifier_adds_what_the_rules_lose(spark):
    extra = "call +1 (269) 555-3296 4524132264652876 or bob [at] mail [dot] com"
    more = [(100 + k, f"call +1 (555) 555-{k:04d} or mail a{k}@mail.com from 10.1.{k}.2, card 4111111111111111", "en", "a", 1) for k in range(40)]
    r = spans(pii.spans(documents(spark, [(1, extra, "en", "a", 1), *more])))[1]
    said = {extra[int(a) : int(b)] for _, a, b in (s.split(":") for s in r.spans.split(","))}
    assert said == {"+1 (269) 555-3296", "4524132264652876", "bob [at] mail [dot] com"}
    assert (r.n_email, r.n_card, r.n_phone) == (0, 0, 0)


def test_clean_texts_stay_clean(spark):
    clean = ["version 4.0.1 of 2020", "12345 and 99", "call me", "a @ b", "3.14 + 2", "id 1234-5678"]
    found = spans(pii.spans(documents(spark, [(k, t, "en", "a", 1) for k, t in enumerate(clean)])))
    assert all(r.spans == "" for r in found.values())


def test_odd_rows_and_empty_table(spark):
    found = pii.digest(pii.spans(documents(spark))).collect()
    assert len(found) == len(ODD) and all(r.spans == "" for r in found)
    assert pii.digest(pii.spans(documents(spark, []))).collect() == []


def test_long_runs_take_linear_time(spark):
    text = "a" * 200_000 + " " + "1" * 200_000 + " " + "1 " * 50_000 + "+" + "1 " * 50_000 + "@" * 1000 + "1." * 50_000
    r = pii.digest(pii.spans(documents(spark, [(1, text, "en", "a", 1)]))).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (0, 12_500, 0, 0)


def test_estimation_tells_good_labelers_from_bad():
    counts = [(0, [1, 1, 0, 1, 0], 900), (0, [-1, -1, 0, 1, 0], 300), (0, [1, -1, 0, 1, 0], 20), (0, [-1, 1, 0, -1, 0], 15)]
    prob, trust = pii.estimate(counts)
    assert prob[0, (1, 1, 0, 1, 0)] > 0.95 and prob[0, (-1, -1, 0, 1, 0)] < 0.05
    assert trust["email"]["form"]["for"] > 0.9 > 0.2 > trust["email"]["form"]["false alarm"]
    assert pii.train(counts).weights["form1"] > 0 > pii.train(counts).weights["form-1"]
    assert pii.train([]).weights == {}


@pytest.mark.parametrize("digits,ok", [("4111111111111111", True), ("4111111111111112", False), ("0", True)])
def test_luhn(spark, digits, ok):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.luhn(F.lit(digits))).first()[0] is ok


def test_many_spans_in_one_text(spark):
    text = " ".join(f"a{k}@b.example 10.0.{k % 256}.1 +1 555 010 {k % 10000:04d}" for k in range(700))
    got = pii.digest(pii.spans(documents(spark, [(1, text, "en", "a", 1)]))).first()
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert got.n_email == len(want) == 700 and got.n_ip == 700
    assert [s for s in got.spans.split(",") if s.startswith("email")] == want
