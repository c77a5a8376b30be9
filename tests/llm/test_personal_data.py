"""Personal data against the plain patterns, on random, odd and very long texts."""

import hashlib
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from sightline.llm import pii, queries

PLAIN = [re.compile(p) for p in (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)]


def plain(text):
    """The base spans as the patterns and tests state them."""
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_find_is_the_plain_patterns():
    rng = random.Random(3)
    found = 0
    for _ in range(20_000):
        letters = rng.choice(["a1.@-", "12. -+", "0123456789 -", "a@.", "+1 (.-)0", "a_b.@%1+ -", "4 -"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        want = plain(text)
        found += len(want)
        assert pii.find(text) == want, text
    assert found > 1000


def test_query_is_the_plain_patterns_on_whole_tables(spark):
    small = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op8_pii(spark, small).collect()}
    texts = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(texts)
    for t in texts:
        want = plain(t["text"] or "")
        r = got[t["doc_id"]]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for _, k, _ in want) for kind in range(4)]
        told = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(filter(None, told)) <= set(r["spans"].split(","))


LONG = ["9" * 1_000_000, "9" * 5000 + ".1.2.3", "0" * 5000 + "1.2.3.4", "a" * 200_000 + "@" + "a" * 200_000, "@a.b" * 50_000, "_" * 100_000 + "at" + "_" * 100_000, "1 " * 100_000, "1." * 100_000, "+1 " * 50_000, "O1" * 50_000, "one " * 50_000, "a@b.co " * 50_000 + "x [at] y.com"]


@pytest.mark.parametrize("text", LONG, ids=[t[:6] for t in LONG])
def test_long_texts_take_linear_time(text):
    began = time.perf_counter()
    base = pii.find(text)
    pii.added(text, base)
    assert time.perf_counter() - began < 10
    assert [s for s in base if s[1] == 1 and text[0] in "09"] == ([(0, 1, len(text))] if text.startswith("0") else [])


def test_addresses_in_disguise():
    for text, want in {
        "host 10.O.0.1 is up": [(5, 1, 13)],
        "one nine two dot one six eight dot zero dot one": [(0, 1, 47)],
        "mail bob at x dot com now": [(5, 0, 21)],
        "I.O.S.B": [],
    }.items():
        assert pii.added(text, pii.find(text)) == want


def test_redaction_of_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "to a@1.2.3.4, bye"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert got == {1: "to <EMAIL>, bye", 2: None, 3: ""}
