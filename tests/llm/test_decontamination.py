"""Benchmark passages that repeat, touch and overlap, against alignment at every place."""

import random

import numpy as np
import pytest

from sightline.llm import decontaminate

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9))) for _ in range(n))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, item_id long")


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def edited(rng, text, n):
    out = list(text)
    for at in rng.sample(range(4, len(text) - 4), n):
        out[at] = rng.choice(LETTERS.upper()) if out[at] != " " else "x"
    return "".join(out)


@pytest.mark.parametrize("times", [2, 3, 7])
def test_adjacent_repeats_are_all_found(spark, times):
    rng = random.Random(times)
    passage = prose(rng, 12)
    docs = frame(spark, [" ".join([passage] * times), prose(rng, 30), " / ".join([passage, prose(rng, 5), passage.upper()])])
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench(spark, [passage])).drop("row_key").collect())
    size = len(passage)
    assert [g for g in got if g[0] == 0] == [(0, 0, 0, k * (size + 1), k * (size + 1) + size) for k in range(times)]
    assert [g[3] for g in got if g[0] == 2] == [0, len(docs.collect()[2]["text"]) - size]
    assert not [g for g in got if g[0] == 1]


def test_edited_neighbours_are_found_with_their_edits(spark):
    rng = random.Random(9)
    passages = [prose(rng, rng.randint(14, 30)) for _ in range(6)]
    texts, want = [], []
    for k in range(40):
        parts, at, own = [], 0, []
        for _ in range(rng.randint(2, 6)):
            if rng.random() < 0.7:
                i = rng.randrange(6)
                n = rng.randint(0, decontaminate.budget(len(passages[i]), 12, 0.07)[0])
                part = edited(rng, passages[i], n)
                own.append((k, i, at, at + len(part), distance(passages[i], part.lower())))
            else:
                part = prose(rng, rng.randint(1, 8))
            parts.append(part)
            at += len(part) + 1
        texts.append(" ".join(parts))
        want += own
    found = decontaminate.contaminated(frame(spark, texts), bench(spark, passages)).collect()
    got = {(r["doc_id"], r["item_id"], r["start"] // 8): r for r in found}
    assert len(found) == len(want)
    for doc, item, start, end, edits in want:
        near = [r for r in found if r["doc_id"] == doc and r["item_id"] == item and abs(r["start"] - start) <= 5 and abs(r["end"] - end) <= 5]
        assert len(near) == 1 and near[0]["edits"] <= edits, (doc, item, start, got)
        piece = " ".join(texts[doc][near[0]["start"] : near[0]["end"]].lower().split())
        assert distance(passages[item], piece) == near[0]["edits"]


def test_blocks_give_the_same_rows(spark):
    rng = random.Random(5)
    passages = [prose(rng, 15) for _ in range(8)] + [None, "", "tiny"]
    texts = [f"{prose(rng, 4)} {p} {prose(rng, 3)} {p}" for p in passages if p] + [None, "", "x"]
    docs, items = frame(spark, texts), bench(spark, passages)
    one = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    many = sorted(map(tuple, decontaminate.contaminated(docs, items, most_bytes=3000).collect()))
    assert one == many and len(one) == 16
    for most_bytes in (64 << 20, 3000):
        left = decontaminate.without_contaminated(docs, items, most_bytes=most_bytes)
        assert sorted(r["doc_id"] for r in left.collect()) == [8, 9, 10, 11] and left.columns == docs.columns
    assert decontaminate.contaminated(docs, items.where("item_id < 0")).count() == 0
    assert decontaminate.contaminated(docs.where("doc_id < 0"), items).count() == 0


def test_free_parts():
    taken = decontaminate.Taken()
    assert taken.add(0, 5, 9) and taken.add(1, 20, 30) and not taken.add(0, 8, 12) and taken.add(0, 9, 11)
    assert list(taken.free(0, 40)) == [(0, 5), (11, 20), (30, 40)] and list(taken.free(6, 10)) == [] and list(taken.free(10, 22)) == [(11, 20)]


def test_long_run_of_repeats_is_quick():
    rng = random.Random(2)
    passage = np.frombuffer(prose(rng, 20).encode(), dtype=np.uint8)
    text = np.frombuffer(b" ".join([passage.tobytes()] * 2000), dtype=np.uint8)
    got = decontaminate.occurrences(text, passage, 5, [(0, len(text))])
    assert len(got) == 2000 and all(e == 0 for e, _, _ in got)
