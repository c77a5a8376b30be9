"""The pipeline's stages on a small corpus with planted cases, each against what its input says."""

import random
import re

import pytest

import corpus_pipeline
from sightline.llm import edits, ngram_join, toxicity

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def planted(passage):
    rng = random.Random(8)
    long, line = prose(rng, 200), prose(rng, 30)
    changed = long.split()
    changed[90] = "zzzz"
    texts = {
        "copy": [long] * 4, "near": [" ".join(changed)], "passage": [f"{prose(rng, 40)} {passage} {prose(rng, 40)}"], "clean": [prose(rng, 80) for _ in range(20)],
        "lines": [f"{prose(rng, 25)}\n{line}\n{prose(rng, 25)}", f"{line.upper()}!\n{prose(rng, 25)}", line + " x"], "none": [None, "", " \n"],
    }
    return [(kind, text) for kind, own in texts.items() for text in own]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    passage = max((r["text"] for r in bench.collect()), key=len)
    rows = [(10**6 + k, text, "en", "planted", len(text or "")) for k, (_, text) in enumerate(planted(passage))]
    docs = small.unionByName(spark.createDataFrame(rows, small.schema))
    docs.write.parquet(f"{at}/documents.parquet")
    bench.write.parquet(f"{at}/benchmark.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    kinds = {10**6 + k: kind for k, (kind, _) in enumerate(planted(passage))}
    stages, now = {}, spark.read.parquet(f"{at}/documents.parquet")
    stages["start"] = now.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = f"{at}/{name}"
        (made := stage(spark, now, at)).write.parquet(out)
        assert made.columns == docs.columns
        now = spark.read.parquet(out)
        stages[name] = now.collect()
    return at, kinds, stages


def ids(rows):
    return [r["doc_id"] for r in rows]


def test_toxic_documents_go(spark, corpus):
    at, kinds, stages = corpus
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"] for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
    assert sorted(ids(stages["toxicity"])) == sorted(k for k in ids(stages["start"]) if k not in toxic)
    assert set(kinds) <= set(ids(stages["toxicity"]))


def lines_of(text):
    return [" ".join(WORDS.findall(x.lower())) for x in (text or "").split("\n")]


def test_repeated_lines_go(corpus):
    _, kinds, stages = corpus
    before = {r["doc_id"]: r["text"] for r in stages["toxicity"]}
    after = {r["doc_id"]: r["text"] for r in stages["line_dedup"]}
    kept, was = set(), set()
    for text in before.values():
        was.update(x for x in lines_of(text) if len(x) >= 9)
    for text in after.values():
        for x in lines_of(text):
            if len(x) >= 9:
                assert x not in kept  # no line stays twice
                kept.add(x)
    # what went is like something that stayed
    like = lambda a, b: edits.edits_within(a, b, int(0.1 * max(len(a), len(b)) + 1e-9))
    gone = was - kept
    assert all(any(like(x, y) for y in kept | gone if y != x) for x in gone)
    for k, kind in kinds.items():
        if kind == "clean" or (kind == "none" and before[k] is None):
            assert after[k] == before[k]
    copies = [k for k, kind in kinds.items() if kind == "copy"]
    assert [k for k in copies if k in after] == copies[:1] and len(after) < len(before)


def test_one_of_each_group_of_documents_stays(spark, corpus):
    at, kinds, stages = corpus
    rows = stages["line_dedup"]
    grams = {}
    for r in rows:
        w = WORDS.findall((r["text"] or "").lower())
        grams[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    alike = lambda a, b: bool(grams[a]) and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    kept = set(ids(stages["ngram_jaccard_join"]))
    for a in grams:
        near = [b for b in grams if b != a and alike(a, b)]
        assert a in kept or any(b < a for b in near)
        assert not (a in kept and any(b in kept for b in near))
    direct = {r["doc_id"] for r in ngram_join.deduplicate(spark.read.parquet(f"{at}/documents.parquet")).collect()}
    assert sum(kinds.get(k) in ("copy", "near") for k in direct) == 1


def test_documents_with_benchmark_passages_go(spark, corpus):
    at, kinds, stages = corpus
    before, after = set(ids(stages["ngram_jaccard_join"])), set(ids(stages["benchmark_decontamination"]))
    passages = [" ".join(WORDS.findall((r["text"] or "").lower())) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    exact = {r["doc_id"] for r in stages["ngram_jaccard_join"] if any(len(p) >= 12 and p in " ".join(WORDS.findall((r["text"] or "").lower())) for p in passages)}
    assert exact and not exact & after and any(kinds.get(k) == "passage" for k in exact)
    assert {k for k in before if kinds.get(k) in ("clean", "none")} <= after


def test_mixing_draws_some_and_changes_none(corpus):
    _, _, stages = corpus
    before = {r["doc_id"]: r for r in stages["benchmark_decontamination"]}
    drawn = stages["mixing"]
    assert all(before[r["doc_id"]] == r for r in drawn) and not any(not (r["text"] or "").split() for r in drawn)
    tokens = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert 0.3 < tokens(drawn) / tokens(before.values()) < 0.7
