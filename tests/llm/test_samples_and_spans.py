"""Samples of the classifiers, spans of sentences, and lines of real texts against edit similarity alone."""

import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sightline.llm import cluster, edits, language, line_dedup, mixing, ngram_join, toxicity, training

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def test_rare_languages_are_learned(spark):
    rows = [(k, f"common words here {k} and there", "en") for k in range(600)] + [(601, "völlig andere wörter", "de"), (602, "palabras muy distintas", "es"), (603, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0 OR doc_id > 600")
    rare = [r["lang"] for r in docs.where("doc_id > 600 AND text IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0").collect()]
    model = language.fit(docs, each=2, most=4)
    assert set(model.languages) == {"en", *rare}
    again = language.fit(docs.repartition(7), each=2, most=4)
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.idf, again.idf)


def test_weights_count_all_texts(spark):
    texts = ["ab ab", "ab cd", None, "xy"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    raw = [language.term_counts(*_slice([t]), 12)[0] > 0 for t in texts]
    want = np.log(5 / (1 + np.sum(raw, axis=0))) + 1
    assert np.allclose(language.weights(docs, 12), want, atol=1e-6)


def _slice(texts):
    import pyarrow as pa

    from sightline.llm.textkit import text_slices

    (found,) = text_slices(pa.array(texts, type=pa.string()))
    return found[2], found[3]


def test_a_document_counts_once_in_the_sample(spark):
    docs = spark.createDataFrame([(1, "a", 1)] * 50 + [(1, "b", 2), (2, None, 3), (None, "x", 4)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 0, None), (3, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = training.labelled(docs, labels, "toxic", 10).collect()
    known = [k for k in (1, 2) if docs.limit(1).select(training.in_fold("doc_id", 5)).count() and not spark.createDataFrame([(k,)], "doc_id long").select(training.in_fold("doc_id", 5)).first()[0]]
    assert sorted(r["doc_id"] for r in got) == known
    assert all(r["label"] == 1 and r["text"] in ("a", "b") for r in got if r["doc_id"] == 1)
    assert all(r["text"] == "" for r in got if r["doc_id"] == 2)


def test_offending_spans_are_sentences_that_offend(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).where(F.size("offending") > 0).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = [texts[r["doc_id"]][s["start"] : s["end"]] for r in found for s in r["offending"]]
    assert pieces and all(sum(c in ".!?\n" for c in p.rstrip(".!?\n")) == 0 for p in pieces)
    alone = toxicity.score(spark.createDataFrame(list(enumerate(pieces)), "doc_id long, text string"), model)
    assert all(r["score"] >= 0.5 for r in alone.collect())
    long = "é. " * 3 + pieces[0].strip() + ". " + ("ü ok. " + pieces[0].strip() + ". ") * 2000
    (one,) = toxicity.score(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).collect()
    assert len(one["offending"]) >= 2001 and all(pieces[0].strip(" .!?\n")[:12] in long[s["start"] : s["end"]] for s in one["offending"])


def test_lines_of_real_texts_by_edit_similarity_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lines = {}
    for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist():
        for number, x in enumerate((r["text"] or "").split("\n")):
            words = " ".join(WORDS.findall(x.lower()))
            if len(words) >= 9:
                lines.setdefault(words, []).append((r["doc_id"], number))
    texts = sorted(lines, key=len)
    links = []
    for a, x in enumerate(texts):
        for b in range(a + 1, len(texts)):
            if len(x) < 0.9 * len(texts[b]) - 1e-9:
                break
            links.append((a, b))
    most = np.array([int(0.1 * len(texts[b]) + 1e-9) for _, b in links])
    similar = [p for p, ok in zip(links, edits.many_within([(texts[a], texts[b]) for a, b in links], most)) if ok]
    forest = cluster.Forest(len(texts))
    for a, b in similar:
        forest.join(a, b)
    groups = {}
    for k, x in enumerate(texts):
        groups.setdefault(forest.root(k), []).extend(lines[x])
    want = {place for places in groups.values() for place in places if place != min(places)}
    got = {(r["doc_id"], r["line"]) for r in line_dedup.repeated_lines(docs).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


@pytest.mark.parametrize("words", [6, 12, 25, 60, 150])
def test_one_changed_word_is_found_at_every_length(spark, words):
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7)))
    rows, similar = [], 0
    for k in range(60):
        line = [word() for _ in range(words)]
        other = list(line)
        at = rng.randrange(words)
        other[at] = word()[: len(line[at])].ljust(len(line[at]), "n")
        a, b = " ".join(line), " ".join(other)
        if a != b and line_dedup.similar(a, b, 0.9):
            rows += [(2 * k, a), (2 * k + 1, b)]
            similar += 1
    if similar:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = {(r["doc_id"], r["kept_doc"]) for r in line_dedup.repeated_lines(docs).collect()}
        assert found <= {(a + 1, a) for a, _ in rows} and len(found) >= 0.9 * similar


def test_topics_may_be_given(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 3), "s", "en", "art" if k % 4 else None, k) for k in range(40)], "doc_id long, text string, source string, lang string, topic string, weight long")
    got = mixing.mixed(docs, topics=F.col("topic")).collect()
    assert {r["topic"] for r in got} == {"art", "unknown"} and all(r["n_tokens"] == 1 + r["doc_id"] % 3 for r in got)
    kept = mixing.mixed(docs, topics=F.col("topic"), keep=["doc_id"])
    assert sorted(map(tuple, kept.select("doc_id", "topic", "chance", "drawn").collect())) == sorted((r["doc_id"], r["topic"], r["chance"], r["drawn"]) for r in got)
    assert {r["weight"] for r in mixing.sampled(docs).collect()} <= set(range(40))


def test_tables_go_when_forgotten_and_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    held = cluster.written(spark.range(5))
    assert held.count() == 5
    files = held.inputFiles()
    cluster.forget(spark)
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)

    class Conf:
        def get(self, *_):
            return None

    class Far:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Scala:
                        @staticmethod
                        def getCheckpointDir():
                            class Empty:
                                @staticmethod
                                def isEmpty():
                                    return True

                            return Empty

                    return Scala

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cluster.shared_folder(Far)


def test_many_copies_and_empty_texts_stay_groups(spark):
    rows = [(k, "the same few words in all of these texts") for k in range(50)] + [(100 + k, None if k % 2 else "...") for k in range(30)]
    got = {r["doc_id"]: r for r in ngram_join.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k]["class_id"] == 0 and got[k]["n_links"] == 49 and got[k]["n_copies"] == 50 for k in range(50))
    assert all(got[k]["class_id"] == k and got[k]["n_links"] == 0 and got[k]["n_copies"] == 1 for k in range(100, 130))
    assert len(list(itertools.chain(got))) == 80
