"""Each operator on small tables: against brute force, on held-out labels, and on odd rows."""

import itertools
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest

from sightline.llm import cluster, decontaminate, embedding_dedup, language, language_model, line_dedup, mixing, ngram_join, pii, quality, queries, toxicity

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, more=""):
    """A documents table with a clashing extra column."""
    rows = [(k, t, ["en", "de", None][(k or 0) % 3], f"s{(k or 0) % 2}", len(t or ""), 1) for k, t in texts]
    return spark.createDataFrame(rows, DOC_SCHEMA + ", score int")


def prose(rng, n, words=300):
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(words)]
    return " ".join(rng.choice(pool) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "###"), (None, "a null id"), (6, "same text twice here now"), (6, "same text twice here now"), (7, "word " * 60_000)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def groups_of(n, links):
    forest = cluster.Forest(n)
    for a, b in links:
        forest.join(a, b)
    return [forest.root(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)]
    want = groups_of(141, links)
    for most in (0, 1_000_000):
        got = {r["node"]: r["root"] for r in cluster.components(spark.createDataFrame(links, "a long, b long"), spark, most).collect()}
        assert got == {k: want[k] for k in {x for a, b in links if a != b for x in (a, b)}}
    assert cluster.components(spark.createDataFrame([], "a long, b long"), spark).count() == 0


def test_a_bit_table_comes_back_whole_and_small(spark):
    ids = spark.range(150_000).selectExpr("xxhash64(id) AS node").cache()
    cluster.Bloom.of(ids.limit(10), "node")
    tracemalloc.start()
    made = cluster.Bloom.of(ids, "node")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # as rows of Python the table of 1 MB took 40
    assert most < 8 << 20
    nodes = np.array([r["node"] for r in ids.collect()]).view(np.uint64)
    want = np.zeros(1 << made.bits, dtype=bool)
    want[(nodes & np.uint64((1 << made.bits) - 1)).astype(np.int64)] = True
    want[(nodes >> np.uint64(64 - made.bits)).astype(np.int64)] = True
    assert (np.unpackbits(made.words.view(np.uint8), bitorder="little") == want).all()
    assert not cluster.Bloom.of(ids.where("node IS NULL"), "node").words.any()


def near_texts():
    rng = random.Random(2)
    texts = []
    for g in range(6):
        base = prose(rng, 120).split()
        for v in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            texts.append(" ".join(words))
    texts += [texts[0].upper() + "!", texts[0], "one two", "One, two.", "one", "", "***"]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [400_000, 600])
def test_ngram_join_is_brute_force(spark, block):
    texts = near_texts()
    got = {r["doc_id"]: r for r in ngram_join.ngram_groups(frame(spark, texts), recall=0.9999, block=block).collect()}
    sets = []
    for _, t in texts:
        w = WORDS.findall(t.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    degree = [sum(k in link for link in links) for k in range(len(sets))]
    assert [got[k]["n_links"] for k in range(len(sets))] == degree
    assert [got[k]["class_id"] for k in range(len(sets))] == groups_of(len(sets), links)
    kept = [r["doc_id"] for r in ngram_join.deduplicate(frame(spark, texts), recall=0.9999).select("doc_id").collect()]
    assert sorted(kept) == sorted(k for k, root in enumerate(groups_of(len(sets), links)) if k == root)


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(3)
    lines = [prose(rng, rng.randint(30, 60)) for _ in range(12)]
    lines += [" ".join([*x.split()[:-1], x.split()[-1] + "s"]) for x in lines[:6]] + ["the end", "The END."]
    texts = [(k, "\n".join(rng.choice([x, x.upper() + "."]) for x in rng.choices(lines, k=rng.randint(1, 8))) + ("\n" if k % 3 else "")) for k in range(25)]
    got = {r["doc_id"]: r for r in line_dedup.report(frame(spark, texts)).collect()}
    seen = []
    for k, t in texts:
        for number, line in enumerate(t.split("\n")):
            words = WORDS.findall(line.lower())
            if len(words) >= 5:
                seen.append((k, number, " ".join(words)))
    links = [(a, b) for a, b in itertools.combinations(range(len(seen)), 2) if line_dedup.similar(seen[a][2], seen[b][2], 0.9)]
    dropped = {(seen[k][0], seen[k][1]): seen[root][0] for k, root in enumerate(groups_of(len(seen), links)) if k != root}
    assert {(d, line): kept for d, r in got.items() for line, kept in zip(r["dropped_lines"], r["kept_in"])} == dropped
    assert all(got[k]["n_lines"] == t.count("\n") + 1 for k, t in texts)
    left = {r["doc_id"]: r for r in line_dedup.without_repeated_lines(frame(spark, texts)).collect()}
    for k, t in texts:
        keep = "\n".join(x for number, x in enumerate(t.split("\n")) if (k, number) not in dropped)
        assert (left[k]["text"], left[k]["n_chars"]) == (keep, len(keep)) if keep.strip() else k not in left


def test_line_dedup_finds_what_edit_similarity_alone_finds(spark):
    rng = random.Random(11)
    lines = []
    for n in (3, 8, 12, 20, 20, 40, 100):
        for _ in range(6):
            words = prose(rng, n).split()
            lines.append(" ".join(words))
            other = list(words)
            other[rng.randrange(n)] = "".join(rng.choice("ijkl") for _ in range(3))
            lines.append(" ".join(other))
    texts = list(enumerate(lines))
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if line_dedup.similar(lines[a], lines[b], 0.9)]
    assert len(links) >= 25
    want = {k: root for k, root in enumerate(groups_of(len(lines), links)) if k != root}
    assert {r["doc_id"]: r["kept_doc"] for r in line_dedup.repeated_lines(frame(spark, texts)).collect()} == want


def test_a_chain_of_near_lines_is_not_copied_once_a_block(spark, monkeypatch):
    rng = random.Random(7)
    pool = prose(rng, 1300).split()
    docs = frame(spark, [(k, " ".join(pool[2 * k : 2 * k + 40])) for k in range(600)])
    met = []

    def counted(df, keys, *rest):
        met.append(df.select("node", *keys).toPandas())
        return cluster.grouped(df, keys, *rest)

    monkeypatch.setattr(line_dedup, "grouped", counted)
    want, got = (sorted(tuple(r) for r in line_dedup.repeated_lines(docs, block=block).collect()) for block in (32_768, 16))
    whole, dealt = met
    assert want and got == want
    # all lines are one group, of 38 blocks
    assert whole.groupby(list(whole.columns[1:])).size().tolist() == [whole["node"].nunique()] and whole["node"].nunique() > 550
    assert len(dealt) < 20 * whole["node"].nunique()


def test_line_dedup_drops_copies_of_short_lines_and_of_lines_without_blanks(spark):
    chinese = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\uff0c\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65"
    texts = [(1, f"All rights reserved.\n{chinese}\nthe end"), (2, f"the end\nall rights reserved\n{chinese}"), (3, chinese[:8])]
    got = {(r["doc_id"], r["line"]): r["kept_doc"] for r in line_dedup.repeated_lines(frame(spark, texts)).collect()}
    assert got == {(2, 1): 1, (2, 2): 1}


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(15, 60)).capitalize() + ".") for k in range(12)] + [(50, None), (51, ""), (52, "tiny")]
    texts, want = [], set()
    for k in range(60):
        parts = [prose(rng, 80)]
        if k % 2:
            item_id, passage = rng.choice(items[:12])
            chars = list(passage)
            m = len(" ".join(WORDS.findall(passage.lower())))
            for _ in range(rng.randint(0, decontaminate.budget(m, 12, 0.07)[0] // 2)):
                chars[rng.randrange(2, len(chars) - 2)] = rng.choice("xyz")
            parts += ["".join(chars), prose(rng, 40)]
            want.add((k, item_id))
        texts.append((k, " ".join(parts)))
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (8 << 20, 400):
        found = decontaminate.contaminated(docs, bench, most_bytes=most).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == want
        assert len({tuple(r) for r in found}) == len(found)
    for r in found:
        clean = " ".join(WORDS.findall(dict(texts)[r["doc_id"]][r["start"] : r["end"]].lower()))
        assert abs(len(clean) - len(" ".join(WORDS.findall(dict(items)[r["item_id"]].lower())))) <= r["edits"]
    assert {r["doc_id"] for r in decontaminate.without_contaminated(docs, bench).collect()} == {k for k, _ in texts} - {k for k, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_near_vectors_is_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(60):
        centre = rng.normal(size=8)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), [float(v) for v in np.float32(centre + 0.08 * rng.normal(size=8))], g % 3))
    rows += [(len(rows) + n, list(rows[k][1]), rows[k][2]) for n, k in enumerate((0, 0, 5))]
    odd = [(None, 0), ([], 0), ([0.0] * 8, 0), ([None] + [1.0] * 7, 1), ([float("nan")] + [1.0] * 7, 1), ([float("inf")] + [1.0] * 7, 1), (list(rows[0][1]), None), ([1.0, 2.0], 0)]
    rows += [(len(rows) + k, v, label) for k, (v, label) in enumerate(odd)]
    good = [v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    unit = {k: np.float64(v) / np.linalg.norm(np.float64(v)) for k, v, _ in rows if good[k]}
    links = [(a, b) for a, b in itertools.combinations(sorted(unit), 2) if rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.98]
    want = groups_of(len(rows), links)
    frames = {kind: spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, node string") for kind in ("float", "double")}
    vectors = frames["float"]
    for kind, parameters in (("float", {}), ("double", {}), ("float", {"target": 15, "block": 640}), ("double", {"target": 15, "block": 640}), ("double", {"target": 15, "most_bytes": 640})):
        vectors = frames[kind]
        got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(vectors, **parameters).collect()}
        assert [got[k]["n_links"] for k in range(len(rows))] == [sum(k in link for link in links) for k in range(len(rows))]
        assert [got[k]["component_id"] for k in range(len(rows))] == want
        assert all(got[k]["kept"] == (want[k] == k) for k in got)
    assert embedding_dedup.near_vectors(vectors.limit(0)).count() == 0


def test_lm_base_scores_are_exact_and_the_model_is_better(spark, small):
    docs, _ = small
    docs = docs.unionByName(frame(spark, ODD).select(docs.columns))
    rows = docs.select("doc_id", "text").collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    counts = {}
    for r in rows:
        for w in tokens(r["text"]) if not held(r["doc_id"]) else ():
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    want = sorted((str(r["doc_id"]), held(r["doc_id"]), len(tokens(r["text"])), sum(w in counts for w in tokens(r["text"])), round(sum(np.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in tokens(r["text"])), 4)) for r in rows)
    for most in (1 << 18, 500):
        got = language_model.scored(docs, most_known=most).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
        assert {r["train_tokens"] for r in got} == {total}
        assert sum(r["score"] - r["base_score"] for r in got if r["held_out"]) > 0
    assert language_model.scored(docs.limit(0)).count() == 0
    assert language_model.scored(docs.where(~docs.doc_id.isNull() & (docs.doc_id < 0))).count() == 0


def test_classifiers_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r["doc_id"]: r for r in docs.join(labels, "doc_id", "left").collect()}
    for got, label, least in ((toxicity.scored(docs, labels), "toxic", 0.9), (quality.scored(docs, labels), "quality", 0.97)):
        rows = got.collect()
        assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
        test = [r for r in rows if r["held_out"] and truth[r["doc_id"]][label] is not None]
        assert np.mean([r["predicted"] == truth[r["doc_id"]][label] for r in test]) >= least
    rows = language.predicted(docs).collect()
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in rows if r["held_out"]]) >= 0.97


def test_offending_sentences_are_located(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for k in range(600):
        sentences = [prose(random.Random(99), 0) or prose(rng, 8, 40) for _ in range(5)]
        toxic = k % 4 == 0
        if toxic:
            sentences[rng.randrange(5)] += " é vilename"
        texts.append((k, "ü. " + ". ".join(sentences) + "."))
        labels.append((k, 1, int(toxic)))
    docs = frame(spark, texts)
    got = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for r in got:
        spans = [dict(texts)[r["doc_id"]][s["start"] : s["end"]] for s in r["offending"]]
        assert len(spans) == labels[r["doc_id"]][2] and all("vilename." in s and s.count(".") == 1 for s in spans)
    assert [toxicity.without_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count()] == [450]


def test_odd_rows_and_empty_tables(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 1, 1), (6, 0, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same text twice here now")], "item_id long, text string")
    n = len(ODD)
    for d in (docs, docs.limit(0)):
        m = n if d is docs else 0
        for lab in (labels, labels.limit(0)):
            assert toxicity.scored(d, lab).count() == m
            assert quality.scored(d, lab).count() == m
        assert language.predicted(d).count() == m
        assert pii.personal_data(d).count() == m
        assert pii.redacted(d).columns == d.columns
        assert mixing.mixed(d).count() == m
        assert mixing.sampled(d).columns == d.columns
        assert ngram_join.ngram_groups(d).count() == max(0, m - 1)
        assert ngram_join.deduplicate(d).count() == max(0, m - 1)
        assert line_dedup.report(d).count() == max(0, m - 1)
        assert line_dedup.without_repeated_lines(d).count() == m
        assert decontaminate.contaminated(d, bench).count() == (2 if m else 0)
        assert decontaminate.without_contaminated(d, bench).count() == max(0, m - 2)
        assert toxicity.without_toxic(d, labels).columns == d.columns
    und = {r["doc_id"]: r["lang_pred"] for r in language.predicted(docs).collect()}
    assert all(und[k] == "und" for k in (1, 2, 3, 5)) and und[4] != "und"


def test_personal_data_query(spark):
    texts = [(1, "a@b.example.com at 10.1.2.3"), (2, "joe (at) mail (dot) com"), (3, None)]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, texts)).collect()}
    assert got[1]["spans"] == "email:0:15,ip:19:27" and got[1]["n_email"] == got[1]["n_ip"] == 1
    assert got[2]["spans"] == "email:0:23" and got[2]["n_email"] == 0 and got[2]["n_added"] == 1
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert got[3]["spans"] == "" and got[2]["base_sha256"] == got[3]["base_sha256"] == empty
    assert [r["text"] for r in pii.redacted(frame(spark, texts)).orderBy("doc_id").collect()] == ["<EMAIL> at <IP>", "<EMAIL>", None]


def test_mixing_matches_sql_and_its_distributed_form(spark, small):
    docs, _ = small
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op1_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op1_mixing(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()
    apart = mixing.mixed(docs, most_cells=0).toPandas().set_index("doc_id")["chance"]
    assert np.allclose(apart.loc[got["doc_id"]], mixing.mixed(docs).toPandas().set_index("doc_id")["chance"].loc[got["doc_id"]], atol=1e-6)


def test_pipeline_runs_and_keeps_the_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in pipeline.STAGES:
        docs = cluster.written(stage(spark, docs, SMALL))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < docs.count() <= before
        before = docs.count()
    assert pipeline.run(spark, SMALL).count() == before
