"""The kernels against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from sightline.llm import cluster, decontaminate, edits, language_model, line_dedup, mixing, ngram_join, pii, quality, textkit

WORDS = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def one_slice(texts):
    (found,) = list(textkit.text_slices(pa.array(texts, type=pa.string())))
    return found[2], found[3]


def test_words_are_found_and_hashed_alike_wherever_they_stand():
    raw, offsets = one_slice(["The cat, the CAT", None, "", "Élan élan!", "cat"])
    _, starts, ends, hashes, first = textkit.words_of(raw, offsets, textkit.word_table())
    assert np.diff(first).tolist() == [4, 0, 0, 2, 1]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] == hashes[6] and hashes[4] == hashes[5]
    assert len(set(hashes.tolist())) == 3


def test_slices_cover_all_rows_and_long_texts():
    texts = ["x" * random.Random(k).randint(0, 5000) for k in range(500)]
    got = [(at + k, bytes(raw[o[k] : o[k + 1] - 1])) for at, n, raw, o in textkit.text_slices(pa.array(texts), 4096, 7) for k in range(n)]
    assert got == [(k, t.encode()) for k, t in enumerate(texts)]


def test_shingles_of_short_and_long_texts():
    raw, offsets = one_slice(["a b c d e f", "a b", "", "a b c d e"])
    *_, words, first = textkit.words_of(raw, offsets, textkit.word_table())
    shingles, begins = textkit.shingles_of(words, first, 5)
    assert np.diff(begins).tolist() == [2, 1, 0, 1]
    assert shingles[0] == shingles[3] and len(set(shingles.tolist())) == 3


def test_lm_tokens_split_on_the_six_blanks_only():
    texts = ["A b c\x1cd\te\x0bf", "\x00 x", ""]
    raw, offsets = one_slice(texts)
    tokens, begins = language_model.tokens_of(raw, offsets)
    expected = [re.findall(r"[^\x20\x09-\x0d]+", t) for t in texts]
    assert np.diff(begins).tolist() == [len(w) + 1 for w in expected]
    lower, o = one_slice(["a b c\x1cd\te\x0bf"])
    assert language_model.tokens_of(lower, o)[0].tolist() == tokens[: begins[1]].tolist()


def test_lookup_finds_every_key_and_no_other():
    keys = textkit.mix64(np.arange(1, 5000, dtype=np.uint64))
    other = textkit.mix64(np.arange(10_000, 20_000, dtype=np.uint64))
    lookup = language_model.Lookup(keys)
    assert (lookup.find(keys) == np.arange(len(keys))).all()
    assert (lookup.find(other) == -1).all()
    assert language_model.Lookup(keys[:0]).find(other[:3]).tolist() == [-1, -1, -1]


def small_model(seed=5, words=3000):
    rng = np.random.default_rng(seed)
    keys = textkit.mix64(np.arange(1, words + 1, dtype=np.uint64))
    numbers = np.sort(rng.integers(8, 900, words))[::-1].copy()
    model = language_model.start(language_model.Counts(int(numbers.sum()) + 5000, words + 900, 40, 2, keys, numbers))
    noise = {t: rng.normal(size=getattr(model, t).shape).astype(np.float32) for t in (*language_model.TABLES, "again")}
    return keys, language_model.replace(model, **noise), rng


def test_model_chances_sum_to_one():
    """Over all words of the vocabulary, the tail, and the last word again where it is in the tail."""
    keys, model, _ = small_model()
    lookup, odd = language_model.Lookup(model.vocabulary), textkit.mix64(np.arange(10**6, 10**6 + 2, dtype=np.uint64))
    for history in (keys[[5, 7]], keys[[700, 700]], np.array([keys[3], odd[0]])):
        following = np.concatenate([keys, odd])
        tokens = np.concatenate([np.append(history, w) for w in following])
        gain, tail = language_model.gains(tokens, np.arange(0, len(tokens) + 1, 3), model, lookup)
        chance = 10 ** gain[2::3]
        assert tail[2::3].tolist() == [False] * len(keys) + [history[1] != odd[0], True]
        assert abs(chance[: len(keys)].sum() + chance[-2:].sum() / (1 if history[1] == odd[0] else 2) - 1) < 1e-4


def test_gains_are_softmaxes_by_hand():
    keys, model, rng = small_model(7)
    lookup, bits = language_model.Lookup(model.vocabulary), model.bits
    soft = lambda z: np.exp(z.astype(np.float64) - z.max()) / np.exp(z.astype(np.float64) - z.max()).sum()
    row = lambda kind, *parts: int(language_model._row(bits, kind, *[np.array([p], dtype=np.uint64) for p in parts])[0])
    numbers = [*rng.integers(0, 3000, 60).tolist(), 600, 600, 600, 4, 4]
    tokens = keys[numbers]
    got, _ = language_model.gains(tokens, np.array([0, len(tokens)]), model, lookup)
    place = lambda n: tuple(int(v[0]) for v in language_model.placed(np.array([n])))
    for k in range(2, len(tokens)):
        one, two, same = tokens[k - 1], tokens[k - 2], int(tokens[k - 1] == tokens[k - 2])
        kind, slot, leaf = place(numbers[k])
        last = place(numbers[k - 1])
        z = model.classes + model.by_class[row(1, one)] + model.by_class[row(2, two)] + model.by_class[row(3, one, two)] + model.by_class[row(4, same * 64 + last[0] + 1)]
        z[language_model.COPY] = language_model.OUT
        want = soft(z)[kind]
        z = model.words[kind] + model.by_word[row(5, one, kind)] + model.by_word[row(6, two, kind)]
        if last[0] == kind:
            z[last[1]] += model.again[same]
        want *= soft(z)[slot]
        if leaf >= 0:
            z = model.leaves[(kind - language_model.PLAIN) * 32 + slot] + model.by_leaf[row(7, one, kind * 32 + slot)]
            if last[:2] == (kind, slot) and last[2] >= 0:
                z[last[2]] += model.again[2 + same]
            want *= soft(z)[leaf]
        assert abs(got[k] - np.log10(max(want, 1e-300))) < 1e-3, k


def test_slopes_and_chances_are_softmaxes_by_columns():
    rng = np.random.default_rng(6)
    z = (4 * rng.normal(size=(2 * language_model.TURNED + 5, 32))).astype(np.float32)
    goal = rng.integers(0, 32, len(z))
    chance = np.exp(z.astype(float)) / np.exp(z.astype(float)).sum(axis=1, keepdims=True)
    slopes = language_model._slopes(z.copy(), goal)
    assert slopes.flags["C_CONTIGUOUS"] and slopes.dtype == np.float64
    assert np.allclose(slopes.T, np.eye(32)[goal] - chance, atol=1e-6)
    assert np.allclose(language_model._log_chance(z.copy(), goal), np.log10(chance[np.arange(len(z)), goal]), atol=1e-5)


def test_training_learns_what_follows_what():
    """A text of pairs: after training the second word of a pair is all but certain, in plain and in deep classes."""
    rng = random.Random(3)
    first, second = [f"a{k}" for k in range(700)], [f"b{k}" for k in range(700)]
    texts = [" ".join(w for k in rng.choices(range(700), k=400) for w in (first[k], second[k])) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    counted = [b.to_pydict() for b in language_model._count(iter([batch]))]
    tokens = np.array([t for b in counted for t in b["token"]], dtype=np.int64).view(np.uint64)
    numbers = np.array([n for b in counted for n in b["n"]])
    order = np.argsort(-numbers, kind="stable")
    model = language_model.start(language_model.Counts(int(numbers.sum()), len(tokens), 60, 1, tokens[order], numbers[order]))
    lookup = language_model.Lookup(model.vocabulary)
    (raw, offsets), moved = one_slice(texts[:3]), model
    for _ in range(6):
        made = pa.Table.from_batches(list(language_model._train(iter([batch]), moved, 0.3)))
        rows = len(model.by_class)
        step = np.zeros((3 * rows + 1, 32), dtype=np.float32)
        step[made["row"].to_numpy()] = np.frombuffer(b"".join(made["moved"].to_pylist()), dtype=np.float16).reshape(-1, 32)
        moved = language_model.replace(moved, **{t: getattr(moved, t) + step[k * rows : (k + 1) * rows] for k, t in enumerate(language_model.TABLES)}, again=moved.again + step[-1, :4])
    words, begins = language_model.tokens_of(raw, offsets)
    before, after = (language_model.gains(words, begins, m, lookup)[0][1:800:2].mean() for m in (model, moved))
    assert before < -2.5 and after > -1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edits_within_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(800):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 11))) for _ in "ab")
        k = rng.randint(0, 6)
        assert edits.edits_within(a, b, k) == (edit_distance(a, b) <= k), (a, b, k)


def best_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_banded_alignment_is_the_best_inside():
    rng = random.Random(4)
    for _ in range(500):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        k = rng.randint(0, 4)
        got = decontaminate.aligned(*(np.frombuffer(x.encode(), dtype=np.uint8) for x in (p, t)), k, max(0, len(t) - len(p) + k))
        best = best_inside(p, t)
        assert (got[0] if got else None) == (best if best <= k else None)
        if got:
            assert edit_distance(p, t[got[1] : got[2]]) == got[0]


def test_edit_budget_keeps_a_gram_in_common():
    for m in range(12, 400):
        k, t = decontaminate.budget(m, 12, 0.07)
        assert t >= 1 and k <= 0.07 * m and t == m + 1 - 12 * (k + 1)


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99):
        bands, rows = ngram_join.choose_bands(0.8, recall, 160)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 160


def test_many_edit_distances_at_once():
    rng = random.Random(5)
    for n in (3, 10, 40, 90, 300):
        for letters in ("ab", "abcdefgh", "\u0430\u0431\u0432\u0433\U0001d400x"):
            pairs, most = [], []
            for _ in range(40):
                a = [rng.choice(letters) for _ in range(max(1, n + rng.randint(-3, 3)))]
                b = list(a)
                for _ in range(rng.randint(0, max(1, n // 5))):
                    at = rng.randrange(len(b) + 1)
                    b[at : at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
                pairs.append(("".join(a), "".join(b)))
                most.append(rng.randint(0, max(1, n // 6)))
            want = [edit_distance(a, b) <= k for (a, b), k in zip(pairs, most)]
            assert edits.many_within(pairs, np.array(most)).tolist() == want
            assert [edits.edits_within(a, b, k) for (a, b), k in zip(pairs, most)] == want


def test_lines_are_words_with_places():
    texts = ["The  cat,\n\nthe CAT!\nx", None, "", "the cat\n \u00c9lan", "\u4eca\u5929\u5929"]
    raw, offsets = one_slice(texts)
    lines = line_dedup.Lines(raw, offsets, 5, 3)
    assert [lines.text(k).decode() for k in range(len(lines))] == ["the cat", "the cat", "the cat", "\u00e9lan", "\u4eca\u5929\u5929"]
    assert lines.owner.tolist() == [0, 0, 3, 3, 4] and lines.number.tolist() == [0, 2, 0, 1, 0] and lines.length.tolist() == [7, 7, 7, 4, 3]
    assert len(set(lines.content[:3].tolist())) == 1 and len(set(lines.content.tolist())) == 3
    assert not len(line_dedup.Lines(*one_slice(["", None]), 5, 9))


def test_forest_and_roots_agree():
    rng = np.random.default_rng(8)
    left, right = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    forest = cluster.Forest(60)
    for a, b in zip(left, right):
        forest.join(int(a), int(b))
    assert cluster.smallest_roots(60, left, right).tolist() == [forest.root(k) for k in range(60)]


def test_trees_flat_traversal_learns_a_rule():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    model = quality.grow(x[:2000], y[:2000], trees=40)
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert quality.grow(x[:0], y[:0]).predict(x[:3]).tolist() == [0.5] * 3
    assert len(set(quality.grow(x[:100], np.ones(100)).predict(x[:3]).tolist())) == 1


def test_raking_meets_its_margins_and_budget():
    import pandas as pd

    rng = np.random.default_rng(10)
    cells = pd.DataFrame([(s, l, t, float(rng.integers(1, 1000))) for s in "abc" for l in "xy" for t in "pq"], columns=["source", "lang", "topic", "tokens"])
    wanted = {m: mixing.targets(cells, m, 0.5) for m in mixing.MARGINS}
    fitted = mixing.rake(cells, wanted, 50)
    for m in mixing.MARGINS:
        assert np.allclose(pd.Series(fitted).groupby(cells[m]).sum(), wanted[m])
    p = mixing.chances(cells["tokens"].to_numpy(), fitted, 0.6 * cells["tokens"].sum())
    assert p.max() <= 1 and abs((p * cells["tokens"]).sum() - 0.6 * cells["tokens"].sum()) < 1e-6


def plain(text):
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(text)]


def disguised(text):
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.added(text, pii.find(text))]


def test_plain_identifiers():
    assert plain("mail a.b@x-y.example.com, ip 10.0.0.255 or 1.2.3.256") == [("email", "a.b@x-y.example.com"), ("ip", "10.0.0.255")]
    assert plain("card 4111 1111-1111 1111 not 4111 1111 1111 1112") == [("card", "4111 1111-1111 1111")]
    assert plain("call +1 (017) 555-7713 or +12") == [("phone", "+1 (017) 555-7713")]


def test_disguised_identifiers_map_back():
    assert disguised("x john (at) example [dot] com y") == [("email", "john (at) example [dot] com")]
    assert disguised("jane at mail dot example dot org.") == [("email", "jane at mail dot example dot org")]
    assert disguised("jоhn@exаmple.com") == [("email", "jоhn@exаmple.com")]
    assert disguised("plus one five five five two three four five six seven eight") == [("phone", "plus one five five five two three four five six seven eight")]
    assert disguised("ip 192[.]168[.]1[.]20") == [("ip", "192[.]168[.]1[.]20")]
    assert disguised("4lll llll 1111 1111") == [("card", "4lll llll 1111 1111")]
    assert disguised("tel ＋４９ １５１ ２３４５ ６７８９") == [("phone", "＋４９ １５１ ２３４５ ６７８９")]
    assert disguised("look at that. dot the i, one two three") == []


def test_rewriting_keeps_offsets():
    r = pii.Rewritten("abcdef")
    r.replace([(1, 3, "X"), (5, 6, "")])
    assert (r.text, list(r.starts), list(r.ends)) == ("aXde", [0, 1, 3, 4], [1, 3, 4, 5])
    r.replace([(0, 2, "uv")])
    assert r.source(0, 2) == (0, 3)
