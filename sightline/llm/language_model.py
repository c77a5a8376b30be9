"""A hashed maximum-entropy language model with a class-factored softmax, and the corpus counts beneath it.

P(word | history) = P(class | history) * P(word | class, history). The classes
are bins of the most frequent words by frequency, a class for "the last word
again", and a class for all other words, whose words follow their corpus counts.
The bins after the first ones hold groups of words, and P(word | class, history)
is P(group | class, history) * P(word | group, history) there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import written
from .textkit import BASE, MIX_2, U64, as_long, find_words, hash_spans, text_slices
from .training import in_fold

#: Classes, words (or groups of as many words) in a class, classes of words, rows of a training batch.
CLASSES, WORDS, PLAIN = 32, 32, 16
COPY, TAIL = CLASSES - 2, CLASSES - 1
DEEP = COPY - PLAIN
#: Words that the model can tell apart by context.
MOST_WORDS = PLAIN * WORDS + DEEP * WORDS * WORDS
BATCH = 1 << 15
#: Hashes that stand for the end and the start of a text; no word's bytes give these by rule, only by chance.
END, START = 0x1D8E4E27C47D124F, 0x2545F4914F6CDD1D
PRIOR = 0.1
OUT = np.float32(-1e9)


def _table() -> np.ndarray:
    """Byte to lower-cased byte, 0 for the six blanks that part words; a zero byte is a letter like any other."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[0] = 0xFF
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of an end after each, and where each text's begin."""
    folded = _table()[raw]
    starts, ends = find_words(folded)
    words = hash_spans(folded, starts, ends)
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    begins = first + np.arange(len(first))
    out = np.full(len(words) + len(offsets) - 1, END, dtype=U64)
    out[np.arange(len(words)) + doc] = words
    return out, begins


class Lookup:
    """Positions of known hashes: two direct tables, and a sorted rest for what collides in both."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.shifts = (U64(64 - bits), U64(max(0, 40 - bits)))
        self.mask = U64((1 << bits) - 1)
        self.keys = keys
        self.tables = []
        left = np.arange(len(keys))
        for shift in self.shifts:
            table = np.full(1 << bits, -1, dtype=np.int32)
            slot = ((keys[left] >> shift) & self.mask).astype(np.int64)
            table[slot] = left
            left = left[table[slot] != left]
            self.tables.append(table)
        self.rest = left[np.argsort(keys[left], kind="stable")]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The position of each hash, -1 if unknown."""
        out = np.full(len(x), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        for shift, table in zip(self.shifts, self.tables):
            got = table[((x >> shift) & self.mask).astype(np.int64)]
            hit = (got >= 0) & (self.keys[got] == x)
            out[hit] = got[hit]
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.keys[self.rest], x), len(self.rest) - 1)
            hit = self.keys[self.rest[at]] == x
            out[hit] = self.rest[at[hit]]
        return out


@dataclass(frozen=True)
class Counts:
    """Totals of the training tokens, and the counts of the frequent ones: of all with `least` or more."""

    total: int
    distinct: int
    ends: int
    least: int
    hashes: np.ndarray
    numbers: np.ndarray


@dataclass(frozen=True)
class Model:
    """Weights of the classes, of the words or groups in them, and of the words in groups; the tables are by feature."""

    vocabulary: np.ndarray
    classes: np.ndarray
    words: np.ndarray
    leaves: np.ndarray
    by_class: np.ndarray
    by_word: np.ndarray
    by_leaf: np.ndarray
    again: np.ndarray
    tail_total: float

    @property
    def bits(self) -> int:
        return len(self.by_class).bit_length() - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of a partition, merged in memory up to a bound."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        for _, _, raw, offsets in text_slices(batch.column("text")) if batch.num_rows else ():
            tokens, _ = tokens_of(raw, offsets)
            held.append(np.unique(tokens, return_counts=True))
            if sum(len(k) for k, _ in held) > 2_000_000:
                held[:] = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([as_long(held[0][0]), pa.array(held[0][1])], names=["token", "n"])
                    held.clear()
    if held:
        keys, numbers = merged()
        yield pa.RecordBatch.from_arrays([as_long(keys), pa.array(numbers)], names=["token", "n"])


def count(texts: DataFrame, most_known: int = 1 << 18) -> tuple[Counts, DataFrame]:
    """Counts of all tokens of the texts as a table, and the at most most_known frequent ones of them."""
    table = written(texts.select("text").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    row = table.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum(F.when(F.col("token") == int(np.uint64(END).astype(np.int64)), F.col("n"))).alias("ends")).first()
    # how many tokens have each count; the larger counts are far fewer
    sizes = table.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("m")).toPandas().sort_values("n", ascending=False)
    fits = sizes["n"][sizes["m"].cumsum() <= most_known]
    least = int(fits.min()) if len(fits) else 1 << 62
    known = table.where(F.col("n") >= least).toPandas().sort_values(["n", "token"], ascending=[False, True])
    return Counts(int(row["total"] or 0), int(row["distinct"]), int(row["ends"] or 0), least, known["token"].to_numpy(dtype=np.int64).view(U64), known["n"].to_numpy(dtype=np.int64)), table


def placed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, slot in it and leaf of words of the vocabulary by number; a leaf is -1 in the first classes, all are -1 for number -1."""
    deep = at - PLAIN * WORDS
    plain = deep < 0
    kind = np.where(plain, at // WORDS, PLAIN + deep // WORDS**2)
    slot = np.where(plain, at % WORDS, deep // WORDS % WORDS)
    leaf = np.where(plain, -1, deep % WORDS)
    return tuple(np.where(at < 0, -1, v) for v in (kind, slot, leaf))


def start(counts: Counts, *, least: int = 8, least_bits: int = 13, most_bits: int = 14) -> Model:
    """The unigram model: biases are the logarithms of the counts, all other weights 0.

    The vocabulary holds the words of `least` occurrences or more, MOST_WORDS at
    most; a feature table has a row for about 16 distinct words of the corpus, at
    least 2**least_bits and at most 2**most_bits.
    """
    size = int(min(MOST_WORDS, (counts.numbers >= least).sum()))
    top, number = counts.hashes[:size], counts.numbers[:size].astype(np.float64)
    kind, slot, leaf = placed(np.arange(size))
    mass = np.zeros((CLASSES, WORDS))
    np.add.at(mass, (kind, slot), number)
    inner = np.zeros((DEEP * WORDS, WORDS))
    deep = leaf >= 0
    inner[(kind[deep] - PLAIN) * WORDS + slot[deep], leaf[deep]] = number[deep]
    log = lambda v: np.where(v > 0, np.log(np.maximum(v, 1e-300)), OUT).astype(np.float32)
    rest = counts.total - number.sum()
    total = mass.sum(axis=1)
    total[COPY] = PRIOR + 0.001 * rest
    total[TAIL] = PRIOR + rest
    classes = log(total)
    classes[classes > OUT] -= np.float32(np.log(total.sum()))
    tail_total = rest + PRIOR * (counts.distinct - len(top) + 1)
    rows = 1 << int(np.clip(int(counts.distinct // 16).bit_length(), least_bits, most_bits))
    tables = [np.zeros((rows, n), np.float32) for n in (CLASSES, WORDS, WORDS)]
    return Model(top, classes, log(mass), log(inner), *tables, np.zeros(4, np.float32), float(tail_total))


def _row(bits: int, kind: int, *parts: np.ndarray) -> np.ndarray:
    value = np.full(len(parts[0]), kind * BASE & (1 << 64) - 1, dtype=U64)
    for p in parts:
        value = (value ^ p) * U64(BASE)
        value = value ^ (value >> U64(31))
    return ((value * U64(MIX_2)) >> U64(64 - bits)).astype(np.uint16)


@dataclass(frozen=True)
class Steps:
    """What the model sees and must tell at each position."""

    target: np.ndarray
    slot: np.ndarray
    leaf: np.ndarray
    features: list[np.ndarray]
    word_features: list[np.ndarray]
    leaf_features: list[np.ndarray]
    may_copy: np.ndarray
    same: np.ndarray
    last: tuple[np.ndarray, np.ndarray, np.ndarray]

    @property
    def group(self) -> np.ndarray:
        return (self.target - PLAIN) * WORDS + self.slot


def steps(tokens: np.ndarray, begins: np.ndarray, lookup: Lookup, bits: int) -> Steps:
    """Classes, words in them, and hashed features: last word, the one before it (a skip), both, and whether they are equal."""
    one = np.roll(tokens, 1)
    one[begins[:-1]] = START
    two = np.roll(one, 1)
    two[begins[:-1]] = START
    at = lookup.find(tokens)
    last = np.roll(at, 1)
    last[begins[:-1]] = -1
    fresh = np.zeros(len(tokens), dtype=bool)
    fresh[begins[:-1]] = True
    may_copy = (last < 0) & ~fresh
    same = (one == two) & ~fresh
    copied = may_copy & (tokens == one)
    kind, slot, leaf = placed(at)
    target = np.where(copied, COPY, np.where(at >= 0, kind, TAIL))
    slot, leaf = np.maximum(slot, 0), np.where(copied, -1, leaf)
    before = placed(last)
    features = [_row(bits, 1, one), _row(bits, 2, two), _row(bits, 3, one, two), _row(bits, 4, (same * 64 + before[0] + 1).astype(U64))]
    within = target.astype(U64)
    inside = within * U64(WORDS) + slot.astype(U64)
    return Steps(target, slot, leaf, features, [_row(bits, 5, one, within), _row(bits, 6, two, within)], [_row(bits, 7, one, inside)], may_copy, same, before)


#: Positions whose logits are turned into columns at a time, so that they stay in the processor's cache.
TURNED = 1024


def _slopes(z: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """What each logit is to rise by, the goal's 1 less each one's chance; a line for each column of z."""
    out = np.empty((z.shape[1], len(z)))
    for a in range(0, len(z), TURNED):
        chance = np.ascontiguousarray(z[a : a + TURNED].T)
        chance -= chance.max(axis=0)
        np.exp(chance, out=chance)
        chance /= -chance.sum(axis=0)
        out[:, a : a + TURNED] = chance
    out[goal, np.arange(len(z))] += 1
    return out


def _log_chance(z: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """log10 of the chance of one column of each row, 1e-30 at least."""
    out = np.empty(len(z))
    for a in range(0, len(z), TURNED):
        turned = np.ascontiguousarray(z[a : a + TURNED].T)
        turned -= turned.max(axis=0)
        own = turned[goal[a : a + TURNED], np.arange(turned.shape[1])].astype(np.float64)
        np.exp(turned, out=turned)
        out[a : a + TURNED] = own - np.log(turned.sum(axis=0))
    return np.maximum(out / np.log(10), -30)


def _class_logits(model: Model, s: Steps, part: slice) -> np.ndarray:
    z = model.by_class[s.features[0][part]]
    for f in s.features[1:]:
        z += model.by_class[f[part]]
    z += model.classes
    z[~s.may_copy[part], COPY] = OUT
    return z


def _word_logits(model: Model, s: Steps, at: np.ndarray) -> np.ndarray:
    """Logits of the words or groups of the target class, at positions whose class has some."""
    z = model.words[s.target[at]]
    for f in s.word_features:
        z += model.by_word[f[at]]
    own = _again(s, at, 0)
    z[own, s.last[1][at[own]]] += model.again[s.same[at[own]].astype(np.int64)]
    return z


def _leaf_logits(model: Model, s: Steps, at: np.ndarray) -> np.ndarray:
    """Logits of the words of the target group, at positions whose word is in one."""
    z = model.leaves[s.group[at]]
    for f in s.leaf_features:
        z += model.by_leaf[f[at]]
    own = _again(s, at, 1)
    z[own, s.last[2][at[own]]] += model.again[2 + s.same[at[own]].astype(np.int64)]
    return z


def _again(s: Steps, at: np.ndarray, level: int) -> np.ndarray:
    """Which positions have the last word in their class, or in their group."""
    own = s.last[0][at] == s.target[at]
    if level:
        own &= (s.last[1][at] == s.slot[at]) & (s.last[2][at] >= 0)
    return np.flatnonzero(own)


def _spread(table: np.ndarray, squares: np.ndarray, seen: np.ndarray, rows: np.ndarray, slopes: np.ndarray, rate: float) -> None:
    """An AdaGrad step on the rows that occur; slopes has a line for each column of the table."""
    rows = rows.astype(np.intp)
    number = np.bincount(rows, minlength=len(table))
    found = np.flatnonzero(number)
    seen += number
    push = np.empty((len(found), len(slopes)), dtype=np.float32)
    for c, slope in enumerate(slopes):
        push[:, c] = np.bincount(rows, weights=slope, minlength=len(table))[found]
    grown = squares[found]
    grown += push**2
    squares[found] = grown
    push *= np.float32(rate)
    push /= np.sqrt(grown + np.float32(1e-3))
    table[found] += push


TABLES = ("by_class", "by_word", "by_leaf")


def _train(batches: Iterator[pa.RecordBatch], model: Model, rate: float) -> Iterator[pa.RecordBatch]:
    """Gradient steps over a partition from the shared weights; what each touched row moved."""
    lookup = Lookup(model.vocabulary)
    own = replace(model, **{t: getattr(model, t).copy() for t in (*TABLES, "again")})
    tables = [getattr(own, t) for t in TABLES]
    squares = [np.zeros_like(t) for t in tables]
    rows = len(own.by_class)
    seen = np.zeros((3, rows), dtype=np.int64)
    again = np.zeros(4)
    for batch in batches:
        for _, _, raw, offsets in text_slices(batch.column("text")) if batch.num_rows else ():
            s = steps(*tokens_of(raw, offsets), lookup, own.bits)
            for a in range(0, len(s.target), BATCH):
                part = slice(a, min(a + BATCH, len(s.target)))
                slopes = _slopes(_class_logits(own, s, part), s.target[part])
                for f in s.features:
                    _spread(tables[0], squares[0], seen[0], f[part], slopes, rate)
                inside = a + np.flatnonzero(s.target[part] < COPY)
                for level, at, logits, goal, features in ((0, inside, _word_logits, s.slot, s.word_features), (1, inside[s.leaf[inside] >= 0], _leaf_logits, s.leaf, s.leaf_features)):
                    if len(at):
                        slopes = _slopes(logits(own, s, at), goal[at])
                        mine = _again(s, at, level)
                        push = np.bincount(s.same[at[mine]].astype(np.int64), weights=slopes[s.last[1 + level][at[mine]], mine], minlength=2)
                        both = slice(2 * level, 2 * level + 2)
                        again[both] += push**2
                        own.again[both] += (rate * push / np.sqrt(again[both] + 1e-3)).astype(np.float32)
                        for f in features:
                            _spread(tables[1 + level], squares[1 + level], seen[1 + level], f[at], slopes, rate)
    ids, values, weights = [], [], []
    for k, t in enumerate(TABLES):
        some = np.flatnonzero(seen[k])
        ids.append(some + k * rows)
        values += [r.tobytes() for r in (tables[k][some] - getattr(model, t)[some]).astype(np.float16)]
        weights.append(seen[k][some])
    ids.append(np.array([3 * rows]))
    values.append(np.pad(own.again - model.again, (0, CLASSES - 4)).astype(np.float16).tobytes())
    weights.append(np.array([1]))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(weights)), pa.array(values, type=pa.binary())], names=["row", "weight", "moved"])


def _mean(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Mean move of each row over the partitions that saw it, weighed by the square root of how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros((3 * rows + 1, CLASSES), dtype=np.float32), np.zeros(3 * rows + 1)
        for batch in batches:
            if batch.num_rows:
                at = batch.column("row").to_numpy()
                w = np.sqrt(batch.column("weight").to_numpy().astype(np.float64))
                moved = np.frombuffer(b"".join(batch.column("moved").to_pylist()), dtype=np.float16).reshape(len(at), CLASSES)
                np.add.at(total, at, moved.astype(np.float32) * w[:, None].astype(np.float32))
                np.add.at(weight, at, w)
        some = np.flatnonzero(weight)
        if len(some):
            mean = total[some] / weight[some][:, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([m.astype(np.float16).tobytes() for m in mean], type=pa.binary())], names=["row", "moved"])

    return run


def fit(texts: DataFrame, counts: Counts, *, rounds: int = 2, passes: int = 1, rate: float = 0.1, **sizes) -> Model:
    """Train on all texts, `passes` times: each of a pass's `rounds` is a share of the documents, and each partition a run of gradient steps.

    After a round the partitions' moves are averaged row by row on the executors;
    three tables of rows and one more come to the driver. sizes go to start().
    """
    model = start(counts, **sizes)
    rows = len(model.by_class)
    for r in [*range(rounds)] * passes:
        own = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(rounds)) == r).select("text")

        def train(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            yield from _train(batches, model, rate)

        moves = own.mapInArrow(train, "row long, weight long, moved binary")
        got = moves.repartition("row").mapInArrow(_mean(rows), "row long, moved binary").toPandas()
        step = np.zeros((3 * rows + 1, CLASSES), dtype=np.float32)
        if len(got):
            step[got["row"].to_numpy()] = np.frombuffer(b"".join(bytes(m) for m in got["moved"]), dtype=np.float16).reshape(len(got), CLASSES)
        moved = {t: getattr(model, t) + step[k * rows : (k + 1) * rows] for k, t in enumerate(TABLES)}
        model = replace(model, **moved, again=model.again + step[-1, :4])
    return model


def gains(tokens: np.ndarray, begins: np.ndarray, model: Model, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(class) * P(word | class) at each token, but for the words of the tail their class alone; and where those are."""
    s = steps(tokens, begins, lookup, model.bits)
    out = np.zeros(len(tokens))
    for a in range(0, len(tokens), BATCH):
        part = slice(a, min(a + BATCH, len(tokens)))
        out[part] = _log_chance(_class_logits(model, s, part), s.target[part])
        inside = a + np.flatnonzero(s.target[part] < COPY)
        if len(inside):
            out[inside] += _log_chance(_word_logits(model, s, inside), s.slot[inside])
        deep = inside[s.leaf[inside] >= 0]
        if len(deep):
            out[deep] += _log_chance(_leaf_logits(model, s, deep), s.leaf[deep])
    return out, s.target == TAIL


def _score(batches: Iterator[pa.RecordBatch], model: Model, counts: Counts) -> Iterator[pa.RecordBatch]:
    """One row for each document, and one for each of its distinct words whose count is not at hand."""
    lookup, known = Lookup(model.vocabulary), Lookup(counts.hashes)
    for batch in batches:
        for at, n, raw, offsets in text_slices(batch.column("text")) if batch.num_rows else ():
            tokens, begins = tokens_of(raw, offsets)
            gain, tail = gains(tokens, begins, model, lookup)
            found = known.find(tokens)
            number = np.where(found >= 0, counts.numbers[found] if len(counts.numbers) else 0, 0)
            plain = np.where(found >= 0, np.log10(number + PRIOR), 0.0)
            gain += np.where(tail & (found >= 0), plain, 0.0) - tail * np.log10(max(model.tail_total, PRIOR))
            sums = [np.add.reduceat(v, begins[:-1]) for v in (gain, plain, (found >= 0).astype(np.int64))]
            doc = np.repeat(np.arange(n), np.diff(begins))
            rest = np.flatnonzero(found < 0)
            order = rest[np.lexsort((tokens[rest], doc[rest]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (tokens[order][1:] != tokens[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(order)))
            tails = np.add.reduceat(tail[order].astype(np.int64), begin) if len(begin) else times
            whose = doc[order[begin]]
            keys = batch.column("key").slice(at, n)
            m = len(begin)
            pad = lambda v, kind: pa.concat_arrays([pa.array(v, type=kind), pa.nulls(m, type=kind)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([keys, keys.take(pa.array(whose))]),
                    pa.concat_arrays([pa.nulls(n, type=pa.int64()), as_long(tokens[order[begin]])]),
                    pa.concat_arrays([pa.array(np.diff(begins)), pa.array(times)]),
                    pa.concat_arrays([pa.array(sums[2]), pa.array(tails)]),
                    pad(sums[0], pa.float64()),
                    pad(sums[1], pa.float64()),
                    pa.concat_arrays([batch.column("doc_id").slice(at, n), pa.nulls(m, type=pa.int64())]),
                ],
                names=["key", "token", "times", "some", "gain", "plain", "doc_id"],
            )


def scored(docs: DataFrame, *, rounds: int = 2, passes: int = 1, most_known: int = 1 << 18, **sizes) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Words are maximal runs of characters other than space and the controls 9 to
    13, with A-Z lower-cased; an end follows each text. Training documents are
    those whose crc32(doc_id as text) mod 10 is not 0. base_score is the smoothed
    unigram log10 probability over their counts, score the model's. Counts of the
    frequent words, most_known at most, travel with the tasks; the other words of
    each document are joined with the table of all counts. Words are told apart by
    64-bit hashes.

    The model trains on every training document `passes` times. Up to MOST_WORDS
    (14 848) words of `least` occurrences are told by context, over feature tables
    of 2**least_bits to 2**most_bits rows by the number of distinct words; all other
    words share a class and follow their counts within it.

    A null text is empty; rows that repeat a doc_id and its text get equal rows;
    without training documents both scores follow the prior alone; an empty table
    gives no rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"))
    training = texts.where(~in_fold("doc_id", 10))
    counts, table = count(training, most_known)
    model = fit(training, counts, rounds=rounds, passes=passes, **sizes)
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score(batches, model, counts)

    made = written(keyed.mapInArrow(run, "key long, token long, times long, some long, gain double, plain double, doc_id long"))
    whole = made.where("token IS NULL").select("key", "doc_id", F.col("times").alias("n_tokens"), F.col("some").alias("n_known"), "gain", "plain")
    rare = made.where("token IS NOT NULL").select("key", "token", F.col("times").cast("int").alias("times"), F.col("some").cast("int").alias("tails"))
    counted = rare.join(table.where(F.col("n") < counts.least), "token", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(PRIOR))
    rest = counted.groupBy("key").agg(F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("known"), F.sum(log * F.col("times")).alias("plain_rest"), F.sum(log * F.col("tails")).alias("gain_rest"))
    copies = whole.groupBy("key").agg(F.count("*").alias("rows"), F.any_value("doc_id").alias("doc_id"), *[F.any_value(c).alias(c) for c in ("n_tokens", "n_known", "gain", "plain")])
    out = copies.join(rest, "key", "left")
    # rows that repeat sent their words as many times
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("rows")
    floor = float(np.log10(counts.total + PRIOR * (counts.distinct + 1)))
    out = out.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return out.select(
        "doc_id",
        in_fold("doc_id", 10).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + share("known").cast("long")).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("plain") + share("plain_rest") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("gain") + share("gain_rest")).alias("score"),
    )
