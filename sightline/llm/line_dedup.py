"""Fuzzy line deduplication: shared character n-grams, SimHash, edit similarity, one occurrence a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Bloom, Recent, by_block, components, grouped, smallest_roots, written
from .edits import edits_within, many_within
from .textkit import BASE, MIX_1, MIX_2, U64, as_long, fold, mix64, ragged, sums_by_text, text_slices, word_table

#: n-gram keys a line has, and bytes of the n-grams of lines from so many characters on.
KEYS = 8
GRAMS = ((0, 5), (20, 8), (64, 14))
#: Bytes of the n-grams in a SimHash, and about how many of a long line's are counted.
SIM_BYTES, SIM_GRAMS = 5, 64
#: Lines that share a key before they are dealt into blocks.
LINES_A_KEY = 8192
#: A line counts once for every so many bytes against the size of a block.
BYTES_A_LINE = 1024
#: Bytes of text hashed at a time, so that their numbers stay in the processor's cache.
SLICE = 1 << 19
#: Lines and their bytes that are verified together.
LINES_AT_ONCE, BYTES_AT_ONCE = 1 << 15, 32 << 20
#: Pairs in a round of verification.
PAIRS_AT_ONCE = 1 << 16
LAST = ~U64(0)
#: For each byte its bits in the lanes of one integer.
LANES = np.array([sum((v >> k & 1) << 8 * k for k in range(8)) for v in range(256)], dtype=U64)


def simhash(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each run of words the bits that more than half of its hashes have.

    Eight bits at a time are counted in the 8-bit lanes of one integer; runs too
    long for that are counted bit by bit.
    """
    size = np.diff(begin)
    out = np.zeros(len(size), dtype=U64)
    if not len(size):
        return out
    octets = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    for part in range(8):
        votes = np.add.reduceat(LANES[octets[:, part]], begin[:-1]).view(np.uint8).reshape(-1, 8)
        more = np.packbits(2 * votes.astype(np.int64) > size[:, None], axis=1, bitorder="little")[:, 0]
        out |= more.astype(U64) << U64(8 * part)
    for run in np.flatnonzero(size > 0xFF):
        own = words[begin[run] : begin[run + 1]]
        out[run] = sum(int(2 * int(((own >> U64(k)) & U64(1)).sum()) > size[run]) << k for k in range(64))
    return out


class Lines:
    """The lines of a slice of texts, as words with one zero byte after each.

    packed holds them end to end; line k is packed[begin[k] : begin[k] + size[k]],
    with one more zero byte behind it. length is in characters, owner the text,
    number the line's number in it, and content a hash of its bytes.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, least: int, chars: int) -> None:
        folded = fold(raw, word_table())
        kept = folded != 0
        kept[1:] |= kept[:-1].copy()
        breaks = np.flatnonzero(raw == 10)
        packed = folded[kept]
        ends = np.cumsum(np.add.reduceat(kept.view(np.uint8), np.concatenate([[0], breaks[:-1] + 1]), dtype=np.int64))
        begin = np.concatenate([[0], ends[:-1]])
        some = np.flatnonzero(ends > begin)
        begin, size = begin[some], ends[some] - begin[some] - 1
        length = size.copy()
        if len(packed) and packed.max() >= 0x80:
            length -= np.add.reduceat(((packed & 0xC0) == 0x80).view(np.uint8), begin, dtype=np.int64)
        wanted = length >= chars
        if least < (chars + 1) // 2 and len(packed):  # else fewer characters cannot hold so many words
            wanted |= np.add.reduceat((packed == 0).view(np.uint8), begin, dtype=np.int64) >= least
        if not wanted.all():
            packed = packed[np.repeat(wanted, size + 1)]
            some, size, length = some[wanted], size[wanted], length[wanted]
            begin = np.cumsum(size + 1) - size - 1
        after = np.searchsorted(breaks, offsets[1:] - 1) + 1
        self.owner = np.searchsorted(after, some, side="right")
        self.number = some - np.concatenate([[0], after[:-1]])[self.owner]
        self.packed, self.begin, self.size, self.length = packed, begin, size, length
        self.eights = _eights(packed)
        self.content = self._content()

    def __len__(self) -> int:
        return len(self.begin)

    def _content(self) -> np.ndarray:
        """Of eight bytes after eight bytes of each line; what follows the line is masked."""
        pieces = (self.size + 7) >> 3
        first = np.concatenate([[0], np.cumsum(pieces)])
        place = np.arange(first[-1]) - np.repeat(first[:-1], pieces)
        value = self.eights[np.repeat(self.begin, pieces) + 8 * place]
        left = self.size - 8 * (pieces - 1)
        value[first[1:] - 1] &= LAST >> (U64(64) - U64(8) * left.astype(U64))
        place = place.astype(U64)
        return mix64(sums_by_text(mix64(value ^ (place * U64(MIX_1) + U64(MIX_1))), first) + self.size.astype(U64))

    def only(self, some: np.ndarray) -> Lines:
        """Some of the lines, in order."""
        out = object.__new__(Lines)
        pick = np.zeros(len(self), dtype=bool)
        pick[some] = True
        out.packed = self.packed if pick.all() else self.packed[np.repeat(pick, self.size + 1)]
        out.size, out.length, out.owner, out.number, out.content = (x[some] for x in (self.size, self.length, self.owner, self.number, self.content))
        out.begin = np.cumsum(out.size + 1) - out.size - 1
        out.eights = _eights(out.packed)
        return out

    def text(self, k: int) -> bytes:
        return self.packed[self.begin[k] : self.begin[k] + self.size[k]].tobytes().replace(b"\0", b" ")

    def grams(self, size: int) -> np.ndarray:
        """A hash of the `size` bytes, 16 at most, at each place of a line; LAST where the line ends before.

        A shorter line has one, of its content, at its first place.
        """
        n = len(self.packed)
        if size < 8:
            value = (self.eights[:n] & U64((1 << 8 * size) - 1)) * U64(BASE)
        else:
            value = self.eights[:n] * U64(BASE)
            if size > 8:
                value ^= value >> U64(31)
                value += self.eights[size - 8 : size - 8 + n]
                value *= U64(MIX_2)
        value ^= value >> U64(29)
        value *= U64(MIX_1)
        value ^= value >> U64(32)
        end = self.begin + self.size
        for back in range(size):
            value[np.maximum(end - back, self.begin)] = LAST
        short = self.size < size
        value[self.begin[short]] = self.content[short]
        return value

    def lowest(self, hashes: np.ndarray, about: int) -> tuple[np.ndarray, np.ndarray]:
        """Among the hashes of each line about the `about` lowest, one at least: (hashes, where each line's begin).

        Like lines choose alike.
        """
        if not len(self):
            return np.zeros(0, dtype=U64), np.zeros(1, dtype=np.int64)
        share = np.minimum(about / np.maximum(self.size, 1), 1.0) * float((1 << 32) - 1)
        most = np.maximum(share.astype(U64) << U64(32), np.minimum.reduceat(hashes, self.begin))
        most[self.size <= about] = LAST - U64(1)
        picked = hashes <= np.repeat(most, self.size + 1)
        count = np.add.reduceat(picked.view(np.uint8), self.begin, dtype=np.int64)
        return hashes[picked], np.concatenate([[0], np.cumsum(count)])

    def sims(self) -> tuple[np.ndarray, np.ndarray]:
        """Two SimHashes of each line's n-grams."""
        hashes, begin = self.lowest(self.grams(SIM_BYTES), SIM_GRAMS)
        return simhash(mix64(hashes ^ U64(MIX_1)), begin), simhash(mix64(hashes ^ U64(MIX_2)), begin)

    def keys(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """For each line the KEYS lowest hashes of its n-grams: (keys, where each line's begin).

        A line that may be like one of a lower length class has keys of that class too.
        """
        edges = np.array([edge for edge, _ in GRAMS])
        own = np.searchsorted(edges, self.length, side="right") - 1
        low = np.searchsorted(edges, np.ceil(least * self.length - 1e-9), side="right") - 1
        owners, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=U64)]
        for k, (_, size) in enumerate(GRAMS):
            some = np.flatnonzero((low <= k) & (k <= own))
            if not len(some):
                continue
            part = self.only(some)
            hashes, begin = part.lowest(part.grams(size), 2 * KEYS)
            owner = np.repeat(np.arange(len(some)), np.diff(begin))
            # owner above the hash's first bits; what those bits cannot tell apart is not told apart in order
            order = np.argsort((owner.astype(U64) << U64(40)) | (hashes >> U64(24)), kind="stable")
            key, owner = hashes[order], owner[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, owner = key[new], owner[new]
            first = np.arange(len(key)) - np.searchsorted(owner, owner) < KEYS
            owners.append(some[owner[first]])
            keys.append(mix64(key[first] + U64(k)))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        begins = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(self)))])
        return np.concatenate(keys)[order], begins


def _eights(packed: np.ndarray) -> np.ndarray:
    """Eight successive bytes at each place as one integer; zeros follow the end, for as many places as grams() looks ahead."""
    padded = np.concatenate([packed, np.zeros(16, dtype=np.uint8)])
    return np.ascontiguousarray(np.ndarray((len(packed) + 9,), "<u8", padded, strides=(1,)))


#: Bits of a mark's last part that tell the length, by steps of a hundredth.
LENGTH_BITS, LENGTH_STEP = 12, 1.01


def _length_code(length: np.ndarray) -> np.ndarray:
    return np.minimum(np.log(length) / np.log(LENGTH_STEP), (1 << LENGTH_BITS) - 1).astype(U64)


def _keyed_lines(least: int, chars: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(at, node, sim, mark) for each key of each line that the task has not given lately; mark is the other sim with the length's code in its last bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for _, _, raw, offsets in text_slices(batch.column("text"), SLICE) if batch.num_rows else ():
                lines = Lines(raw, offsets, least, chars)
                own = lines.only(recent.fresh(lines.content))
                more, sims = own.sims()
                mark = (more >> U64(LENGTH_BITS) << U64(LENGTH_BITS)) | _length_code(own.length)
                keys, begins = own.keys(similarity)
                times = np.diff(begins)
                yield pa.RecordBatch.from_arrays([as_long(keys), *(as_long(np.repeat(x, times)) for x in (own.content, sims, mark))], names=["at", "node", "sim", "mark"])

    return run


def _placed_lines(least: int, chars: int, similarity: float, wanted: Bloom) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every line's place and content; the words, with single blanks between, and what else verification needs where the line may be wanted and the task has not given it lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for at, _, raw, offsets in text_slices(batch.column("text"), SLICE) if batch.num_rows else ():
                lines = Lines(raw, offsets, least, chars)
                picked = np.flatnonzero(wanted.has(lines.content))
                picked = picked[recent.fresh(lines.content[picked])]
                own = lines.only(picked)
                more, sims = own.sims()
                keys, begins = own.keys(similarity)
                take = pa.array(lines.owner + at)
                place = np.zeros(len(lines), dtype=np.int64)
                place[picked] = np.arange(len(picked))
                absent = np.ones(len(lines), dtype=bool)
                absent[picked] = False
                where = pa.array(place, mask=absent)
                held = [as_long(sims), as_long(more), pa.array(own.length.astype(np.int32)), ragged(keys.view(np.int64), begins, pa.int64()), pa.array([own.text(k) for k in range(len(own))], type=pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("row_key").take(take), pa.array(lines.number.astype(np.int32)), as_long(lines.content), *(x.take(where) for x in held)],
                    names=["doc_id", "row_key", "line", "node", "sim", "more", "length", "keys", "words"],
                )

    return run


PLACED = "doc_id long, row_key long, line int, node long, sim long, more long, length int, keys array<long>, words binary"


def most_bits(similarity: float, distance: int) -> int:
    """Bits of 128 in which SimHashes differ where edits come in pairs, and `distance` more for each of the two."""
    shared = max(0.0, 1 - SIM_BYTES * (1 - similarity) / 2)
    return min(128, int(128 * np.arccos(shared) / np.pi) + 2 * distance)


def _near(key: np.ndarray, sim: np.ndarray, mark: np.ndarray, bits: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers of equal key whose lengths and sims allow the similarity, rows sorted by key and length."""
    left, right = [], []
    code = (mark & U64((1 << LENGTH_BITS) - 1)).astype(np.int64)
    most = int(np.ceil(-np.log(least) / np.log(LENGTH_STEP))) + 1
    mark = mark >> U64(LENGTH_BITS)
    at = np.arange(len(key))
    lag = 1
    while len(at):
        at = at[at + lag < len(key)]
        at = at[(key[at] == key[at + lag]) & (code[at + lag] - code[at] <= most)]
        hit = at[np.bitwise_count(sim[at] ^ sim[at + lag]) + np.bitwise_count(mark[at] ^ mark[at + lag]) <= bits]
        left.append(hit)
        right.append(hit + lag)
        lag += 1
    return np.concatenate([np.zeros(0, dtype=np.int64), *left]), np.concatenate([np.zeros(0, dtype=np.int64), *right])


#: Links as (at, a, b), with nulls after them, or rows to be dealt by their blocks as (at, node, sim, mark, lo, hi).
MET = ["at", "a", "b", "mark", "lo", "hi"]


def _key_links(batches: Iterator[pa.RecordBatch], bits: int, least: float) -> Iterator[pa.RecordBatch]:
    """(at, a, b): a forest of the near lines of each key, from rows sorted by (at, lo, hi, length); a run goes on into the next batch.

    Near lines of a key, in a block of it, have one b; at tells keys and blocks apart.
    Rows of keys of several blocks, where `blocks` tells them, are passed on as they are.
    """
    rest = np.zeros((4, 0), dtype=np.int64)
    for batch in _then_none(batches):
        if batch is not None and "blocks" in batch.schema.names:
            many = batch.column("blocks").to_numpy() > 1
            if many.any():
                hot = batch.filter(pa.array(many))
                yield pa.RecordBatch.from_arrays([hot.column(c) for c in ("at", "node", "sim", "mark", "lo", "hi")], names=MET)
                batch = batch.filter(pa.array(~many))
                if not batch.num_rows:
                    continue
        if batch is not None:
            at = batch.column("at").to_numpy() ^ (batch.column("lo").to_numpy().astype(np.int64) << 32) ^ batch.column("hi").to_numpy()
            rest = np.concatenate([rest, np.stack([at, *(batch.column(c).to_numpy() for c in ("node", "sim", "mark"))])], axis=1)
            stop = int(np.flatnonzero(rest[0] == rest[0, -1])[0]) if rest.shape[1] else 0
        else:
            stop = rest.shape[1]
        key, node, sim, mark = np.ascontiguousarray(rest[:, :stop])
        rest = rest[:, stop:]
        left, right = _near(key, sim.view(U64), mark.view(U64), bits, least)
        unlike = node[left] != node[right]
        left, right = left[unlike], right[unlike]
        if len(left):
            root = smallest_roots(len(key), left, right)
            some = np.flatnonzero(root != np.arange(len(key)))
            links = np.unique(np.stack([key[some], node[some], node[root[some]]], axis=1), axis=0)
            links = links[links[:, 1] != links[:, 2]]
            if len(links):
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in links.T), pa.nulls(len(links), pa.int64()), pa.nulls(len(links), pa.int32()), pa.nulls(len(links), pa.int32())], names=MET)


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def similar(a: str, b: str, least: float) -> bool:
    """Whether 1 - edits / longer length is `least` or more."""
    return edits_within(a, b, int((1 - least) * max(len(a), len(b)) + 1e-9))


def _bags(texts: list[bytes]) -> np.ndarray:
    """Counts of each text's pairs of successive bytes, in 256 bins."""
    out = np.zeros((len(texts), 256), dtype=np.uint16)
    for k, text in enumerate(texts):
        c = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
        pairs = ((c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)
        out[k] = np.minimum(np.bincount(pairs, minlength=256), 0xFFFF)
    return out


class Block:
    """Groups of lines, sorted by group and length, in which similar lines are sought."""

    def __init__(self, group: np.ndarray, tables: list[pa.Table], bits: int, least: float) -> None:
        table = pa.concat_tables(tables).combine_chunks()
        length = table.column("length").to_numpy()
        order = np.lexsort((length, group))
        column = lambda c: table.column(c).to_numpy()[order]
        self.group, self.length = group[order], length[order].astype(np.int64)
        self.node, self.part, self.halves = column("node"), column("part"), column("lo") != column("hi")
        self.sim, self.more = column("sim").view(U64), column("more").view(U64)
        words = table.column("words").combine_chunks().take(pa.array(order))
        raw = words.to_pylist()
        self.wide = np.array([len(x) != n for x, n in zip(raw, self.length.tolist())])
        self.bags = _bags(raw)
        self.texts = [x.decode("utf-8", "replace") for x in raw]
        keys = table.column("keys").combine_chunks().take(pa.array(order))
        self.first, flat = keys.offsets.to_numpy().astype(np.int64), keys.values.to_numpy()
        self.keys = flat
        self.bits, self.least = bits, least
        self.label = np.arange(len(order))

    def _share_key(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows i[k] and j[k] have a key in common."""
        size = np.diff(self.first)
        out = np.zeros(len(i), dtype=bool)
        for a in range(int(size[i].max()) if len(i) else 0):
            some = np.flatnonzero(~out & (a < size[i]))
            key = self.keys[self.first[i[some]] + a]
            for b in range(int(size[j[some]].max()) if len(some) else 0):
                other = b < size[j[some]]
                out[some[other]] |= key[other] == self.keys[self.first[j[some[other]]] + b]
        return out

    def _most(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return ((1 - self.least) * np.maximum(self.length[i], self.length[j]) + 1e-9).astype(np.int64)

    def _test(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the similar ones of the pairs; the likeliest first, and what they connect is not compared."""
        i, j = i[fresh := self.label[i] != self.label[j]], j[fresh]
        some = self._share_key(i, j)
        i, j = i[some], j[some]
        if not len(i):
            return
        most = self._most(i, j)
        moved = np.zeros(len(i), dtype=np.int64)
        for a in range(0, len(i), 8192):
            part = slice(a, a + 8192)
            moved[part] = np.abs(self.bags[i[part]].astype(np.int32) - self.bags[j[part]].astype(np.int32)).sum(axis=1)
        # an edit changes one character, of up to four bytes, and so up to five pairs of bytes on either side
        some = moved <= np.where(self.wide[i] | self.wide[j], 10, 4) * most
        i, j, most = i[some], j[some], most[some]
        far = np.bitwise_count(self.sim[i] ^ self.sim[j]).astype(np.int64) + np.bitwise_count(self.more[i] ^ self.more[j])
        # first the likeliest partner of each line, then all others that this has not connected
        order = np.lexsort((far, i))
        head = np.ones(len(order), dtype=bool)
        head[1:] = i[order][1:] != i[order][:-1]
        for turn in (order[head], order[~head]):
            turn = turn[self.label[i[turn]] != self.label[j[turn]]]
            if len(turn):
                found = turn[many_within([(self.texts[a], self.texts[b]) for a, b in zip(i[turn], j[turn])], most[turn])]
                if len(found):
                    self.label = smallest_roots(len(self.label), self.label[i[found]], self.label[j[found]])[self.label]

    def solve(self) -> tuple[np.ndarray, np.ndarray]:
        """A forest of the similar lines as pairs of nodes."""
        at, lag, upto = np.arange(len(self.node)), 1, 1
        held: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            at = at[at + lag < len(self.node)]
            at = at[(self.group[at] == self.group[at + lag]) & (self.length[at] >= self.least * self.length[at + lag] - 1e-9)]
            hit = at[(self.label[at] != self.label[at + lag]) & (~self.halves[at] | (self.part[at] != self.part[at + lag]))]
            hit = hit[np.bitwise_count(self.sim[hit] ^ self.sim[hit + lag]) + np.bitwise_count(self.more[hit] ^ self.more[hit + lag]) <= self.bits]
            held.append((hit, hit + lag))
            if lag >= upto or not len(at) or sum(len(x) for x, _ in held) > PAIRS_AT_ONCE:
                self._test(*(np.concatenate(x) for x in zip(*held)))
                held, upto = [], 2 * lag
            lag += 1
        some = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.node[some], self.node[self.label[some]]


def _verified(bits: int, least: float) -> tuple[Callable[[pa.Table], Iterator[pa.RecordBatch]], Callable[[], Iterator[pa.RecordBatch]]]:
    """(take a group, end): groups are gathered up to a bound and verified together."""
    held: list[pa.Table] = []
    size = [0, 0]

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            block = Block(np.repeat(np.arange(len(held)), [t.num_rows for t in held]), held, bits, least)
            held.clear()
            size[:] = 0, 0
            a, b = block.solve()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def take(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows > 1:
            held.append(group)
            size[0] += group.num_rows
            size[1] += group.nbytes
            if size[0] >= LINES_AT_ONCE or size[1] >= BYTES_AT_ONCE:
                yield from flush()

    return take, flush


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("row_key"), text.alias("text"))


def meetings(links: DataFrame, sized: DataFrame, block: int) -> DataFrame:
    """(node, group, lo, hi, part): where the lines of sized(node, root, weight) meet, each near pair of links(at, a, b) somewhere.

    A group of near lines, a root, meets whole up to `block` in weight. Chance
    likeness connects ever more of a corpus into one group, whose blocks would
    copy each line once a block: a heavier group falls apart into the near lines
    of each key where that makes fewer copies, at most one a key.
    """
    copies = lambda weight: weight * F.ceil(weight / block)
    heavy = sized.groupBy("root").agg(F.sum("weight").alias("w")).where(F.col("w") > block)
    heavy = written(heavy.select("root", copies(F.col("w")).alias("whole")))
    if heavy.isEmpty():
        return by_block(sized.withColumnRenamed("root", "group"), "group", F.col("node"), F.col("weight"), block)
    # each has more than block in weight, so that they are few
    near = links.select(F.explode(F.array("a", "b")).alias("node"), F.xxhash64("at", "b").alias("group")).distinct()
    near = written(near.join(sized.join(F.broadcast(heavy.select("root")), "root"), "node").select("root", "group", "node", "weight"))
    made = near.groupBy("root", "group").agg(F.sum("weight").alias("w")).groupBy("root").agg(F.sum(copies(F.col("w"))).alias("apart"))
    apart = F.broadcast(written(heavy.join(made, "root").where("apart < whole").select("root")))
    whole = sized.join(apart, "root", "left_anti").select("node", F.col("root").alias("group"), "weight")
    return by_block(whole.unionByName(near.join(apart, "root", "left_semi").select("node", "group", "weight")), "group", F.col("node"), F.col("weight"), block)


def repeated_lines(docs: DataFrame, *, least_words: int = 5, distance: int = 3, similarity: float = 0.9, block: int = 32_768, least_chars: int = 9) -> DataFrame:
    """The lines to drop: (doc_id, row_key, line, kept_doc, kept_line).

    Lines are what newlines part. Lines of at least `least_words` words or
    `least_chars` characters (five words of one letter have nine) are compared by
    their words, lower-cased, without punctuation; shorter ones are never dropped.
    Two lines link if their edit similarity is `similarity` or more. It is tested
    where they share one of the KEYS lowest hashes of their character n-grams (a
    pair that shares a part J of its n-grams is missed by (1 - J) ** KEYS), and
    their SimHashes over n-grams differ in at most `distance` bits more than such
    edits make on average; of each connected group the occurrence with the smallest
    (doc_id, row_key, line) stays. row_key is xxhash64 of the text; rows that
    repeat a doc_id and its text are one document. A null text has no lines, a
    null doc_id sorts first, other columns are not read, and an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    bits = most_bits(similarity, distance)
    keyed = _keyed(docs)
    # a key that one line alone has goes
    tables = keyed.select("text").mapInArrow(_keyed_lines(least_words, least_chars, similarity), "at long, node long, sim long, mark long")
    dealt = by_block(tables, "at", F.col("node"), F.lit(1), LINES_A_KEY, unlike="node", count="blocks").select("at", "lo", "hi", "blocks", "node", "sim", "mark")
    length = F.col("mark").bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _key_links(batches, bits, similarity)

    # rows lie together by their key, so that only keys of several blocks are dealt again
    schema = "at long, a long, b long, mark long, lo int, hi int"
    met = written(dealt.sortWithinPartitions("at", length).mapInArrow(near, schema))
    links, hot = met.where("lo IS NULL").select("at", "a", "b"), met.where("lo IS NOT NULL")
    if not hot.isEmpty():
        hot = hot.select("at", "lo", "hi", F.col("a").alias("node"), F.col("b").alias("sim"), "mark").repartition("at", "lo", "hi").sortWithinPartitions("at", "lo", "hi", length)
        links = links.unionByName(written(hot.mapInArrow(near, schema)).select("at", "a", "b"))
    groups = written(components(links.select("a", "b"), spark))

    wanted = Bloom.of(groups, "node")
    lines = written(keyed.mapInArrow(_placed_lines(least_words, least_chars, similarity, wanted), PLACED))
    texts = lines.where("words IS NOT NULL").select("node", "sim", "more", "length", "keys", "words")
    # what one task can hold: `block` lines of BYTES_A_LINE
    sized = written(texts.groupBy("node").agg(F.max(F.ceil(F.octet_length("words") / BYTES_A_LINE)).alias("weight")).join(groups, "node"))
    # places are dealt without the words, which are shuffled by line and by place and no more
    met = texts.dropDuplicates(["node"]).join(meetings(links, sized, block), "node")
    linked = written(components(grouped(met, ["group", "lo", "hi"], _verified, "a long, b long", bits, similarity), spark))

    # most lines are alone; only the others are sorted
    counts = lines.groupBy("node").agg(F.count("*").alias("n")).join(linked, "node", "left")
    # written, so that the joins deal both of their sides, and can split the rows of a line that stands everywhere
    met = written(counts.where("n > 1 OR root IS NOT NULL").select("node", F.coalesce("root", "node").alias("group")))
    placed = written(lines.select("doc_id", "row_key", "line", "node").join(met, "node").drop("node"))
    here = F.struct("doc_id", "row_key", "line")
    firsts = written(placed.groupBy("group").agg(F.min(here).alias("first")))
    rest = placed.join(firsts, "group").where(here != F.col("first"))
    return rest.select("doc_id", "row_key", "line", F.col("first.doc_id").alias("kept_doc"), F.col("first.line").alias("kept_line"))


def report(docs: DataFrame, **parameters) -> DataFrame:
    """One row per distinct (doc_id, text): n_lines, n_dropped, the dropped lines' numbers and where each is kept."""
    drops = repeated_lines(docs, **parameters).distinct()
    drops = drops.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("line", "kept_doc", "kept_line"))).alias("__d"))
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", F.xxhash64(text).alias("row_key"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines")).distinct()
    own = drops.select(F.col("doc_id").alias("__doc"), F.col("row_key").alias("__key"), "__d")
    out = whole.join(own, whole["doc_id"].eqNullSafe(own["__doc"]) & (whole["row_key"] == own["__key"]), "left")
    dropped = F.coalesce("__d", F.array().cast("array<struct<line:int,kept_doc:bigint,kept_line:int>>"))
    return out.select("doc_id", "row_key", F.col("n_lines").cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), dropped["line"].alias("dropped_lines"), dropped["kept_doc"].alias("kept_in"))


def without_repeated_lines(docs: DataFrame, **parameters) -> DataFrame:
    """docs with repeated lines cut out of text; n_chars, where there is one, follows.

    Documents of which only blank lines would be left go; all other columns are
    unchanged. Null and empty texts stay as they are; rows that repeat doc_id and
    text are cut alike; names that begin with __sl_ are taken.
    """
    drops = repeated_lines(docs, **parameters).groupBy(F.col("doc_id").alias("__sl_doc"), F.col("row_key").alias("__sl_key")).agg(F.collect_set("line").alias("__sl_drop"))
    keyed = docs.withColumn("__sl_own", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = keyed.join(drops, keyed["doc_id"].eqNullSafe(drops["__sl_doc"]) & (F.col("__sl_own") == F.col("__sl_key")), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, k: ~F.array_contains("__sl_drop", k)), "\n")
    changed = F.col("__sl_drop").isNotNull()
    both = both.withColumn("text", F.when(changed, left).otherwise(F.col("text"))).where(~changed | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return both.select(*docs.columns)
