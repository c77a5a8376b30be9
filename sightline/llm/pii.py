"""Personal data: plain patterns, and the same patterns after offset-preserving deobfuscation.

A transducer rewrites a text and keeps for every character of the result the
source span that it came from, so what is found in the rewritten text maps back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import each_text

KINDS = ["email", "ip", "card", "phone"]

# The patterns of the identifiers.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# The same matches in linear time: an address is sought around its @, and a run of digits is entered at its start alone.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
FOUR_PARTS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
LONG_NUMBER = re.compile(r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,}+")
INTERNATIONAL = re.compile(PHONE)

# Letters of other scripts that look like ASCII ones, in pairs.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХУаеіјорсухѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνικ", "ABESIJKMHOPCTXYaeijopcyxsdhqwABEZHIKMNOPTYXaopvik"))
# Other signs for ASCII ones; an empty one goes.
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", "․": ".", "。": ".", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": ""}
# The words of the digits in English, German, Spanish and French.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
# Letters typed for digits.
LETTER_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "B": "8"}

_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
STRANGE = re.compile("[" + "".join(SIGNS) + "Ͱ-ϿЀ-ԯ①-⑳⁰-₉！-～\U0001d400-\U0001d7ff]")
AT_BRACKET = re.compile(r"(?<=[A-Za-z0-9])\s*[(\[{<]\s*(?:at|@)\s*[)\]}>]\s*(?=[A-Za-z0-9])", re.I)
DOT_BRACKET = re.compile(r"(?<=[A-Za-z0-9])\s*[(\[{<]\s*(?:dot|punkt|punto|point|\.)\s*[)\]}>]\s*(?=[A-Za-z0-9])", re.I)
AT_DOT_WORDS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}([\s_]{1,8}at[\s_]{1,8})[A-Za-z0-9-]{1,63}(?:[\s_]{1,8}dot[\s_]{1,8}[A-Za-z0-9-]{1,63})+", re.I)
AT_SPACED = re.compile(r"(?<=[A-Za-z0-9]) +@ +(?=[A-Za-z0-9-]+(?: \. |\.| dot )[A-Za-z0-9])", re.I)
DOT_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:(?:[\s_]+dot[\s_]+| \. |\.)[A-Za-z0-9-]+)+", re.I)
DOT_WORD = re.compile(r"[\s_]+dot[\s_]+| \. ", re.I)
DOT_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s+dot\s+[0-9]{1,3}){3}(?![0-9])", re.I)
SPELLED = re.compile(rf"(?<!\w)(?:plus[ -]+)?(?:{_WORD}|[0-9]+)(?:[ ,-]{{1,2}}(?:{_WORD}|[0-9]+)){{6,}}(?!\w)", re.I)
SPELLED_HINT = re.compile(rf"(?<!\w){_WORD}[ ,-]{{1,2}}{_WORD}[ ,-]{{1,2}}(?:{_WORD}|[0-9])", re.I)
SPELLED_PART = re.compile(rf"plus[ -]+|{_WORD}|[ ,-]{{2}}|,", re.I)
TYPED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OolISB]+(?:[ .-][0-9OolISB]+)*(?![A-Za-z0-9])")
TYPED_IP = re.compile(r"(?<![A-Za-z0-9.])[0-9OolISB]{1,3}(?:\.[0-9OolISB]{1,3}){3}(?![A-Za-z0-9]|\.[0-9A-Za-z])")
_PART = rf"(?:{_WORD}(?:[ -]{_WORD}){{0,2}}|[0-9]{{1,3}})"
SPELLED_IP = re.compile(rf"(?<!\w){_PART}(?: +dot +{_PART}){{3}}(?!\w)", re.I)
SPELLED_IP_PART = re.compile(rf" +dot +|{_WORD}|[ -]", re.I)
TYPED_HINT = re.compile(r"[0-9][OolISB]|[OolISB][ .-]?[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What EMAIL finds: of the run of LOCAL before each @, what no earlier match has taken, and the names after it."""
    taken, at = 0, text.find("@")
    low = 0
    while at >= 0:
        start = at - len(text[low:at]) + len(text[low:at].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            taken = m.end()
        low = max(taken, at + 1)
        at = text.find("@", low)


def _octet(digits: str) -> bool:
    """Whether a run of digits of any length is 255 at most."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every plain identifier, sorted; matches that fail their test are dropped.

    The matches are those of EMAIL, IP, CARD and PHONE, found in time linear in the text.
    """
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in FOUR_PARTS.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in LONG_NUMBER.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 38 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in INTERNATIONAL.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


class Rewritten:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts: list[int] | range = range(len(text))
        self.ends: list[int] | range = range(1, len(text) + 1)

    def replace(self, spans: list[tuple[int, int, str]]) -> None:
        """Put strings for spans (start, end, string), sorted and apart; each new character stands for the whole span."""
        if not spans:
            return
        parts: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        last = 0
        for a, b, new in [*spans, (len(self.text), len(self.text), "")]:
            parts += [self.text[last:a], new]
            starts += [*self.starts[last:a], *[self.starts[a]] * len(new)] if a < len(self.text) else self.starts[last:a]
            ends += [*self.ends[last:a], *[self.ends[b - 1]] * len(new)] if b else []
            last = b
        self.text, self.starts, self.ends = "".join(parts), starts, ends

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _fold(c: str) -> str:
    if c in SIGNS:
        return SIGNS[c]
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) <= 2 and plain.isascii() else c


def homoglyphs(r: Rewritten) -> None:
    r.replace([(m.start(), m.end(), f) for m in STRANGE.finditer(r.text) if (f := _fold(m[0])) != m[0]])


def at_and_dot(r: Rewritten) -> None:
    """Bracketed, spelled and spaced at and dot signs, where the words around make an address."""
    if any(c in r.text for c in "([{<"):
        r.replace([(m.start(), m.end(), "@") for m in AT_BRACKET.finditer(r.text)])
        r.replace([(m.start(), m.end(), ".") for m in DOT_BRACKET.finditer(r.text)])
    if " @ " in r.text:
        r.replace([(m.start(), m.end(), "@") for m in AT_SPACED.finditer(r.text)])
    if "dot" in r.text.lower():
        r.replace([(*m.span(1), "@") for m in AT_DOT_WORDS.finditer(r.text)])
        r.replace([(m.start() + d.start(), m.start() + d.end(), ".") for m in DOT_IP.finditer(r.text) for d in DOT_WORD.finditer(m[0])])
    if "@" in r.text:
        r.replace([(m.start() + d.start(), m.start() + d.end(), ".") for m in DOT_AFTER_AT.finditer(r.text) for d in DOT_WORD.finditer(m[0])])


def spelled_digits(r: Rewritten) -> None:
    """Runs of seven or more digits, and addresses of four parts, with some digits spelled or letters typed for them."""
    if "dot" in r.text.lower():
        spans = []
        for run in SPELLED_IP.finditer(r.text):
            for part in SPELLED_IP_PART.finditer(run[0]):
                new = DIGIT_WORDS.get(part[0].lower(), "." if "dot" in part[0].lower() else "")
                spans.append((run.start() + part.start(), run.start() + part.end(), new))
        r.replace(spans)
    if SPELLED_HINT.search(r.text):
        spans = []
        for run in SPELLED.finditer(r.text):
            for part in SPELLED_PART.finditer(run[0]):
                word = part[0].lower()
                new = "+" if word.startswith("plus") else DIGIT_WORDS.get(word, " ")
                spans.append((run.start() + part.start(), run.start() + part.end(), new))
        r.replace(spans)
    if TYPED_HINT.search(r.text):
        spans = []
        for run in TYPED_IP.finditer(r.text):
            # at least two of the parts are figures alone
            if sum(part.isdigit() for part in run[0].split(".")) >= 2:
                spans += _figures(run)
        r.replace(spans)
        spans = []
        for run in TYPED.finditer(r.text):
            digits = sum(c.isdigit() for c in run[0])
            letters = sum(c in LETTER_DIGITS for c in run[0])
            if letters and digits >= 7 and digits >= letters:
                spans += _figures(run)
        r.replace(spans)


def _figures(run: re.Match) -> list[tuple[int, int, str]]:
    return [(run.start() + k, run.start() + k + 1, LETTER_DIGITS[c]) for k, c in enumerate(run[0]) if c in LETTER_DIGITS]


#: In the order that they are applied.
TRANSDUCERS: list[Callable[[Rewritten], None]] = [homoglyphs, at_and_dot, spelled_digits]


def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the transducers bring to light, as source spans that touch no span of base."""
    r = Rewritten(text)
    if not text.isascii() and STRANGE.search(text):
        homoglyphs(r)
    at_and_dot(r)
    spelled_digits(r)
    if r.text == text:
        return []
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    out: list[tuple[int, int, int]] = []
    last = 0
    # starts never fall, in base, in what is found and in their sources
    for a, kind, b in find(r.text):
        start, end = r.source(a, b)
        before = bisect_left(starts, end)
        if start >= last and not (before and reach[before - 1] > start):
            out.append((start, kind, end))
            last = end
    return out


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows: list[list] = [[] for _ in range(7)]
    spans: list[list[dict]] = []
    for text in batch.column("text").to_pylist():
        base = find(text)
        more = added(text, base)
        every = sorted(base + more)
        for k in range(4):
            rows[k].append(sum(kind == k for _, kind, _ in base))
        rows[4].append(hashlib.sha256(_told(base).encode()).hexdigest())
        rows[5].append(_told(every))
        rows[6].append(len(more))
        spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in every])
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
    list_kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    yield pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("row_key"), *[pa.array(v, type=t) for v, t in zip(rows, kinds)], pa.array(spans, type=list_kind)],
        names=["doc_id", "row_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "found"],
    )


SCHEMA = "doc_id long, row_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, found array<struct<kind:string,start:int,end:int>>"


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row: counts of the plain identifiers, all spans as text and as an array, n_added.

    Base spans are the plain patterns' matches that pass their tests; the
    transducers add spans that overlap none of them. Spans are code points, end
    exclusive; texts are read whole, in time linear in their length. Written-out
    addresses are taken up to 64 characters before "at", 63 a name and eight blanks
    between. A null text is empty and has no spans; rows that repeat get equal
    rows; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("row_key"), text.alias("text")).mapInArrow(each_text(_scan), SCHEMA)


def _mask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = []
    for text in batch.column("text").to_pylist():
        if text:
            base = find(text)
            parts, last = [], 0
            for a, k, b in sorted(base + added(text, base)):
                if a >= last:
                    parts += [text[last:a], f"<{KINDS[k].upper()}>"]
                last = max(last, b)
            text = "".join([*parts, text[last:]])
        texts.append(text)
    at = batch.schema.get_field_index("text")
    yield batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of personal_data replaced by its kind in angle brackets.

    Of spans that overlap the first gives the kind, and all of them go. A null
    text stays null; rows that repeat are rewritten alike; other columns are
    unchanged; an empty table stays empty.
    """
    return docs.mapInArrow(each_text(_mask), docs.schema)
