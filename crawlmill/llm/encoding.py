"""Garbled text from wrong character encodings, found and restored by description length.

A chain undoes wrong decodings: each step takes text back to bytes by the codec it
was wrongly read with and reads the bytes by another. The text beside characters
beyond ASCII is cut into spans, and a span's description length is the bytes that it
adds to a frame which zstandard compresses with a dictionary of a language. A line
costs the sum of its spans in the language that fits it best; a chain's steps cost
bytes too, and so do characters that a decoder lost. The shortest description of a
line wins, and a line whose own is shortest stays as it is. Spans recur, so each
is judged once in a task, with all its chains.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.llm.flat import steps as batch_steps

#: Samples read per language for the dictionaries at most.
SAMPLES_PER_LANGUAGE = 2_000
#: Bytes that a step of a chain costs, by whether it reads single bytes as UTF-8, which text fits by chance less often.
UTF8_COST, OTHER_COST = 1, 3
#: Bytes that a character without meaning costs: one that a decoder put for what it could not read, or a control character.
LOST_COST = 8
#: Bytes that each character costs which a step to UTF-8 leaves as it is, within a span that it changes.
LEFT_COST = 2
#: Bytes that each character costs which such a step gives and no dictionary has, as any two bytes may look like one.
NEW_COST = 1
#: Steps of a chain, and how many of them may read bytes by another codec than UTF-8.
DEPTH, OTHER_STEPS = 3, 1
#: Spans, and chains of spans, that a task remembers at once; what is forgotten is worked out again.
KNOWN_SPANS, KNOWN_CHAINS = 200_000, 500_000

# Codecs that text is wrongly read with.
SINGLE_BYTE = (
    "cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "cp1254", "cp1253", "iso8859_15", "iso8859_2",
    "iso8859_7", "iso8859_5", "cp866", "cp1257", "mac_cyrillic",
)
MULTI_BYTE = ("gb18030", "big5", "shift_jis", "euc_kr")
#: Western codecs that a text's bytes may really have been in.
WESTERN = ("cp1252", "mac_roman", "cp850")


def _charmap(name: str) -> str:
    """The 256 characters of a codec; bytes it leaves open stand for control characters, as browsers read them."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


MAPS = {name: _charmap(name) for name in SINGLE_BYTE}
BYTES = {name: {c: i for i, c in enumerate(m)} for name, m in MAPS.items()}
#: Runs of characters beyond ASCII that a codec can have made, byte by byte.
RUNS = {name: re.compile("[" + re.escape(m[128:]) + "]+") for name, m in MAPS.items()}
_UTF8 = re.compile(
    rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
_ENTITY = r"&(?:[A-Za-z]{2,8}\d{0,2}|#\d{2,5});"
#: A character beyond ASCII or an entity, with the letters, digits and further such characters beside it.
SPAN = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9]*+(?:(?:[^\x00-\x7f]|{_ENTITY})[A-Za-z0-9]*+)+")
ENTITY = re.compile(_ENTITY)
#: What a decoder puts for bytes it cannot read, and control characters but the line break of old mainframes.
LOST = re.compile("[�\x80-\x84\x86-\x9f]")

_PAIR = re.compile("[^\x00-\x7f]{2}")
_HAN = re.compile("[\u3000-\u9fff\uac00-\ud7a3\uff61-\uff9f]")
Chain = tuple[str, ...]


def _begins(name: str) -> re.Pattern:
    """The first two characters of a UTF-8 sequence, read as a codec."""
    lead, rest = (re.escape("".join(MAPS[name][i] for i in r)) for r in (range(0xC2, 0xF5), range(0x80, 0xC0)))
    return re.compile(f"[{lead}][{rest}]")


BEGINS = {name: _begins(name) for name in SINGLE_BYTE}
HIGH = {name: frozenset(m[128:]) for name, m in MAPS.items()}
REMAPS = {c: {f"{c}>{right}": str.maketrans(MAPS[c][128:], MAPS[right][128:]) for right in WESTERN if right != c} for c in SINGLE_BYTE}
OTHERS = frozenset(step for steps in REMAPS.values() for step in steps)


def _unread_utf8(text: str, codec: str) -> tuple[str, int]:
    """``text`` with each run that is UTF-8 read as ``codec`` read rightly, and how many characters beyond ASCII stay."""
    table, left = BYTES[codec], 0

    def fix(run: re.Match) -> str:
        nonlocal left
        raw = bytes(table[c] for c in run[0])
        out, at = [], 0
        for m in _UTF8.finditer(raw):
            out += [run[0][at : m.start()], m[0].decode("utf-8")]
            left += m.start() - at
            at = m.end()
        left += len(raw) - at
        return "".join(out) + run[0][at:]

    fixed = RUNS[codec].sub(fix, text)
    return fixed, left + sum(c > "\x7f" and c not in HIGH[codec] for c in text)


@lru_cache(KNOWN_SPANS)
def undo(step: str, text: str) -> tuple[str, int]:
    """``text`` with one wrong reading undone, and the characters that a step to UTF-8 left; as it is where it cannot have been read that way."""
    if step == "entities":
        return (html.unescape(text) if "&" in text else text), 0
    codec, _, right = step.partition(">")
    if codec in MULTI_BYTE:
        try:
            return (text.encode(codec).decode(right) if _HAN.search(text) else text), 0
        except UnicodeError:
            return text, 0
    if right == "utf-8":
        return _unread_utf8(text, codec) if BEGINS[codec].search(text) else (text, 0)
    fits = all(c <= "\x7f" or c in HIGH[codec] for c in text)
    return (text.translate(REMAPS[codec][step]) if fits else text), 0


def undone(text: str) -> Iterator[tuple[str, str, int]]:
    """(step, text, left) of all steps that change ``text``; those to UTF-8 first."""
    high = {c for c in text if c > "\x7f"}
    steps = ["entities"] * ("&" in text)
    if _PAIR.search(text):  # a sequence has two characters at least
        steps += [f"{codec}>utf-8" for codec in SINGLE_BYTE if BEGINS[codec].search(text)]
    if _HAN.search(text):
        steps += [f"{codec}>utf-8" for codec in MULTI_BYTE]
    for step in steps:
        fixed, left = undo(step, text)
        if fixed != text:
            yield step, fixed, left
    for codec in SINGLE_BYTE if high else ():
        if high <= HIGH[codec]:
            for step, table in REMAPS[codec].items():
                fixed = text.translate(table)
                if fixed != text:
                    yield step, fixed, 0


def step_cost(step: str) -> int:
    return OTHER_COST if step in OTHERS or step.partition(">")[0] in MULTI_BYTE else UTF8_COST


def chain_cost(chain: Chain) -> int:
    return sum(map(step_cost, chain))


class _TwoBytes(dict):
    """Characters as ones of two bytes: how many UTF-8 takes for a script or a dash tells nothing of a wrong reading."""

    def __missing__(self, c: int) -> int:
        self[c] = c if c < 0x800 else 0x80 + c % 0x780
        return self[c]


TWO_BYTES = _TwoBytes()


class Lengths:
    """Description lengths by zstandard with a dictionary per language."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 12):
        import zstandard as z

        self.frames = []
        for _, own in sorted(dictionaries.items()):
            data = own.decode().translate(TWO_BYTES).encode()
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            packer = z.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            # a piece of the dictionary opens the frame, so that what a frame costs by itself is not charged to the span
            words = data.split(b" ")
            opening = b" ".join(words[len(words) // 2 : len(words) // 2 + 6])
            self.frames.append((packer, opening, len(packer.compress(opening + b" ."))))
        self.letters = {c for data in dictionaries.values() for c in data.decode() if ord(c) > 127}
        self.known: dict[str, np.ndarray] = {}

    def of(self, span: str) -> np.ndarray:
        """Bytes of ``span`` in each language."""
        if span not in self.known:
            if len(self.known) > KNOWN_SPANS:
                self.known.clear()
            raw = span.translate(TWO_BYTES).encode("utf-8", "replace")
            sizes = [len(p.compress(o + b" " + raw + b" .")) - base for p, o, base in self.frames] or [len(raw)]
            self.known[span] = np.array(sizes) + LOST_COST * len(LOST.findall(span))
        return self.known[span]

    def extra(self, span: str, fixed: str, left: int, chain: Chain) -> int:
        """Bytes that ``chain`` costs for what it left in ``span`` and for new characters."""
        if OTHERS.issuperset(chain) or span == fixed:
            return LEFT_COST * left
        return LEFT_COST * left + NEW_COST * sum(c > "\x7f" and c not in self.letters and c not in span for c in fixed)

    def may_gain(self, span: str, fixed: str) -> bool:
        """False where ``fixed`` cannot be shorter: it has no fewer characters, and none beyond ASCII that a dictionary could give."""
        return len(fixed) < len(span) or bool(LOST.search(span)) or not self.letters.isdisjoint(fixed) or fixed.isascii()


class Restorer:
    """Chains of spans, lines and texts."""

    def __init__(self, lengths: Lengths):
        self.lengths = lengths
        self.spans: dict[str, dict[Chain, int]] = {}
        self.held = 0

    def gaining(self, span: str) -> dict[Chain, int]:
        """All chains within the depth that make ``span`` shorter in some language, and by how many bytes at most."""
        if span in self.spans:
            return self.spans[span]
        if len(self.spans) > KNOWN_SPANS or self.held > KNOWN_CHAINS:
            self.spans.clear()
            self.held = 0
        own, out, front = self.lengths.of(span), {}, {span: [((), 0)]}
        for _ in range(DEPTH):
            new: dict[str, list[tuple[Chain, int]]] = {}
            for text, ways in front.items():
                free = [(c, n) for c, n in ways if len(OTHERS.intersection(c)) < OTHER_STEPS]
                for step, fixed, left in undone(text):
                    allowed = free if step in OTHERS else ways
                    if allowed and fixed != span:
                        new.setdefault(fixed, []).extend(((*c, step), n + left) for c, n in allowed)
            for fixed, ways in new.items():
                if self.lengths.may_gain(span, fixed):
                    saved = int((own - self.lengths.of(fixed)).max())
                    if saved > 0:
                        out |= {c: v for c, n in ways if (v := saved - self.lengths.extra(span, fixed, n, c)) > 0}
            front = new
        out.pop(("entities",), None)  # entities alone are markup, not a wrong reading
        self.spans[span] = out
        self.held += len(out)
        return out

    def line(self, line: str) -> tuple[str, Chain]:
        """The line by its shortest description, and the chain that gives it; none if it stays.

        A chain saves no more than the most it saves in each span, so the search ends when no
        chain left can save more than the best one did.
        """
        spans = SPAN.findall(line)
        most: dict[Chain, int] = {}
        for span in spans:
            for chain, saved in self.gaining(span).items():
                most[chain] = most.get(chain, 0) + saved
        most = {c: saved - chain_cost(c) for c, saved in most.items()}
        chains = sorted((c for c, saved in most.items() if saved > 0), key=lambda c: (-most[c], len(c), c))
        lost = len(LOST.findall(line))
        if not chains and not lost:
            return line, ()
        own = int(sum(map(self.lengths.of, spans)).min()) if spans else 0
        # that a decoder lost the characters explains them, but gives nothing back
        best = (own, (), spans) if not lost else (own - LOST_COST * lost + UTF8_COST + lost, ("lost",), spans)
        for chain in chains:
            if own - most[chain] >= best[0]:
                break
            fixed, left = spans, [0] * len(spans)
            for step in chain:
                ways = [undo(step, s) for s in fixed]
                left = [n + m * (s != was) for n, (s, m), was in zip(left, ways, fixed)]
                fixed = [s for s, _ in ways]
            extra = sum(self.lengths.extra(a, b, n, chain) for a, b, n in zip(spans, fixed, left))
            cost = int(sum(map(self.lengths.of, fixed)).min()) + chain_cost(chain) + extra
            if cost < best[0]:
                best = (cost, chain, fixed)
        parts = iter(best[2])
        return SPAN.sub(lambda _: next(parts), line), best[1]

    def text(self, text: str) -> tuple[bool, str, list[str]]:
        """(garbled, text restored as far as can be, steps used); lines are judged by themselves, as a part may be garbled."""
        if text.isascii() and "&" not in text:
            return False, text, []
        out, used, garbled = [], [], False
        for line in text.split("\n"):
            if not line.isascii() or "&" in line:
                line, chain = self.line(line)
                garbled |= bool(chain)
                used += [s for s in chain if s not in used and s != "lost"]
            out.append(line)
        return garbled, "\n".join(out), used


def fit_dictionaries(samples: DataFrame) -> dict[str, bytes]:
    """Per language the text of its samples (sample_id, lang, text), at most ``SAMPLES_PER_LANGUAGE``, by id."""
    first = Window.partitionBy("lang").orderBy("sample_id")
    rows = (
        samples.where("lang is not null and text is not null")
        .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SAMPLES_PER_LANGUAGE)
        .select("lang", "text").collect()
    )
    texts: dict[str, list[str]] = {}
    for lang, text in sorted(tuple(r) for r in rows):
        texts.setdefault(lang, []).append(text)
    return {lang: "\n".join(t).encode() for lang, t in texts.items()}


def restored(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(doc_id, text, chain) of the garbled documents of (doc_id, text), each text restored as far as can be.

    ``chain`` names the steps used, '' where nothing restores the text. Null and
    empty texts are not garbled. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(Lengths(shared.value))
        for batch in batches:
            for part in batch_steps(batch, 1):
                ids, texts, chains = [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    garbled, fixed, chain = restorer.text(text)
                    if garbled:
                        ids.append(doc_id)
                        texts.append(fixed)
                        chains.append(" ".join(chain))
                arrays = [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(chains, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "chain"])

    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, text string, chain string")
