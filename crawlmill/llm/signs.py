"""Keys and signs of every line of every page, in one pass over the texts.

Lines go on as hashes and flags only. A line's words are hashed without case; words
of the page's own host count as one mark and numbers as another, so that the same
response or notice has the same key on every host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.llm.flat import SPACES, Flat, steps
from crawlmill.llm.lines import with_host

#: Flags of a line: a sentence with function words; a placeholder; filler; shares a term with title or slug; an item of a list; a headline.
SENTENCE, PLACEHOLDER, FILLER, RELATED, LISTED, HEADLINE = 1, 2, 4, 8, 16, 32
SCHEMA = (
    "id long, host string, url_hash long, line_no int, flags int, k1 long, k2 long, body long, opening long, lead long, b0 int, b1 int, bins long, parity long"
)
#: Words that a line's opening has.
OPENING = 3
#: Words at most of a line's lead, which stands before its first separator.
LEAD = 4
#: Share of a language's samples that a function word stands in.
FUNCTION_SHARE = 0.15
#: Least words of a sentence, and the least share of function words in it.
SENTENCE_WORDS, SENTENCE_SHARE = 5, 0.12
_NAME, _NUMBER, _HOST = np.uint64(1), np.uint64(2), np.uint64(3)

# Marks that a template leaves where a value is missing.
_ID = r"[A-Za-z_][\w.]*"
PLACEHOLDERS = (
    rf"\{{\{{ ?{_ID} ?\}}\}}",
    rf"\{{% ?{_ID} ?%\}}",
    rf"<%=? ?{_ID} ?%>",
    rf"[$#@]\{{{_ID}\}}",
    rf"\[\[ ?{_ID} ?\]\]",
    rf"\[{_ID} HERE\]",
    rf"%%{_ID}%%",
    rf"##{_ID}##",
    r"__[A-Za-z]+(?:_[A-Za-z]+)*__",
    rf"%\({_ID}\)[sd]",
    r"<[A-Za-z][A-Za-z_.]{3,30}>",
    r"\{\d\}",
    r"(?<![\w%])%[sd](?!\w)",
)
# Words of texts that explain placeholders; a line with one of each kind quotes.
TEMPLATE_WORDS = (
    "template", "modelo", "plantilla", "gabarit", "vorlage", "modelli", "modello", "modèle", "placeholder", "platzhalter",
    "marcador", "segnaposto", "syntax", "sintaxe", "sintaxis", "syntaxe", "sintassi",
)
VALUE_WORDS = (
    "mark", "marca", "marque", "marke", "segno", "value", "valor", "valeur", "valore", "wert", "variable", "variável", "variabile",
)
_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS))
_QUOTED = re.compile(rf"(?=.*(?:{'|'.join(TEMPLATE_WORDS)}))(?=.*\b(?:{'|'.join(VALUE_WORDS)})\b)", re.I)


def _table(test) -> np.ndarray:
    return np.array([test(chr(i)) for i in range(65536)])


def _lower(c: str) -> int:
    low = c.lower()
    return ord(low) if len(low) == 1 and ord(low) < 65536 else ord(c)


LOWER = _table(_lower).astype(np.uint16)
DIGIT = np.zeros(65536, bool)
DIGIT[48:58] = True
LETTER, UPPER = _table(str.isalpha), _table(str.isupper)
_STOP, _CLOSING, _OPENER, _SEPARATOR, _BULLET = (
    np.isin(np.arange(65536), [ord(c) for c in x]) for x in (".!?…", "\"'”’»“)]", "{[%#<_$@", ":»>/|·", "-•*")
)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A well-mixed 64-bit value of each number."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def places(owner: np.ndarray) -> np.ndarray:
    """The place of each value in its run of equal owners, from 0."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.arange(len(owner)) - np.repeat(starts, np.diff(starts, append=len(owner)))


_PLACES: dict[int, np.ndarray] = {}


def mixed_places(owner: np.ndarray, seed: int) -> np.ndarray:
    """``mix`` of the place of each value in its run; the first ones are kept, as they recur."""
    at = places(owner)
    if not len(at) or at.max() >= 1 << 16:
        return mix(at.astype(np.uint64), seed)
    if seed not in _PLACES:
        _PLACES[seed] = mix(np.arange(1 << 16, dtype=np.uint64), seed)
    return _PLACES[seed][at]


def runs(values: np.ndarray, owner: np.ndarray, n: int, how=np.add) -> np.ndarray:
    """``how`` over runs of equal, rising owners; 0 for owners without a value."""
    out = np.zeros(n, values.dtype)
    if len(values):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[starts]] = how.reduceat(values, starts)
    return out


def line_keys(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of the lines' folded texts: lower case, single spaces, digit runs as one 0, ß as ss."""
    cp, line = flat.cp, flat.line
    at = np.arange(len(cp))
    inside = (at >= flat.first[line]) & (at <= flat.last[line])
    space, digit = SPACES[cp], DIGIT[cp]
    kept = inside.copy()
    kept[1:] &= ~(space[1:] & space[:-1]) & ~(digit[1:] & digit[:-1])
    code = np.where(space, 32, np.where(digit, 48, LOWER[cp]))[kept].astype(np.uint64)
    owner = line[kept]
    sharp = code == 0xDF
    if sharp.any():
        twice = 1 + sharp
        code, owner = np.repeat(np.where(sharp, ord("s"), code), twice), np.repeat(owner, twice)
    with np.errstate(over="ignore"):
        return tuple(mix(runs(code * mixed_places(owner, s), owner, flat.n), s) for s in (11, 23))


class Words:
    """Words of the lines of a ``Flat``: runs of letters and digits, with a hash without case, and the line of each."""

    def __init__(self, flat: Flat):
        cp = flat.cp
        word = LETTER[cp] | DIGIT[cp]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        at = np.flatnonzero(begin)
        digit = DIGIT[cp]
        word[1:] &= ~(digit[1:] & digit[:-1])  # a run of digits counts as one
        chars = np.flatnonzero(word)
        index = np.cumsum(begin)[chars] - 1
        with np.errstate(over="ignore"):
            value = np.where(digit[chars], 48, LOWER[cp[chars]]).astype(np.uint64) * mixed_places(index, 5)
            self.hash = runs(value, index, len(at)) + np.uint64(16)
        self.size = np.bincount(index, minlength=len(at)) if len(at) else np.zeros(0, np.int64)
        self.at, self.line = at, flat.line[at]
        following = cp[np.minimum(at + 1, len(cp) - 1)]
        self.raised = UPPER[cp[at]]
        self.name = self.raised & LETTER[following] & ~UPPER[following]
        self.number = DIGIT[cp[at]]
        self.count = np.bincount(self.line, minlength=flat.n)
        self.place = places(self.line)


def function_words(samples: DataFrame) -> np.ndarray:
    """Hashes of the words that stand in ``FUNCTION_SHARE`` of the samples (sample_id, lang, text) of some language, and in two at least.

    All samples are counted, where they are read. Only the words found reach the
    driver: for each language at most 1 / ``FUNCTION_SHARE`` times the words of a mean
    sample.
    """
    rows = samples.where("lang is not null and text is not null").select("lang", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1):
                langs, lang = np.unique(np.array(part.column(0).to_pylist(), object), return_inverse=True)
                flat = Flat([t.replace("ß", "ss") for t in part.column(1).to_pylist()])
                words = Words(flat)
                text, word = flat.text[words.line][~words.number], words.hash[~words.number]
                order = np.lexsort((text, word))
                text, word = text[order], word[order]
                first = np.ones(len(word), bool)  # a word counts once in a text
                first[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
                of = lang[text[first]]
                for k, name in enumerate(langs):
                    seen, n = np.unique(word[first][of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen.view(np.int64)), pa.array(n)], ["lang", "word", "n"])

    counts = rows.mapInArrow(read, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    texts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    common = counts.join(texts, "lang").where(F.col("n") >= F.greatest(F.lit(2.0), F.lit(FUNCTION_SHARE) * F.col("texts"))).select("word")
    return np.unique(common.toPandas()["word"].to_numpy(np.int64).view(np.uint64))


def _known(hashes: np.ndarray, owner: np.ndarray, own: np.ndarray, own_owner: np.ndarray) -> np.ndarray:
    """Whether each (hash, owner) is one of (own, own_owner)."""
    return np.isin(hashes ^ mix(owner.astype(np.uint64), 7), own ^ mix(own_owner.astype(np.uint64), 7))


def _of_texts(texts: list[str | None]) -> tuple[Words, np.ndarray]:
    flat = Flat([(t or "").replace("\n", " ") for t in texts])
    words = Words(flat)
    return words, flat.text[words.line]


def _sketches(words: Words, plain: np.ndarray, masked: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Two MinHash bands of four values, over a line's words and over its masked words, and a sketch of the masked words.

    Texts that are equal but for case and digits have equal ``plain`` words, so their
    first bands are equal. The sketch has 64 bins with the parity of each bin's least value. The least and the greatest of a hash are two independent values, so two hash functions give a band.
    """
    bands = []
    for own, seeds in ((plain, (31, 47)), (masked, (53, 67))):
        band = np.zeros(n, np.uint64)
        for seed in seeds:
            value = mix(own, seed)
            for how in (np.minimum, np.maximum):
                band = mix(band ^ runs(value, words.line, n, how), 3)
        bands.append((band >> np.uint64(32)).astype(np.uint32).view(np.int32))
    # one number sorts by line and bin, and within them by value
    key = np.sort((words.line.astype(np.uint64) << np.uint64(40)) | (mix(masked, 61) >> np.uint64(24)))
    slot = key >> np.uint64(34)
    least = np.flatnonzero(np.diff(slot, prepend=np.uint64(2**63)))
    owner, bit = (slot[least] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot[least] & np.uint64(63))
    bins = runs(bit, owner, n, np.bitwise_or)
    parity = runs(np.where(key[least] & np.uint64(1), bit, np.uint64(0)), owner, n, np.bitwise_or)
    return bands[0], bands[1], bins.view(np.int64), parity.view(np.int64)


def signs_of(
    hosts: list[str], urls: list[str | None], titles: list[str | None], texts: list[str | None], function: np.ndarray, sketch: bool = True
) -> dict[str, np.ndarray]:
    """Keys and flags of the non-blank lines of pages; ``text`` is the page's place in the lists and line 0 its title."""
    flat = Flat([f"{(t or '').replace(chr(10), ' ')}\n{s or ''}".replace("ß", "ss") for t, s in zip(titles, texts)])
    n, words = flat.n, Words(flat)
    page = flat.text[words.line]
    own, own_page = _of_texts(hosts)
    slugs, slug_page = _of_texts([(u or "").rstrip("/").rpartition("/")[2] for u in urls])
    term = (words.size >= 4) & ~np.isin(words.hash, function)
    title = flat.number[words.line] == 1
    # a line with the slug and title, the title with the slug alone
    shared = term & (_known(words.hash, page, slugs.hash, slug_page) | ~title & _known(words.hash, page, words.hash[title], page[title]))
    body = words.hash.copy()
    body[_known(words.hash, page, own.hash, own_page)] = _HOST
    body[words.number] = _NUMBER
    with np.errstate(over="ignore"):
        placed = body * mixed_places(words.line, 17)
    opens = words.place < OPENING
    whole = mix(runs(placed, words.line, n), 29)
    opening = mix(runs(placed[opens], words.line[opens], n), 37)

    # words before the first separator of a line
    cuts = np.flatnonzero(_SEPARATOR[flat.cp])
    first_cut = np.full(n, len(flat.cp))
    first_cut[flat.line[cuts[::-1]]] = cuts[::-1]
    leads = words.at < first_cut[words.line]
    lead_words = runs(leads.astype(np.int64), words.line, n)
    lead = mix(runs(placed[leads], words.line[leads], n), 43)
    lead[(lead_words == 0) | (lead_words > LEAD) | (first_cut == len(flat.cp))] = 0
    listed = _BULLET[flat.cp[flat.first]] & (flat.cp[np.minimum(flat.first + 1, len(flat.cp) - 1)] == 32)

    plain = np.isin(words.hash, function).astype(np.int64)
    plain_words = runs(plain, words.line, n)
    lower = runs((~words.raised & ~words.number).astype(np.int64), words.line, n)
    upper = runs(words.raised.astype(np.int64), words.line, n)
    last = flat.cp[flat.last]
    before = flat.cp[np.maximum(flat.last - 1, 0)]
    stops = _STOP[last] | (_CLOSING[last] & (_STOP[before] | _CLOSING[before]))
    worded = (words.count >= SENTENCE_WORDS) & (plain_words >= SENTENCE_SHARE * words.count)
    sentence = stops & worded
    headline = ~stops & worded & (runs(words.number.astype(np.int64), words.line, n) == 0)
    pairs = np.sort((words.line.astype(np.uint64) << np.uint64(40)) | (mix(words.hash, 71) >> np.uint64(24)))
    first = np.diff(pairs, prepend=np.uint64(2**63)) != 0
    distinct = np.bincount((pairs[first] >> np.uint64(40)).astype(np.int64), minlength=n)
    # a sentence or a line of repeated words without a function word in it, or the same few words over and over
    bare = plain_words == 0
    strange = bare & stops & (words.count >= 4) & ((lower >= 0.6 * words.count) | (upper == words.count))
    again = (words.count >= 4) & (distinct <= words.count / 2) | bare & (words.count >= 6) & (distinct <= 0.8 * words.count)
    filler = strange | again
    related = runs(shared.astype(np.int64), words.line, n) > 0

    none = np.zeros(n, np.int64)
    b0, b1, bins, parity, k1, k2 = (none,) * 6
    if sketch:
        masked = np.where(words.name, _NAME, np.where(words.number, _NUMBER, words.hash))
        b0, b1, bins, parity = _sketches(words, words.hash, masked, n)
        k1, k2 = (k.view(np.int64) for k in line_keys(flat))
    hinted = runs(_OPENER[flat.cp].astype(np.int64), flat.line, n) > 0
    marked = np.zeros(n, bool)
    for i in np.flatnonzero(hinted):
        text = "".join(map(chr, flat.cp[flat.first[i] : flat.last[i] + 1]))
        marked[i] = bool(_PLACEHOLDER.search(text)) and not _QUOTED.match(text)
    flags = sentence * SENTENCE + marked * PLACEHOLDER + filler * FILLER + related * RELATED + listed * LISTED + headline * HEADLINE
    solid = np.flatnonzero(flat.size > 0)
    out = {
        "text": flat.text, "line_no": flat.number - 1, "flags": flags, "k1": k1, "k2": k2, "body": whole.view(np.int64),
        "opening": opening.view(np.int64), "lead": lead.view(np.int64), "b0": b0, "b1": b1, "bins": bins, "parity": parity,
    }
    return {k: v[solid] for k, v in out.items()}


def line_signs(pages: DataFrame, samples: DataFrame, sketch: bool = True) -> DataFrame:
    """A row of ``SCHEMA`` for every non-blank line of every page, the title as line 0.

    Without ``sketch``, k1, k2, b0, b1, bins and parity are 0; evidence of residue needs none of them.

    k1 and k2 are a 128-bit key of the folded text; ``body``, ``opening``
    and ``lead`` are keys of all words, the first and those before a separator (0 where no short lead is); b0 is a band of the words, and b1, bins and
    parity sketch them without names and numbers. The texts go no further than this scan.
    """
    shared = pages.sparkSession.sparkContext.broadcast(function_words(samples))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        small = {"line_no", "flags", "b0", "b1"}
        for batch in batches:
            for part in steps(batch, 4):
                hosts, urls, titles, texts = (part.column(name).to_pylist() for name in ("host", "url", "title", "summary"))
                found = signs_of(hosts, urls, titles, texts, shared.value, sketch)
                owner = pa.array(found["text"])
                columns = [part.column(name).take(owner) for name in ("id", "host", "url_hash")]
                columns += [pa.array(found[k].astype(np.int32 if k in small else np.int64)) for k in names[3:]]
                yield pa.RecordBatch.from_arrays(columns, names)

    texts = with_host(pages.where("id is not null")).select(
        "id", F.coalesce("host", F.lit("?")).alias("host"), "url", "title", "summary", F.xxhash64(F.coalesce("url", F.lit(""))).alias("url_hash")
    )
    return texts.mapInArrow(read, SCHEMA)
