"""Token ids of whole texts by a public byte-level BPE.

Encoding is a reduction over a tree: a long text is cut in halves down to
leaves, leaves are encoded by the public tokenizer, and neighbours are joined.
A join keeps what both sides have but for a window around the seam, which is
encoded anew. The window grows until it begins and ends where a letter or digit
is followed by white space. No pre-token holds white space after anything else,
so each text with that place in it is split there, whatever stands beyond: ids
outside the window cannot change. Texts beyond ``SPREAD`` characters are cut into
rows first, encoded all over the cluster and joined by the same rule.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.llm.flat import steps

#: Folder of the tokenizers' files; a parameter, as they are not part of this library.
TOKENIZERS = os.environ.get("CRAWLMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary splits texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a leaf, and of a row of a text that is spread over rows.
LEAF = 4_096
SPREAD = 1 << 20
WINDOW = 32

_ENCODERS: dict[int, "Encoder"] = {}


class Encoder:
    """The public tokenizer and the bytes of each of its ids."""

    def __init__(self, ranks_file: bytes):
        import tiktoken

        pairs = (line.split() for line in ranks_file.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.leaf = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = {rank: token for token, rank in ranks.items()}

    @classmethod
    def of(cls, ranks_file: bytes) -> "Encoder":
        """The encoder of a vocabulary, made once in a process."""
        key = hash(ranks_file)
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(ranks_file)
        return _ENCODERS[key]

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left, leaf), right, self.encode(right, leaf))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of ``left + right`` from those of both."""
        p, q = self._before(left), self._after(right)
        window = self.leaf(left[p:] + right[:q])
        return left_ids[: self._count(left_ids[::-1], left[p:], len(left_ids))] + window + right_ids[len(right_ids) - self._count(right_ids, right[:q], len(right_ids)) :]

    def _count(self, ids: list[int], part: str, n: int) -> int:
        """How many of ``n`` ids stay when those that cover ``part``, first in ``ids``, go."""
        size, i = len(part.encode()), 0
        while size > 0:
            size -= len(self.bytes[ids[i]])
            i += 1
        if size:
            raise ValueError("an id crosses a place where texts split")
        return n - i

    @staticmethod
    def _stable(text: str, i: int) -> bool:
        return text[i] in " \n" and text[i - 1].isalnum()

    def _before(self, text: str) -> int:
        """Last stable place of ``text``, looked for in growing windows; 0 if there is none."""
        end, size = len(text), WINDOW
        while True:
            start = max(1, len(text) - size)
            for i in range(end - 1, start - 1, -1):
                if self._stable(text, i):
                    return i
            if start == 1:
                return 0
            end, size = start, size * 2

    def _after(self, text: str) -> int:
        """First stable place of ``text``; its length if there is none."""
        start, size = 1, WINDOW
        while start < len(text):
            end = min(len(text), start + size)
            for i in range(start, end):
                if self._stable(text, i):
                    return i
            start, size = end, size * 2
        return len(text)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def _id_lists(ids: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _encoded(docs: DataFrame, keys: list[str], ranks, ids_only: bool = True) -> DataFrame:
    """``docs`` (keys..., text) with ``ids`` of each text; null and empty texts have the empty list."""
    types = dict(docs.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ("" if ids_only else ", text string") + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks.value)
        for batch in batches:
            for part in steps(batch, len(keys)):
                texts = part.column(len(keys)).to_pylist()
                kept = [part.column(j) for j in range(len(keys) + (not ids_only))]
                ids = _id_lists([encoder.encode(t) if t else [] for t in texts])
                yield pa.RecordBatch.from_arrays([*kept, ids], [*keys, *([] if ids_only else ["text"]), "ids"])

    return docs.select(*keys, "text").mapInArrow(run, schema)


def token_ids(docs: DataFrame, ranks_file: bytes | None = None, spread: int = SPREAD) -> DataFrame:
    """(doc_id, ids): ids of every document, null and empty texts with the empty list.

    One row per row of ``docs`` (doc_id, text), repeated ones too.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_file or vocabulary())
    size = F.coalesce(F.length("text"), F.lit(0))
    short = _encoded(docs.where(size <= spread), ["doc_id"], ranks)
    parts = F.transform(
        F.sequence(F.lit(0), ((F.length("text") - 1) / spread).cast("int")),
        lambda i: F.col("text").substr(i * spread + 1, F.lit(spread)),
    )
    rows = docs.where(size > spread).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    cut_up = rows.select("doc_id", "row", F.posexplode(parts).alias("part", "text"))
    pieces = _encoded(cut_up.repartition("row", "part"), ["doc_id", "row", "part"], ranks, False)

    def reduce(table: pa.Table) -> pa.Table:
        encoder = Encoder.of(ranks.value)
        level = [(r["text"], r["ids"]) for r in table.sort_by("part").to_pylist()]
        while len(level) > 1:
            pairs = [(a[0] + b[0], encoder.join(*a, *b)) for a, b in zip(level[::2], level[1::2])]
            level = pairs + level[len(pairs) * 2 :]
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": _id_lists([level[0][1]])})

    return short.unionByName(pieces.groupBy("row").applyInArrow(reduce, "doc_id long, ids array<int>"))


def token_counts(docs: DataFrame, ranks_file: bytes | None = None) -> DataFrame:
    """(doc_id, tokens) of every document."""
    return token_ids(docs, ranks_file).select("doc_id", F.size("ids").alias("tokens"))
