"""The lines of a batch of texts as flat arrays of code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BREAK = "\x1e"
#: Characters and texts that are worked on at once; a longer text is a step of its own.
STEP_CHARS, STEP_TEXTS = 2_000_000, 1_000


def steps(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts, in column ``text``, fit a step, so memory follows the step and not the batch."""
    start = size = 0
    for i, length in enumerate(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()):
        if i > start and (size + length > STEP_CHARS or i - start >= STEP_TEXTS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length
    if start < batch.num_rows:
        yield batch.slice(start)
#: White space, as code points below 0x10000.
SPACES = np.zeros(65536, bool)
SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


class Flat:
    """Texts of a batch joined, each line with its text's index and its number from 1.

    ``cp`` holds code points (those from 0x10000 on become 0xFFFF), ``line`` the
    line of each; every line begins with the break before it. ``first`` and
    ``last`` are the places of a line's outermost non-blank characters, ``size``
    the length between them, 0 for a blank line. Null texts count as empty.
    """

    def __init__(self, texts: list[str | None]):
        joined = _BREAK + _BREAK.join((t or "").replace(_BREAK, " ") for t in texts)
        raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        self.cp = np.minimum(raw, 0xFFFF).astype(np.uint16)
        page = self.cp == ord(_BREAK)
        breaks = page | (self.cp == 10)
        self.line = np.cumsum(breaks) - 1
        self.starts = np.flatnonzero(breaks)
        self.n = len(self.starts)
        at = page[self.starts]
        self.text = np.cumsum(at) - 1
        first_line = np.flatnonzero(at)
        self.number = np.arange(self.n) - first_line[self.text] + 1
        solid = np.flatnonzero(~SPACES[self.cp])
        owner = self.line[solid]
        lo, hi = np.searchsorted(owner, np.arange(self.n)), np.searchsorted(owner, np.arange(self.n), "right")
        some = hi > lo
        solid = np.append(solid, 0)
        self.first, self.last = np.where(some, solid[np.minimum(lo, len(solid) - 1)], 0), np.where(some, solid[hi - 1], -1)
        self.size = np.where(some, self.last - self.first + 1, 0)
