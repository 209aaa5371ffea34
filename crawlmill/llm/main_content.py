"""Main body and furniture of pages: a bidirectional LSTM labels every line.

A page is a sequence of leaves, its non-blank lines. A leaf enters as the mean
of vectors of its hashed words and as a layout vector. Summaries keep no tags,
so the layout vector (marks, separators, shape, place, blank lines around,
words shared with the title) stands in for the tag path. The network reads the
whole page in both directions, so a headline within the article and the same
headline in a box of links get different labels.

Its training labels come from structure alone: how often a line, its masked words or
the words before its first separator recur, whether it is a sentence, an item of a
list, and on which side of the last sentence that recurs nowhere it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.llm.flat import Flat, steps
from crawlmill.llm.signs import HEADLINE, LISTED, SENTENCE
from crawlmill.session import cut

#: Pages the network is trained on at most, drawn at random, and lines a page may have to be drawn.
TRAINING_PAGES, TRAINING_LINES = 2_500, 400
#: Lines of the corpus from which on a text, its masked words or a lead recur.
RECURS = 5
EPOCHS = 5
BUCKETS, WORD_DIM, HIDDEN = 8192, 16, 24
SEED = 3

_MARKS = "·|»>/:©-—–+($&{};=…,.!?“«„\"'"
_LISTS = "-•*"


def _fold_table() -> np.ndarray:
    """Letters in lower case without marks, digits as 0, all else 0."""
    import unicodedata

    out = np.zeros(65536, np.uint16)
    for i in range(65536):
        c = chr(i)
        if c.isdigit():
            out[i] = ord("0")
        elif c.isalpha():
            low = unicodedata.normalize("NFD", c.lower())[0]
            out[i] = ord(low) if ord(low) < 65536 else ord("?")
    out[0xFFFF] = 0
    return out


FOLD = _fold_table()
UPPER = np.array([chr(i).isupper() for i in range(65536)])
DIGIT = FOLD == ord("0")
_POWERS = np.random.default_rng(SEED).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
MARK = np.zeros(65536, np.uint8)
for _i, _c in enumerate(_MARKS):
    MARK[ord(_c)] = _i + 1
LAYOUT = len(_MARKS) + 14


class Leaves:
    """Hashed words and layout vectors of the non-blank lines of a batch of pages."""

    def __init__(self, titles: list[str | None], texts: list[str | None]):
        flat = Flat(texts)
        leaf = np.cumsum(flat.size > 0) - 1
        solid = flat.size > 0
        self.flat, self.lines = flat, np.flatnonzero(solid)
        self.n, self.page = len(self.lines), flat.text[self.lines]
        of = np.where(solid, leaf, -1)[flat.line]
        hashes, owner, raised = self._words(flat.cp, of, flat.starts)
        names, name_owner, _ = self._title_words(titles)
        count = np.bincount(owner, minlength=self.n)
        # words shared with the page's title
        mix = np.uint64(0x9E3779B97F4A7C15)
        known = np.unique(names ^ (name_owner.astype(np.uint64) * mix))
        shared = np.isin(hashes ^ (self.page[owner].astype(np.uint64) * mix), known) if self.n else np.zeros(0, bool)
        share = np.bincount(owner, shared, self.n) / np.maximum(count, 1)
        title_words = np.bincount(name_owner, minlength=len(texts))[self.page] if self.n else np.zeros(0)
        caps = np.bincount(owner, raised, self.n) / np.maximum(count, 1)
        shouted = caps > 0.8
        is_name = raised & ~shouted[owner]
        first = np.zeros(len(owner), bool)
        first[np.flatnonzero(np.diff(owner, prepend=-1))] = True
        self.buckets = np.where(is_name & ~first, 0, 1 + (hashes >> np.uint64(20)) % np.uint64(BUCKETS - 1)).astype(np.int32)
        self.owner, self.count = owner, count
        self.layout = self._layout(flat, of, count, share, title_words, caps)

    @staticmethod
    def _words(cp: np.ndarray, of: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = FOLD[cp]
        word = low > 0
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        at = np.flatnonzero(begin)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        chars = np.flatnonzero(word)
        index = np.cumsum(begin)[chars] - 1
        power = _POWERS[np.minimum(chars - at[index], 63)]
        with np.errstate(over="ignore"):
            value = low[chars].astype(np.uint64) * power
            hashes = np.add.reduceat(value, np.flatnonzero(begin[chars]))
            hashes ^= hashes >> np.uint64(31)
            hashes = hashes * np.uint64(0xBF58476D1CE4E5B9)
        return hashes, of[at], UPPER[cp[at]]

    def _title_words(self, titles: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = Flat([(t or "").replace("\n", " ") for t in titles])
        return self._words(flat.cp, flat.text[flat.line], flat.starts)

    def _layout(self, flat: Flat, of, count, share, title_words, caps) -> np.ndarray:
        n, out = self.n, np.zeros((self.n, LAYOUT), np.float32)
        if not n:
            return out
        size = flat.size[self.lines]
        marks = MARK[flat.cp]
        at = np.flatnonzero((marks > 0) & (of >= 0))
        counted = np.bincount(of[at] * len(_MARKS) + marks[at] - 1, minlength=n * len(_MARKS)).reshape(n, -1)
        k = len(_MARKS)
        out[:, :k] = np.minimum(counted, 4) / 2
        head, tail = flat.cp[flat.first[self.lines]], flat.cp[flat.last[self.lines]]
        digits = np.bincount(of[np.flatnonzero(DIGIT[flat.cp] & (of >= 0))], minlength=n)
        place = np.arange(n) - np.searchsorted(self.page, self.page)
        total = np.bincount(self.page, minlength=self.page.max() + 1)[self.page]
        number = flat.number[self.lines]
        gap = np.diff(number, prepend=0) > 1
        wide = flat.cp == 32
        wide[1:] &= wide[:-1]
        out[:, k:] = np.stack(
            [
                np.log1p(size) / 3, np.log1p(count) / 2, share, caps,
                np.isin(head, [ord(c) for c in _LISTS]), np.isin(tail, [ord(c) for c in ".!?…”»\""]),
                tail == ord("."), digits / np.maximum(size, 1), UPPER[head],
                place == 0, np.exp(-place / 3), np.exp(-(total - 1 - place) / 3),
                gap, np.minimum(np.bincount(of[wide & (of >= 0)], minlength=n), 4) / 4 + (share > 0.6) * (title_words > 2),
            ], 1,
        )
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Word vectors, two LSTMs and a logistic output, in numpy."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            g = np.random.default_rng(SEED)
            d, h = WORD_DIM + LAYOUT, HIDDEN
            weights = {"E": g.normal(0, 0.3, (BUCKETS, WORD_DIM)), "O": g.normal(0, 0.2, (2 * h + d,)), "o": np.zeros(1)}
            for s in "fb":
                weights |= {f"W{s}": g.normal(0, d**-0.5, (d, 4 * h)), f"U{s}": g.normal(0, h**-0.5, (h, 4 * h))}
                weights[f"c{s}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
            weights = {k: v.astype(np.float32) for k, v in weights.items()}
        self.w = weights

    def inputs(self, x: Leaves) -> np.ndarray:
        words = np.zeros((x.n, WORD_DIM), np.float32)
        if len(x.owner):
            starts = np.flatnonzero(np.diff(x.owner, prepend=-1))
            words[x.owner[starts]] = np.add.reduceat(self.w["E"][x.buckets], starts)
        return np.concatenate([words / np.maximum(x.count, 1)[:, None], x.layout], 1)

    def _run(self, z: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool):
        """LSTM over (time, batch, 4h) inputs; padded steps leave the state as it is."""
        t, b, h = z.shape[0], z.shape[1], HIDDEN
        hs, state, cell, saved = np.zeros((t, b, h), np.float32), np.zeros((b, h), np.float32), np.zeros((b, h), np.float32), []
        for i in range(t):
            a = z[i] + state @ u
            gates = _sigmoid(a[:, : 3 * h])
            new = np.tanh(a[:, 3 * h :])
            c = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            tc = np.tanh(c)
            m = mask[i][:, None]
            if keep:
                saved.append((gates, new, cell, tc, state))
            state = np.where(m, gates[:, 2 * h :] * tc, state)
            cell = np.where(m, c, cell)
            hs[i] = state
        return hs, saved

    def _grid(self, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, page) grid of leaf indices and its mask, for consecutive pages."""
        ids, start, count = np.unique(page, return_index=True, return_counts=True)
        t = np.arange(count.max())[:, None]
        mask = t < count
        return np.where(mask, start + t, 0), mask

    def forward(self, x: np.ndarray, page: np.ndarray, keep: bool = False):
        grid, mask = self._grid(page)
        hs, parts = np.zeros((len(x), 2 * HIDDEN), np.float32), []
        for k, s in enumerate("fb"):
            z = x @ self.w[f"W{s}"] + self.w[f"c{s}"]
            g, m = (grid, mask) if s == "f" else (grid[::-1], mask[::-1])
            out, saved = self._run(z[g], self.w[f"U{s}"], m, keep)
            hs[g[m], k * HIDDEN : (k + 1) * HIDDEN] = out[m]
            parts.append((g, m, saved))
        full = np.concatenate([hs, x], 1)
        return full @ self.w["O"] + self.w["o"][0], full, parts

    def scores(self, leaves: Leaves) -> np.ndarray:
        """Log-odds of furniture for each leaf; pages of like length run together."""
        if not leaves.n:
            return np.zeros(0, np.float32)
        x, out = self.inputs(leaves), np.zeros(leaves.n, np.float32)
        ids, start, count = np.unique(leaves.page, return_index=True, return_counts=True)
        order = np.argsort(count, kind="stable")
        for i in range(0, len(order), 256):
            some = order[i : i + 256]
            at = np.concatenate([np.arange(start[j], start[j] + count[j]) for j in some])
            out[at] = self.forward(x[at], np.repeat(np.arange(len(some)), count[some]))[0]
        return out

    def _backward(self, x: np.ndarray, d_out: np.ndarray, full: np.ndarray, parts: list) -> tuple[dict, np.ndarray]:
        h, grads = HIDDEN, {"O": full.T @ d_out, "o": np.array([d_out.sum()], np.float32)}
        d_full = d_out[:, None] * self.w["O"]
        dx = d_full[:, 2 * h :].copy()
        for k, s in enumerate("fb"):
            g, m, saved = parts[k]
            u = self.w[f"U{s}"]
            dz, du = np.zeros((len(x), 4 * h), np.float32), np.zeros_like(u)
            dh_next = np.zeros((g.shape[1], h), np.float32)
            dc_next = np.zeros_like(dh_next)
            for i in range(len(g) - 1, -1, -1):
                gates, new, cell, tc, state = saved[i]
                mm = m[i][:, None]
                dh = np.where(mm, d_full[g[i], k * h : (k + 1) * h], 0) + dh_next
                o, f, a = gates[:, 2 * h :], gates[:, h : 2 * h], gates[:, :h]
                dc = dc_next + dh * o * (1 - tc * tc)
                da = np.concatenate(
                    [dc * new * a * (1 - a), dc * cell * f * (1 - f), dh * tc * o * (1 - o), dc * a * (1 - new * new)], 1
                )
                da = np.where(mm, da, 0)
                dz[g[i][m[i]]] = da[m[i]]
                du += state.T @ da
                dh_next = np.where(mm, da @ u.T, dh_next)
                dc_next = np.where(mm, dc * f, dc_next)
            grads |= {f"W{s}": x.T @ dz, f"U{s}": du, f"c{s}": dz.sum(0)}
            dx += dz @ self.w[f"W{s}"].T
        return grads, dx

    def fit(self, titles: list[str | None], texts: list[str], labels: list[np.ndarray], epochs: int = EPOCHS, size: int = 48) -> "BlockLabeller":
        """``labels`` holds 1, 0 or, where nothing is known, -1 for every non-blank line of each text."""
        g, moments, step = np.random.default_rng(SEED), {}, 0
        for _ in range(epochs):
            order = g.permutation(len(texts))
            for i in range(0, len(order), size):
                some = order[i : i + size]
                leaves = Leaves([titles[j] for j in some], [texts[j] for j in some])
                y = np.concatenate([labels[j] for j in some]).astype(np.float32)
                sure = y >= 0
                if not sure.any():
                    continue
                x = self.inputs(leaves)
                page = np.unique(leaves.page, return_inverse=True)[1]
                out, full, parts = self.forward(x, page, True)
                grads, dx = self._backward(x, (np.where(sure, _sigmoid(out) - y, 0) / sure.sum()).astype(np.float32), full, parts)
                de = np.zeros_like(self.w["E"])
                np.add.at(de, leaves.buckets, (dx[:, :WORD_DIM] / np.maximum(leaves.count, 1)[:, None])[leaves.owner])
                grads["E"] = de
                step += 1
                for k, d in grads.items():
                    m, v = moments.setdefault(k, [np.zeros_like(self.w[k]), np.zeros_like(self.w[k])])
                    m += 0.1 * (d - m)
                    v += 0.01 * (d * d - v)
                    rate = 0.01 * (0.3 if _ >= epochs - 2 else 1)
                    self.w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self


#: Weights by the fingerprint of what they were fitted on; each is below 1 MB.
_FITTED: dict[int, BlockLabeller] = {}


def structural_labels(lines: DataFrame, drawn: DataFrame) -> DataFrame:
    """(id, line_no, label) of the non-blank lines of the pages ``drawn`` (id), from ``line_signs`` of all pages.

    1 is furniture, 0 main body, -1 unknown. Recurrence is counted over all lines.
    A sentence whose words recur nowhere is main, a text that recurs on its host or on
    several is furniture, as is a line whose masked words or short lead recur and are
    no sentence. What is left is main in a list or before the last such sentence; a
    headline behind it is furniture, and all else unknown.
    """
    body = lines.where("line_no > 0")
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.xxhash64("host", "k1", "k2").alias("key")),
        F.struct(F.lit(1).alias("kind"), F.col("body").alias("key")),
        F.struct(F.lit(2).alias("kind"), F.col("b1").cast("long").alias("key")),
        F.struct(F.lit(3).alias("kind"), F.col("lead").alias("key")),
    )
    told = (F.col("flags").bitwiseAND(SENTENCE) != 0).cast("int").alias("told")
    own = cut(body.join(drawn, "id", "left_semi").select("id", "line_no", "host", "flags", F.explode(kinds).alias("x")).select("id", "line_no", "flags", "x.*"))
    asked = cut(own.select("kind", "key").distinct())
    spread = body.select("host", told, F.explode(kinds).alias("x")).select("host", "told", "x.*").where("kind < 3 or key <> 0")
    # at most four keys of each line drawn
    counts = spread.join(F.broadcast(asked), ["kind", "key"], "left_semi").groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("n"), F.avg("told").alias("told"), (F.min("host") != F.max("host")).alias("hosts")
    )
    often = F.col("n") >= RECURS
    per_kind = [F.max(F.when(F.col("kind") == i, x)).alias(n) for i, n, x in (
        (0, "on_host", often), (1, "anywhere", often & F.col("hosts")), (2, "masked", often & (F.col("told") < 0.1)), (3, "led", often & (F.col("told") < 0.1)),
    )]
    seen = own.join(counts, ["kind", "key"], "left").groupBy("id", "line_no").agg(F.first("flags").alias("flags"), *[F.coalesce(x, F.lit(False)).alias(n) for x, n in zip(per_kind, ("on_host", "anywhere", "masked", "led"))])
    has = lambda flag: F.col("flags").bitwiseAND(flag) != 0
    again = F.col("on_host") | F.col("anywhere")
    last = F.max(F.when(has(SENTENCE) & ~again, F.col("line_no"))).over(Window.partitionBy("id"))  # a page drawn has few lines
    rest = F.when(F.col("line_no") < last, 0).when((F.col("line_no") > last) & has(HEADLINE), 1).otherwise(-1)
    label = (
        F.when(again, 1).when(has(SENTENCE), 0).when(has(LISTED), 0).when(F.col("masked") | F.col("led"), 1).otherwise(rest)
    )
    return seen.select("id", "line_no", label.alias("label"))


def fit_labeller(pages: DataFrame, lines: DataFrame) -> BlockLabeller:
    """A labeller trained on at most ``TRAINING_PAGES`` pages of at most ``TRAINING_LINES`` lines, drawn at random, with ``structural_labels``.

    A second call with the same drawn pages and labels gives the weights of the first.
    """
    short = pages.where((F.size(F.split("summary", "\n")) <= TRAINING_LINES) & (F.trim("summary") != "")).select("id", "title", "summary")
    share = min(1.0, 1.1 * TRAINING_PAGES / max(1, pages.count()))
    drawn = cut(short.sample(share, SEED).limit(TRAINING_PAGES))
    rows = drawn.orderBy("id").collect()
    labels: dict[int, list] = {}
    for i, _, label in structural_labels(lines, F.broadcast(drawn.select("id"))).orderBy("id", "line_no").collect():
        labels.setdefault(i, []).append(label)
    # repeated ids would give each other's lines
    kept = [r for r in rows if sum(bool(x) for x in Flat([r.summary]).size) == len(labels.get(r.id, []))]
    mark = hash(tuple((r.title, r.summary, tuple(labels[r.id])) for r in kept))
    if mark not in _FITTED:
        _FITTED[mark] = BlockLabeller().fit([r.title for r in kept], [r.summary for r in kept], [np.array(labels[r.id]) for r in kept])
    return _FITTED[mark]


def _labelled(labeller: BlockLabeller, rows, schema: str, give):
    shared = rows.sparkSession.sparkContext.broadcast(labeller.w)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BlockLabeller(shared.value)
        for batch in batches:
            for part in steps(batch, 2):
                ids, titles, texts = part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist()
                leaves = Leaves(titles, texts)
                yield give(ids, texts, leaves, _sigmoid(own.scores(leaves)).astype(np.float32))

    return rows.select("id", "title", "summary").mapInArrow(label, schema)


def label_blocks(pages: DataFrame, labeller: BlockLabeller) -> DataFrame:
    """(id, line_no, furniture) for every non-blank line; ``furniture`` is its probability.

    Pages with a null or blank summary have no line. Pages are read whole,
    however long. The weights that are broadcast have a fixed size, below 1 MB.
    """

    def give(ids: pa.Array, texts: list, leaves: Leaves, odds: np.ndarray) -> pa.RecordBatch:
        number = pa.array(leaves.flat.number[leaves.lines].astype(np.int32))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(leaves.page)), number, pa.array(odds)], ["id", "line_no", "furniture"])

    return _labelled(labeller, pages.where("id is not null and summary is not null"), "id long, line_no int, furniture float", give)


def main_text(pages: DataFrame, labeller: BlockLabeller, least: float = 0.5) -> DataFrame:
    """(id, main_text): summaries without the lines whose probability to be furniture is ``least`` or more, in the scan that labels them; null stays null."""

    def give(ids: pa.Array, texts: list, leaves: Leaves, odds: np.ndarray) -> pa.RecordBatch:
        gone = np.zeros(leaves.flat.n, bool)
        gone[leaves.lines[odds >= least]] = True
        start = np.searchsorted(leaves.flat.text, np.arange(len(texts)))
        kept = [t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if not gone[start[i] + j]) for i, t in enumerate(texts)]
        return pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.string())], ["id", "main_text"])

    return _labelled(labeller, pages, "id long, main_text string", give)
