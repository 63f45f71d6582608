"""Dot products of bags of tokens, block by block, for Arrow functions.

A bag is packed once per article: the sorted 64-bit hashes of its tokens and their
counts.  Products of two blocks are one dense matrix product over the tokens that are
most frequent in the second block, and sums over postings for all others, so no row
per pair and token is ever made.  All sums are whole numbers, and exact: in single
precision where norms bound them below 2^24, else in double precision.  Tokens are
told apart by their hashes: of n tokens two share one with probability n^2 / 2^65, for
ten million below 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

HEAD = 1024  # tokens that have columns of their own
CHUNK = 256  # articles of the first block at a time
POSTINGS = 1 << 20  # products outside the head at a time
PIECE = 1000  # articles that are packed at a time
_EXACT = 2**24


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """symbol, day, doc, tokens (hashes) -> symbol, day, doc, bag."""
    for batch in batches:
        for at in range(0, len(batch), PIECE):
            part = batch.slice(at, PIECE)
            lists = part.column(3)
            token = lists.flatten().to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            owner, token, count = _counted(np.repeat(np.arange(len(part)), size), token, np.ones(len(token), np.int64))
            cut = np.searchsorted(owner, np.arange(len(part) + 1))
            bags = [_packed(token[a:b], count[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(bags, pa.binary())], ["symbol", "day", "doc", "bag"])


def _counted(owner: np.ndarray, token: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((token, owner))
    owner, token, count = owner[order], token[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])])[: len(owner)])
    return owner[first], token[first], np.add.reduceat(count, first) if len(first) else count


def _packed(token: np.ndarray, count: np.ndarray) -> bytes:
    """Hashes, counts of 1 or 4 bytes, and their width as the last byte."""
    width = 1 if not len(count) or count.max() < 256 else 4
    return token.tobytes() + count.astype(f"u{width}").tobytes() + bytes([width])


def _unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(bag) - 1) // (8 + bag[-1])
    return np.frombuffer(bag, np.int64, n), np.frombuffer(bag, f"u{bag[-1]}", n, 8 * n)


def _business_number(day: np.ndarray) -> np.ndarray:
    """Business days up to ``day`` (days since 1970); differences are ``times.business_days``."""
    since = day - 4
    return 5 * (since // 7) + np.minimum(since % 7, 5)


class Block:
    """Articles in the order of day and doc, and the entries of their bags."""

    def __init__(self, day, doc, owner, token, count):
        self.day, self.doc, self.owner, self.token, self.count = day, doc, owner, token, count
        self.number = _business_number(day)
        self.norm = np.sqrt(np.bincount(owner, count.astype(float) ** 2, len(day)))

    @classmethod
    def of(cls, day: np.ndarray, doc: np.ndarray, bags: list[bytes]) -> Block:
        """Neighbours of equal day and doc are one article with all their tokens."""
        new = np.concatenate([[True], (day[1:] != day[:-1]) | (doc[1:] != doc[:-1])])
        new = new[: len(day)]
        both = [_unpacked(b) for b in bags]
        owner = np.repeat(np.cumsum(new) - 1, [len(t) for t, _ in both])
        token, count = np.concatenate([t for t, _ in both]), np.concatenate([c.astype(np.int64) for _, c in both])
        if not new.all():
            owner, token, count = _counted(owner, token, count)
        return cls(day[new], doc[new], owner, token, count)

    @classmethod
    def joined(cls, blocks: list[Block]) -> Block:
        at = np.cumsum([0, *[len(b) for b in blocks]])
        owner = np.concatenate([b.owner + k for b, k in zip(blocks, at)])
        return cls(*[np.concatenate([getattr(b, f) for b in blocks]) for f in ("day", "doc")], owner, *[np.concatenate([getattr(b, f) for b in blocks]) for f in ("token", "count")])

    def __len__(self) -> int:
        return len(self.day)

    def take(self, rows: np.ndarray) -> Block:
        """The articles where ``rows`` is true."""
        own = rows[self.owner]
        return Block(self.day[rows], self.doc[rows], (np.cumsum(rows) - 1)[self.owner[own]], self.token[own], self.count[own])

    def index(self) -> Block:
        """Make ready to be the second block of products."""
        tokens, n = np.unique(self.token, return_counts=True)
        self.head = np.sort(tokens[np.argsort(-n, kind="stable")[:HEAD]])
        place, hit = self._head(self)
        self.dense = np.zeros((len(self), len(self.head)), np.float32)
        self.dense[self.owner[hit], place] = self.count[hit]
        token, owner, count = self.token[~hit], self.owner[~hit], self.count[~hit]
        order = np.lexsort((owner, token))
        self.rest, self.rest_owner, self.rest_count = token[order], owner[order], count[order]
        return self

    def only_index(self) -> Block:
        """Without the entries, once only products are of use."""
        self.owner = self.token = self.count = None
        return self

    def _head(self, x: Block) -> tuple[np.ndarray, np.ndarray]:
        """The columns of those of x's entries that have one, and which these are."""
        if not len(self.head):
            return np.zeros(0, np.int64), np.zeros(len(x.token), bool)
        place = np.minimum(np.searchsorted(self.head, x.token), len(self.head) - 1)
        hit = self.head[place] == x.token
        return place[hit], hit

    def products(self, x: Block, low: int, high: int) -> np.ndarray:
        """Of all articles of ``x`` with this block's from ``low`` up to ``high``."""
        most = x.norm.max(initial=0) * self.norm[low:high].max(initial=0)
        kind = np.float32 if most < _EXACT else np.float64
        place, hit = self._head(x)
        dense = np.zeros((len(x), len(self.head)), kind)
        dense[x.owner[hit], place] = x.count[hit]
        out = dense @ self.dense[low:high].astype(kind, copy=False).T
        token, owner, count = x.token[~hit], x.owner[~hit], x.count[~hit]
        start = np.searchsorted(self.rest, token)
        n = np.searchsorted(self.rest, token, "right") - start
        owner, count, start, n = (a[n > 0] for a in (owner, count, start, n))
        ends = np.cumsum(n)
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(POSTINGS, n.sum(), POSTINGS)), len(n)])
        for k in (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])):
            at = np.repeat(start[k] - (np.cumsum(n[k]) - n[k]), n[k]) + np.arange(n[k].sum())
            other = self.rest_owner[at]
            own = (other >= low) & (other < high)
            where = np.repeat(owner[k], n[k])[own] * (high - low) + other[own] - low
            np.add.at(out.reshape(-1), where, (np.repeat(count[k], n[k])[own] * self.rest_count[at[own]]).astype(kind))
        return out

    def similar(self, x: Block, threshold: float, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Articles of ``x``, later ones of this block within ``window`` business days, and their cosines of at least ``threshold``."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(x) or not len(self):
            return none
        # Days are in order, so those that can matter lie side by side.
        low, high = np.searchsorted(self.day, x.day[0]), np.searchsorted(self.number, x.number[-1] + window, "right")
        if low >= high:
            return none
        out = self.products(x, low, high)
        least = np.outer((x.norm * (threshold * (1 - 1e-5))).astype(out.dtype), self.norm[low:high].astype(out.dtype))
        i, j = np.divmod(np.flatnonzero((out >= least) & (out > 0)), high - low)
        dot, j = out[i, j].astype(float), j + low
        cosine = dot / (x.norm[i] * self.norm[j])
        gap, later = self.number[j] - x.number[i], self.day[j] - x.day[i]
        good = (cosine >= threshold) & (gap <= window) & ((later > 0) | (later == 0) & (self.doc[j] > x.doc[i]))
        return i[good], j[good], cosine[good]


def chunks(batches: Iterator[pa.RecordBatch], groups: list[str], size: int = CHUNK) -> Iterator[tuple[tuple, Block]]:
    """Rows sorted by ``groups``, day and doc as blocks of at most ``size`` articles of one group; rows of an article stay together."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        held = yield from _cut(table.to_batches()[0], groups, size, False)
    if held is not None:
        yield from _cut(held, groups, size, True)


def _cut(rows: pa.RecordBatch, groups: list[str], size: int, to_end: bool):
    columns = [rows.column(g).dictionary_encode().indices.to_numpy() for g in groups]
    day, doc = rows.column("day").cast(pa.int32()).to_numpy().astype(np.int64), rows.column("doc").to_numpy()
    change = lambda *cs: np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cs], axis=0)])
    group, article = change(*columns), np.flatnonzero(change(*columns, day, doc))
    end = len(rows) if to_end else article[-1]
    article = article[article < end]
    opening = group[article]
    since = np.arange(len(article)) - np.maximum.accumulate(np.where(opening, np.arange(len(article)), 0))
    cuts = [*article[since % size == 0], end]
    for a, b in zip(cuts[:-1], cuts[1:]):
        key = tuple(rows.column(g)[int(a)].as_py() for g in groups)
        yield key, Block.of(day[a:b], doc[a:b], rows.column("bag").slice(a, b - a).to_pylist())
    return None if to_end else rows.slice(end)
