"""Suffix-array deduplication by a depth-limited radix sort.

Suffixes are ordered only through ``threshold`` bytes, by most-significant-digit
passes of eight bytes each; groups that are equal after the last pass are exactly
the repeated windows. A window's bytes are removed if it also starts in a
document with a smaller id.

Sorting all suffixes of a corpus over the network would move fifty times the
text. The leading digit is therefore one that all equal windows share and few
windows need: the hash of the window's minimiser, the byte 20-gram with the
smallest hash inside it. A run of windows has one minimiser, so

1. blocks of documents ask, for each distinct minimiser (6 bytes for some 17
   bytes of text), whether another document has it too;
2. for those that do, a block sends each distinct run of bytes around one, with
   the smallest id that has it in the block, to the minimiser's bucket. There
   the suffixes of all runs are radix-sorted, and the smallest id of each equal
   group goes back to the blocks that sent it;
3. blocks mark the windows whose smallest id is less than the document's.

A string that a third of all documents share is sent once a block. Windows are
compared by their bytes; runs of windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import textkit as K

THRESHOLD = 50
GRAM = 20
_NO_ID = np.iinfo(np.int64).max
_LOCAL = 1 << 17
#: Bits of a place in a piece: a text has under 2**31 bytes.
_PLACE_BITS = 31


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: its 48-bit hash, row, first window, number of windows."""
    none = np.zeros(0, np.int64)
    reach = threshold - gram + 1
    if len(buf) < threshold:
        return none.astype(np.uint64), none, none, none
    up, down = K.powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    m = len(buf) - gram + 1
    h = K.mix64((total[gram:] - total[:m]) * down[:m])
    # the smallest hash, of equal ones the leftmost: places stand in the low bits
    key = (h & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(m, dtype=np.uint64)
    size = 1
    while size * 2 <= reach:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < reach:
        key = np.minimum(key[: len(key) - (reach - size)], key[reach - size :])
    place = (key & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    room = np.maximum(ends - starts - threshold + 1, 0)
    row = np.repeat(np.arange(len(starts)), room)
    if not len(row):
        return none.astype(np.uint64), none, none, none
    at = starts[row] + np.arange(len(row)) - (np.cumsum(room) - room)[row]
    place = place[at]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    # minimisers are small hashes: mixed again, they spread evenly over the buckets
    return K.mix64(h[place[new]] ^ np.uint64(K.BASE)) >> np.uint64(16), row[new], at[new], np.diff(np.r_[new, len(row)])


def _runs(text: pa.Array, threshold: int, gram: int):
    for i, j, buf, starts, ends in K.pieces(text, _LOCAL):
        yield i, j, buf, starts, ends, *anchors(buf, starts, ends, threshold, gram)


def _block_anchors(text: pa.Array, threshold: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct minimisers of a block in order, and which of them several of its rows have."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, _, _, _, _, h, row, _, _ in _runs(text, threshold, gram):
        hashes.append(h)
        rows.append(row + i)
    h, row = np.concatenate(hashes), np.concatenate(rows)
    if not len(h):  # only texts under the threshold
        return h, np.zeros(0, bool)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    last = np.r_[first[1:], len(h)] - 1
    return h[first], row[first] != row[last]


def _sizes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """How many of the sorted keys each bucket has; buckets are equal ranges of the 48-bit hashes."""
    return np.diff(np.r_[np.searchsorted(keys, np.array([i * (1 << 48) // buckets for i in range(buckets)], np.uint64)), len(keys)])


def shared_anchors(columns: list[X.Column]) -> list[X.Column]:
    """A bucket's answers: for each minimiser asked, whether several documents have it."""
    (hi, sizes), (lo, _), (several, _) = columns
    keys = hi.astype(np.uint64) << np.uint64(16) | lo
    unique, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    many = n > 1
    many[back[several > 0]] = True
    return [(many[back].astype(np.uint8), sizes)]


#: Suffixes that the passes after the first take at once.
_CHUNK = 1 << 18


def radix_groups(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """A number for each suffix of ``data`` that starts at ``at``: equal for those that agree through ``depth`` bytes.

    Most significant digit first, eight bytes a pass. The first pass orders all;
    the later ones take one range of first digits after the other, and a suffix
    whose group has shrunk to itself takes no part in them.
    """
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    digits = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded.data, strides=(1,))

    def digit(rows: np.ndarray, d: int) -> np.ndarray:
        out = digits[at[rows] + d].astype(np.uint64)
        return out >> np.uint64(8 * (8 - (depth - d))) if depth - d < 8 else out

    group = np.zeros(len(at), np.int64)
    if not len(at):
        return group
    lead = digit(np.arange(len(at)), 0)
    order = np.argsort(lead)
    lead = lead[order]
    new = np.r_[True, lead[1:] != lead[:-1]]
    del lead
    group[order] = np.cumsum(new) - 1
    fresh = int(group[order[-1]]) + 1
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(order)])
    order = order[np.repeat(size > 1, size)]
    ends = np.cumsum(size[size > 1])
    lo = 0
    while lo < len(order):
        hi = int(ends[min(len(ends) - 1, int(np.searchsorted(ends, lo + _CHUNK)))])
        active = order[lo:hi]
        lo = hi
        for d in range(8, depth, 8):
            if not len(active):
                break
            own, key = group[active], digit(active, d)
            place = np.lexsort((key, own))
            active, own, key = active[place], own[place], key[place]
            new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
            name = np.cumsum(new) - 1
            group[active] = name + fresh
            fresh += int(name[-1]) + 1
            active = active[np.bincount(name)[name] > 1]
    return group


#: First digits are dealt to so many parts, which are ordered one after the other: a bound on working memory.
_PARTS = 8


def first_owners(data: np.ndarray, at: np.ndarray, windows: np.ndarray, owner: np.ndarray, threshold: int) -> np.ndarray:
    """For every window of some runs of bytes, the smallest owner of a run that has it too."""
    run = np.repeat(np.arange(len(at), dtype=np.int32), windows)
    kind = np.int32 if max(len(data), len(run)) < 1 << 31 else np.int64
    place = (at - np.cumsum(windows) + windows).astype(kind)[run] + np.arange(len(run), dtype=kind)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lead = np.ndarray((len(padded) - 7,), dtype=np.uint64, buffer=padded.data, strides=(1,))[place]
    lead *= np.uint64(K.BASE)
    lead >>= np.uint64(61)
    part = lead.astype(np.uint8)
    del lead
    out = np.empty(len(run), np.int64)
    for p in range(_PARTS):
        mine = np.flatnonzero(part == p)
        group = radix_groups(data, place[mine], threshold)
        least = np.full(int(group.max()) + 1 if len(group) else 0, _NO_ID)
        np.minimum.at(least, group, owner[run[mine]])
        out[mine] = least[group]
    return out


def _owners(threshold: int):
    def answers(columns: list[X.Column]) -> list[X.Column]:
        """For each run asked, its hash and the smallest id of each of its windows."""
        (data, _), (windows, sizes), (owner, _) = columns
        windows = windows.astype(np.int64)
        length = windows + threshold - 1
        at = np.cumsum(length) - length
        h = _run_hashes(data, at, at + length)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        least = np.full(len(first), _NO_ID)
        np.minimum.at(least, back, owner)
        found = first_owners(data, at[first], windows[first], least, threshold)
        begin = np.cumsum(windows[first]) - windows[first]
        ends = np.r_[0, np.cumsum(sizes)]
        upto = np.r_[0, np.cumsum(windows)]
        return [(h, sizes), (windows.astype(np.uint16), sizes), (found[X.ragged(begin[back], windows)], upto[ends[1:]] - upto[ends[:-1]])]

    return answers


def _run_hashes(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes that may lie in one long buffer, a piece at a time."""
    out = np.empty(len(a), np.uint64)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(b, a[i] + K.PIECE, "right")))
        out[i:j] = K.span_hashes(buf[a[i] : b[j - 1]], a[i:j] - a[i], b[i:j] - a[i])
        i = j
    return out


def suffix_dedup(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, partitions: int | None = None, direct: int = X.DIRECT) -> DataFrame:
    """doc_id, n_bytes, spans, kept for every row of ``docs``.

    Every byte is removed that is covered by a string of ``threshold`` bytes that
    also starts in a document with a smaller id, judged on the texts as given.
    ``spans`` holds the maximal removed runs as [start, end, start, end, ...] in
    bytes, ``kept`` the bytes that are left. A null text is empty; texts shorter
    than the threshold are kept whole. A null id is larger than any other: such
    rows lose what others have and take nothing from anyone; rows that repeat an
    id take nothing from each other. An empty table gives no rows.
    """
    if not gram <= threshold <= 1 << 15:
        raise ValueError("a threshold is at least the minimisers' length, and at most 32,768 bytes")
    blocks, route = X.in_blocks(docs, partitions, direct)
    n = route.n

    def ask_anchors(table: pa.Table) -> pa.Table:
        keys, many = _block_anchors(X.one(table, "text"), threshold, gram)
        sizes = _sizes(keys, n)
        return route.asks(table.column("blk")[0].as_py(), [((keys >> np.uint64(16)).astype(np.uint32), sizes), ((keys & np.uint64(0xFFFF)).astype(np.uint16), sizes), (many.astype(np.uint8), sizes)])

    shared = route.answer(blocks.groupBy("blk").applyInArrow(ask_anchors, X.ROWS), shared_anchors)

    def ask_runs(left: pa.Table, right: pa.Table) -> pa.Table:
        got = X.heard(right)
        if not left.num_rows or got is None:
            return X._table([])
        text = X.one(left, "text")
        ids = left.column("doc_id").fill_null(_NO_ID).to_numpy()
        keys, _ = _block_anchors(text, threshold, gram)
        keys = keys[got[0][0] > 0]  # every bucket that is asked answers, in the keys' order
        parts: list[tuple] = []
        for i, _, buf, _, _, h, row, first, size in _runs(text, threshold, gram):
            if not len(keys) or not len(h):
                continue
            p = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            ok = keys[p] == h
            h, row, first, size = h[ok], row[ok], first[ok], size[ok]
            if not len(h):
                continue
            own = K.span_hashes(buf, first, first + size + threshold - 1)
            order = np.argsort(own, kind="stable")
            new = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
            pick = order[new]
            least = np.minimum.reduceat(ids[i + row][order], new)
            parts.append((h[pick], own[pick], size[pick], least, buf[X.ragged(first[pick], size[pick] + threshold - 1)]))
        if not parts:
            return X._table([])
        h, own, size, least = (np.concatenate([p[k] for p in parts]) for k in range(4))
        data = np.concatenate([p[4] for p in parts])
        length = size + threshold - 1
        begin = np.cumsum(length) - length
        _, first, back = np.unique(own, return_index=True, return_inverse=True)
        best = np.full(len(first), _NO_ID)
        np.minimum.at(best, back, least)
        order = np.argsort(h[first], kind="stable")
        first, best = first[order], best[order]
        runs = _sizes(h[first], n)
        upto = np.r_[0, np.cumsum(length[first])][np.r_[0, np.cumsum(runs)]]
        return route.asks(left.column("blk")[0].as_py(), [(data[X.ragged(begin[first], length[first])], np.diff(upto)), (size[first].astype(np.uint16), runs), (best, runs)])

    asked = blocks.groupBy("blk").cogroup(shared.groupBy("key")).applyInArrow(ask_runs, X.ROWS)
    owners = route.answer(asked, _owners(threshold))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        text = X.one(left, "text")
        ids = left.column("doc_id").fill_null(_NO_ID).to_numpy()
        got = X.heard(right)
        keys, count, least = (got[k][0] for k in range(3)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        count = count.astype(np.int64)
        begin = np.cumsum(count) - count
        order = np.argsort(keys, kind="stable")
        keys, begin = keys[order], begin[order]
        sizes, spans, kept = np.zeros(len(ids), np.int64), [[]] * len(ids), [b""] * len(ids)
        for i, _, buf, starts, ends, _, row, first, size in _runs(text, threshold, gram):
            cover = np.zeros(len(buf) + 1, np.int32)
            if len(keys) and len(row):
                own = K.span_hashes(buf, first, first + size + threshold - 1)
                p = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                ok = np.flatnonzero(keys[p] == own)
                n_own = size[ok]
                which = np.repeat(np.arange(len(ok)), n_own)
                step = np.arange(len(which)) - (np.cumsum(n_own) - n_own)[which]
                gone = least[begin[p[ok]][which] + step] < ids[i + row[ok]][which]
                at = (first[ok][which] + step)[gone]
                cover[at] += 1
                np.add.at(cover, at + threshold, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for r in range(len(starts)):
                a, b = starts[r], ends[r]
                sizes[i + r] = b - a
                mine = gone[a:b]
                if mine.any():
                    kept[i + r] = buf[a:b][~mine].tobytes()
                    spans[i + r] = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8))).tolist()
                else:
                    kept[i + r] = buf[a:b].tobytes()
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": sizes, "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})

    return blocks.groupBy("blk").cogroup(owners.groupBy("key")).applyInArrow(finish, "doc_id long, n_bytes long, spans array<long>, kept binary")
