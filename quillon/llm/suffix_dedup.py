"""Exact removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts in a
document with a smaller id. All such strings (windows) of the corpus cannot be
sorted as they are, so they are narrowed first, without losing one:

1. A window is keyed by the least hash of its GRAM-byte strings. Runs of
   windows with one key are a fragment; equal windows have equal keys.
2. Fragments are gathered by key. Where only one document has a key, nothing
   repeats. Of equal fragments (by a second hash) all but those of the smallest
   id go whole. Each task first does this for its own rows, so a string that
   stands in a third of all documents sends a row for each task.
3. What is left, the smallest id's fragments under keys with several different
   ones, is fetched as text, divided by 33 bytes around the key's place, and
   its windows are suffix-sorted to LENGTH bytes. In each group of equal windows
   those above the smallest id go.

A key in very many different fragments (a passage shorter than LENGTH between
ever other words) would fill one task. Keys that have more than HOT of them, as a
sample of documents tells, are dealt by fragment instead of by key, and all that
is left of them is divided into single windows, dealt by their own hash. That
costs more and finds the same: which keys the sample names, and how many of them
(HOT_KEYS at most), changes where the work is done but no result.

The sort is deep-shallow, of all keys' windows at once in arrays: multikey
quicksort parts each group by a pivot into less, equal and greater, with words of
8 bytes for characters, and goes one word deeper in what is equal, down to SHALLOW
bytes. Groups that still agree are ordered by blind tries, built level by level: a
group's first suffix is a path, the others leave it at a branching place by a
branching byte, which is all that orders them against it, and those that leave
together are a trie below that branch. The place is found by comparing words with
the path once, so the check that a blind descent needs at its end is part of it.

Defined results: a null text is empty; ids must be integers, a null id counts
as larger than all others; rows with equal ids do not remove each other's
bytes; texts shorter than LENGTH are left alone; an empty table gives an empty
result. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import stored, text_slices

LENGTH, GRAM, SHALLOW = 50, 16, 16
LAST = (1 << 63) - 1
#: Rows of one task that are thinned out together, and bytes sorted together.
HELD, SORTED = 1_000_000, 1 << 22
#: Different fragments under one key above which it is hot, the documents (one of so many) that this is judged by, and the most keys so named.
HOT, HOT_EVERY, HOT_KEYS = 10_000, 64, 1 << 16
U = np.uint64


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian word."""
    a = data.astype(np.uint64)
    w = (a[:-1] << U(8)) | a[1:]
    w = (w[:-2] << U(16)) | w[2:]
    return (w[:-4] << U(32)) | w[4:]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    g = words8(data)
    h = g[:-8] * U(0xA0761D6478BD642F)
    h ^= h >> U(29)
    h += g[8:]
    h *= U(0xE7037ED1A0B428DB)
    h ^= h >> U(32)
    return h


def window_keys(h: np.ndarray) -> np.ndarray:
    """Least of the LENGTH - GRAM + 1 gram hashes of the window from each place on."""
    n, k = LENGTH - GRAM + 1, 1
    while 2 * k <= n:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (n - k)], h[n - k :]) if k < n else h


def fragments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, digest, text number, start and length of every run of windows with one key."""
    if len(data) < LENGTH:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    keys = window_keys(gram_hashes(data))
    of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = np.flatnonzero(of[: len(keys)] == of[LENGTH - 1 :])
    keys, texts = keys[inside], of[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(inside))) + LENGTH - 1
    starts = inside[at]
    return keys[at], K.span_hash(K.prefix(data), starts, starts + length), texts[at], starts - off[texts[at]], length


def thinned(key: np.ndarray, digest: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by key and digest; in that order, whether a smaller document has the same fragment, the number of each key, and for each key whether several documents have it and whether several fragments do."""
    order = np.lexsort((doc, digest, key))
    k, g, d = key[order], digest[order], doc[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= g[1:] != g[:-1]
    first = np.flatnonzero(new)
    covered = d > d[first][np.cumsum(new) - 1]
    number = np.cumsum(new_key) - 1
    starts = np.flatnonzero(new_key)
    several = np.stack([np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts), np.add.reduceat(new.astype(np.int64), starts) > 1]) if len(k) else np.empty((2, 0), bool)
    return order, covered, number, several


#: What is known of a row: its fragment waits to be compared; it goes whole; it must be compared as text.
#: Rows of a hot key wait, and are open, in a state of their own.
WAITS, GOES, OPEN, HOT_OPEN = 0, 1, 2, 3
ROWS = "key long, digest long, doc long, th long, packed long"


def _packed(start: np.ndarray, length: np.ndarray, shared: np.ndarray | bool, state: np.ndarray | int) -> np.ndarray:
    """Start, length, whether other documents have the key, and state in one integer, as rows are many."""
    return (start.astype(np.int64) << 32) | (length.astype(np.int64) << 3) | (np.asarray(shared).astype(np.int64) << 2) | np.asarray(state).astype(np.int64)


def _rows(key: np.ndarray, digest: np.ndarray, doc: np.ndarray, th: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, digest, doc, th, packed)], names=["key", "digest", "doc", "th", "packed"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key and digest of the fragments of texts."""
    for batch in batches:
        for _, _, data, off in text_slices(batch.column(0)):
            key, digest, *_ = fragments(data, off)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(digest.view(np.int64))], names=["key", "digest"])


def hot_keys(texts: DataFrame, hot: int = HOT, every: int = HOT_EVERY) -> np.ndarray:
    """Keys that in one of every texts have their share of hot different fragments, the most frequent HOT_KEYS."""
    some = texts.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(every)) == 0).select("text").mapInArrow(_contexts, "key long, digest long")
    counts = some.distinct().groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot / every)
    return np.sort(np.array([r.key for r in counts.orderBy(F.col("n").desc(), "key").limit(HOT_KEYS).collect()], np.int64).view(np.uint64))


def _gather(batches: Iterator[pa.RecordBatch], hot: np.ndarray = np.empty(0, np.uint64)) -> Iterator[pa.RecordBatch]:
    """Fragments of doc, th, text; those that a smaller document of the same task covers are settled here. Rows of hot keys have key and digest together for a key, and the key for a digest."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, digest, doc, th, start, length = map(np.concatenate, zip(*held))
        held.clear()
        order, covered, number, several = thinned(key, digest, doc)
        doc, th, start, length = doc[order], th[order], start[order], length[order]
        key, digest = key[order], digest[order]
        is_hot = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
        dealt, second = np.where(is_hot, K.mix(key * U(0xA0761D6478BD642F) + digest), key), np.where(is_hot, key, digest)
        # settled rows need no key and are dealt by place
        dealt = np.where(covered, K.mix(doc.astype(np.uint64) * U(31) + start.astype(np.uint64)), dealt)
        yield _rows(dealt, np.where(covered, U(0), second), doc, th, _packed(start, length, several[0][number], np.where(covered, GOES, np.where(is_hot, HOT_OPEN, WAITS))))

    for batch in batches:
        doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, _, data, off in text_slices(batch.column(2)):
            key, digest, text, start, length = fragments(data, off)
            held.append((key, digest, doc[lo + text], th[lo + text], start, length))
            if sum(len(x[0]) for x in held) > HELD:
                yield from flush()
    yield from flush()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: settled ones pass; of the others come those that go whole or are open."""
    held: list[list[np.ndarray]] = []
    most = HELD

    def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        passed = (cols[4] & 3) == GOES
        if passed.any():
            yield _rows(*(x[passed] for x in cols))
        hot = (cols[4] & 3) == HOT_OPEN
        if hot.any():
            dealt, key, doc, th, packed = (x[hot] for x in cols)
            order, covered, _, _ = thinned(dealt, key, doc)
            yield _rows(key[order], key[order], doc[order], th[order], (packed[order] & ~np.int64(3)) | np.where(covered, GOES, HOT_OPEN))
        key, digest, doc, th, packed = (x[~passed & ~hot] for x in cols)
        if len(key):
            order, covered, number, several = thinned(key, digest, doc)
            known = np.zeros(several.shape[1], bool)
            np.logical_or.at(known, number, (packed[order] & 4) != 0)
            open_ = ~covered & ((several[0] | known) & several[1])[number]
            some = covered | open_
            pick = order[some]
            yield _rows(key[pick], digest[pick], doc[pick], th[pick], (packed[pick] & ~np.int64(3)) | np.where(covered[some], GOES, OPEN))

    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        cols[0], cols[1] = cols[0].view(np.uint64), cols[1].view(np.uint64)
        held.append(cols)
        if sum(len(x[0]) for x in held) > most:
            cols = [np.concatenate(x) for x in zip(*held)]
            # the last key may go on
            other = np.flatnonzero(cols[0] != cols[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            held = [[x[cut:] for x in cols]]
            # rows of one key are put together anew only when they have doubled
            most = max(HELD, 2 * len(held[0][0]))
            if cut:
                yield from done([x[:cut] for x in cols])
    if held:
        yield from done([np.concatenate(x) for x in zip(*held)])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open fragments of doc, th, text, and arrays start, length, key, hot: as text, divided by 33 bytes around the key's place.

    Fragments of hot keys are divided into their windows, dealt by their own
    hash; equal windows of one task are thinned out here, so that a window of a
    third of all documents sends a row for each task. A row without bytes is a
    window that goes. Equal parts of one document are one row with all starts.
    """
    side = LENGTH - GRAM - (LENGTH - GRAM) // 2  # bytes beside the gram that all windows of a part have on one side
    held: list[tuple[np.ndarray, ...]] = []
    pieces: list[bytes] = []

    def rows(k2: np.ndarray, doc: np.ndarray, th: np.ndarray, starts: list[list[int]], text: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k2.view(np.int64)), pa.array(doc), pa.array(th), pa.array(starts, pa.list_(pa.int32())), pa.array(text, pa.binary())], names=["k2", "doc", "th", "starts", "bytes"])

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            k2, key, doc, th, start = map(np.concatenate, zip(*held))
            order, covered, _, _ = thinned(k2, key, doc)
            k2, doc, th, start = k2[order], doc[order], th[order], start[order]
            k2 = np.where(covered, K.mix(doc.astype(np.uint64) * U(31) + start.astype(np.uint64)), k2)
            # a document's equal windows are one row
            same = np.zeros(len(k2), bool)
            same[1:] = ~covered[1:] & ~covered[:-1] & (k2[1:] == k2[:-1]) & (key[order][1:] == key[order][:-1]) & (doc[1:] == doc[:-1]) & (th[1:] == th[:-1])
            first = np.flatnonzero(~same)
            starts = [x.tolist() for x in np.split(start, first[1:])]
            yield rows(k2[first], doc[first], th[first], starts, [None if covered[i] else pieces[order[i]] for i in first.tolist()])
            held.clear()
            pieces.clear()

    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            buf, doc, th, start, key, hot, pos = [], [], [], [], [], [], 0
            offs = [0]
            for d, h, text, ss, ns, ks, hs in zip(*(c.to_pylist() for c in part.columns)):
                raw = text.encode("utf-8")
                for s, n, k, x in zip(ss, ns, ks, hs):
                    buf.append(raw[s : s + n])
                    doc.append(d)
                    th.append(h)
                    start.append(s)
                    key.append(k)
                    hot.append(x)
                    pos += n
                    offs.append(pos)
            if not buf:
                continue
            doc, th, start, key, hot = np.array(doc, np.int64), np.array(th, np.int64), np.array(start, np.int64), np.array(key, np.int64).view(np.uint64), np.array(hot, bool)
            whole = b"".join(buf)
            data, off = np.frombuffer(whole, np.uint8), np.array(offs)
            sums = K.prefix(data)
            of = np.repeat(np.arange(len(buf)), np.diff(off))
            n = len(data)
            w = np.flatnonzero(of[: n - LENGTH + 1] == of[LENGTH - 1 :])
            single = hot[of[w]]
            if single.any():
                one = w[single]
                f = of[one]
                held.append((K.span_hash(sums, one, one + LENGTH), key[f], doc[f], th[f], start[f] + one - off[f]))
                pieces += [whole[x : x + LENGTH] for x in one.tolist()]
                if len(pieces) > HELD // 2:
                    yield from flush()
                w = w[~single]
                if not len(w):
                    continue
            h = gram_hashes(data)
            # the first place of the key's gram from each place on
            at = np.where(h == key[of[: len(h)]], np.arange(len(h)), n)
            at = np.minimum.accumulate(at[::-1])[::-1]
            p = at[w]
            right = p - w <= (LENGTH - GRAM) // 2
            new = np.ones(len(w), bool)
            new[1:] = (p[1:] != p[:-1]) | (right[1:] != right[:-1]) | (w[1:] != w[:-1] + 1)
            first = np.flatnonzero(new)
            a, b = w[first], w[np.append(first[1:], len(w)) - 1] + LENGTH
            r = right[first]
            lo33 = np.where(r, p[first], p[first] - side)
            k2 = K.span_hash(sums, lo33, lo33 + GRAM + side) + r.astype(np.uint64)
            f = of[a]
            # a document's equal parts are one row: a text may repeat a phrase all along
            at_rows: dict[tuple, list[int]] = {}
            number = []
            for i, (d, h, k, x, y, s) in enumerate(zip(doc[f].tolist(), th[f].tolist(), k2.tolist(), a.tolist(), b.tolist(), (start[f] + a - off[f]).tolist())):
                known = at_rows.setdefault((d, h, k, whole[x:y]), [])
                if not known:
                    number.append(i)
                known.append(s)
            pick = np.array(number)
            yield rows(k2[pick], doc[f][pick], th[f][pick], list(at_rows.values()), [t[3] for t in at_rows])
    yield from flush()


def _regrouped(group: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and keys, and the finer groups' numbers in that order."""
    order = np.lexsort((*keys[::-1], group))
    new = np.ones(len(order), bool)
    for x in (group, *keys):
        y = x[order]
        new[1:] &= y[1:] == y[:-1]
    new[1:] = ~new[1:]
    return order, np.cumsum(new) - 1


def multikey_quicksort(w8: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that start at each place, group by group, to SHALLOW bytes, and flags of the first of equal ones in that order.

    Each round parts every open group at once by the median of its first, middle
    and last word: less and greater stay at their depth, equal goes one deeper.
    """
    n = len(at)
    order = np.argsort(group, kind="stable")
    first = np.ones(n, bool)
    first[1:] = group[order][1:] != group[order][:-1]
    depth = np.zeros(n, np.int64)
    some = np.arange(n)
    while True:
        # open groups: of two suffixes or more, and not yet at the shallow depth
        begin = np.flatnonzero(first[some])
        size = np.diff(np.append(begin, len(some)))
        going = np.repeat((size > 1) & (depth[some[begin]] < SHALLOW), size) if len(some) else np.zeros(0, bool)
        some = some[going]
        if not len(some):
            return order, first
        begin = np.flatnonzero(first[some])
        size = np.diff(np.append(begin, len(some)))
        word = w8[at[order[some]] + depth[some]]
        three = np.sort(np.stack([word[begin], word[begin + size // 2], word[begin + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        side = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        # a stable partition: where a group starts, then how many are before on its own side or on lesser ones
        start = np.repeat(begin, size)
        place = np.zeros(len(some), np.int64)
        ahead = start.copy()
        for k in range(3):
            own = side == k
            before = np.cumsum(own) - own
            here = before[begin]
            place[own] = (ahead + before - np.repeat(here, size))[own]
            ahead = ahead + np.repeat(np.add.reduceat(own.astype(np.int64), begin), size)
        moved, sides = np.empty(len(some), np.int64), np.empty(len(some), np.int64)
        moved[place], sides[place] = order[some], side
        order[some] = moved
        depth[some] += 8 * (sides == 1)
        new = first[some]
        new[1:] |= sides[1:] != sides[:-1]
        first[some] = new


def suffix_groups(data: np.ndarray, at: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """Number of the group of equal LENGTH-byte strings (of one of keys) that start at each place; numbers are in the order of keys and strings.

    Deep-shallow: multikey quicksort to SHALLOW bytes. Then all groups' blind
    tries are built at once: a group's first suffix is the path, the others
    leave it at a branching place by a branching byte, which is all that orders
    them against it; those that leave together go on as a group below that
    branch.
    """
    n = len(at)
    padded = np.concatenate([data, np.zeros(LENGTH + 16, np.uint8)])
    w8 = words8(padded)
    masks = [U(0xFFFFFFFFFFFFFFFF)] * (LENGTH // 8) + ([U((0xFFFFFFFFFFFFFFFF << (64 - 8 * (LENGTH % 8))) & 0xFFFFFFFFFFFFFFFF)] if LENGTH % 8 else [])
    order, first = multikey_quicksort(w8, at, np.zeros(n, np.int64) if keys is None else keys)
    group = np.cumsum(first) - 1
    active = np.bincount(group)[group] > 1
    # each suffix's place in the final order is told by its path of (group, rank) steps; ranks refine the groups
    some = np.flatnonzero(active)
    while len(some):
        g = group[some]
        head = np.ones(len(some), bool)
        head[1:] = g[1:] != g[:-1]
        path = at[order[some[np.flatnonzero(head)]]][np.cumsum(head) - 1]
        here = at[order[some]]
        lcp = np.full(len(some), LENGTH)
        branch = np.zeros(len(some), np.int64)
        going = np.arange(len(some))
        for k, mask in enumerate(masks):
            if 8 * (k + 1) <= SHALLOW:
                continue
            x = (w8[here[going] + 8 * k] ^ w8[path[going] + 8 * k]) & mask
            off = x != 0
            bits = np.frexp((x[off] >> U(11)).astype(np.float64))[1] + 11  # bit length, but for the lowest 11
            low = (x[off] >> U(11)) == 0
            if low.any():
                bits[low] = np.frexp(x[off][low].astype(np.float64))[1]
            places = 8 * k + (64 - bits) // 8
            lcp[going[off]] = places
            going = going[~off]
        left = lcp < LENGTH
        at_branch = np.minimum(lcp, LENGTH - 1)
        byte, path_byte = padded[here + at_branch].astype(np.int64), padded[path + at_branch].astype(np.int64)
        # before the path: the earlier it is left the farther; after it: the later it is left the nearer
        branch = np.where(~left, 0, np.where(byte < path_byte, -(LENGTH + 1 - lcp), LENGTH + 1 - lcp))
        byte = np.where(left, byte, 0)
        o, fine = _regrouped(g, branch, byte)
        order[some] = order[some][o]
        settled = ~left[o]
        new = np.ones(len(some), bool)
        new[1:] = fine[1:] != fine[:-1]
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[1:] = group[1:] != group[:-1]
        starts[some] = new
        group = np.cumsum(starts) - 1
        more = np.bincount(fine)[fine] > 1
        some = some[more & ~settled]
    out = np.empty(n, np.int64)
    out[order] = group
    return out


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that go, of parts (k2, doc, th, starts, bytes) sorted by k2."""
    held: list[pa.RecordBatch] = []

    def spans(t: pa.Table, row: np.ndarray, inner: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        """A span for each start of the rows' parts."""
        starts = t.column("starts").combine_chunks()
        counts = pc.list_value_length(starts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, first = starts.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)])
        n = counts[row]
        each = np.repeat(np.arange(len(row)), n)
        within = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        start = flat[first[row[each]] + within] + inner[each] if len(each) else np.empty(0, np.int64)
        own = row[each]
        return pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[own]) for c in ("doc", "th")] + [pa.array(start.astype(np.int32)), pa.array(length[each].astype(np.int32))], names=["doc", "th", "start", "length"])

    def done() -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        known = t.filter(pc.is_null(t.column("bytes")))
        t = t.filter(pc.is_valid(t.column("bytes")))
        goes_whole = spans(known, np.arange(len(known)), np.zeros(len(known), np.int64), np.full(len(known), LENGTH))
        if not len(t):
            return [goes_whole]
        doc = t.column("doc").to_numpy()
        parts = t.column("bytes").to_pylist()
        size = np.array(list(map(len, parts)), np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        n_windows = size - LENGTH + 1
        row = np.repeat(np.arange(len(parts)), n_windows)
        first = np.concatenate([[0], np.cumsum(n_windows)])
        inner = np.arange(len(row)) - first[row]
        k2 = t.column("k2").to_numpy()
        key = np.concatenate([[0], np.cumsum(k2[1:] != k2[:-1])])  # parts come sorted by k2
        group = suffix_groups(np.frombuffer(b"".join(parts), np.uint8), off[row] + inner, key[row])
        least = np.full(int(group.max()) + 1, LAST, np.int64)
        np.minimum.at(least, group, doc[row])
        goes = doc[row] > least[group]
        new = goes.copy()
        new[1:] &= ~goes[:-1] | (row[1:] != row[:-1])
        end = goes.copy()
        end[:-1] &= ~goes[1:] | (row[1:] != row[:-1])
        a, b = np.flatnonzero(new), np.flatnonzero(end)
        return [goes_whole, spans(t, row[a], inner[a], inner[b] - inner[a] + LENGTH)]

    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        sizes = pc.fill_null(pc.binary_length(batch.column(4)), 0).to_numpy()
        begin = 0
        for x, y in zip(cuts[:-1], cuts[1:]):
            if total > SORTED and keys[x] != last:
                if x > begin:
                    held.append(batch.slice(begin, x - begin))
                begin = x
                yield from done()
                held, total = [], 0
            total += int(sizes[x:y].sum())
            last = keys[x]
        held.append(batch.slice(begin))
    if held:
        yield from done()


def _merged(spans: list[int], n: int) -> list[tuple[int, int]]:
    """Maximal runs of spans packed as start << 32 | length."""
    out: list[tuple[int, int]] = []
    for x in sorted(spans):
        a, b = x >> 32, (x >> 32) + (x & 0xFFFFFFFF)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8")
                runs = _merged(spans.as_py() or [], len(raw))
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, hot_fragments: int = HOT, hot_every: int = HOT_EVERY) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (the remaining bytes)."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    counted = docs.groupBy(doc.alias("d")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    # the text's hash tells rows with equal ids apart; where there are none it need not be sent about
    th = F.lit(0).cast("long") if (counted or 0) <= 1 else F.coalesce(F.xxhash64(text_col), F.lit(0))
    texts = docs.select(doc.alias("doc"), th.alias("th"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = hot_keys(texts, hot_fragments, hot_every)
    gathered = texts.mapInArrow(lambda it: _gather(it, named), ROWS)
    start, length, state = F.shiftright("packed", 32).cast("int"), F.shiftright("packed", 3).bitwiseAND(F.lit((1 << 29) - 1)).cast("int"), F.col("packed").bitwiseAND(F.lit(3))
    known = gathered.repartition("key").sortWithinPartitions("key").mapInArrow(_settle, ROWS)
    is_open = state.isin(OPEN, HOT_OPEN)
    settled = stored(known.select(F.when(is_open, F.col("key")).alias("key"), "doc", "th", start.alias("start"), length.alias("length"), state.alias("state")))
    waiting = settled.filter(F.col("state").isin(OPEN, HOT_OPEN)).withColumn("hot", F.col("state") == HOT_OPEN)
    places = waiting.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "length", "key", "hot")).alias("_f")).withColumnsRenamed({"doc": "_d", "th": "_t"})
    open_texts = texts.join(places, (F.col("doc") == F.col("_d")) & (F.col("th") == F.col("_t"))).select("doc", "th", "text", "_f.start", "_f.length", "_f.key", "_f.hot")
    parts = open_texts.mapInArrow(_parts, "k2 long, doc long, th long, starts array<int>, bytes binary")
    found = stored(parts.repartition("k2").sortWithinPartitions("k2").mapInArrow(_sorted_spans, "doc long, th long, start int, length int"))
    spans = settled.filter(F.col("state") == GOES).select("doc", "th", "start", "length").unionByName(found)
    packed = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("length").cast("long"))
    of_doc = spans.groupBy("doc", "th").agg(F.collect_list(packed).alias("_s")).withColumnsRenamed({"doc": "_d", "th": "_t"})
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), doc.alias("doc"), th.alias("th"))
    joined = rows.join(of_doc, (F.col("doc") == F.col("_d")) & (F.col("th") == F.col("_t")), "left").select("_id", "_text", "_s")
    kind = rows.schema["_id"].dataType.simpleString()
    out = joined.mapInArrow(_cut(keep_text), f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("_id", id_col)
    return out if keep_text else out.drop("kept")


#: The contract of op2 on tables whose ids are distinct and not null, every window held against all others.
SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM h WHERE length(x) >= 100)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS before FROM w JOIN m ON m.s = w.s WHERE w.doc_id > least),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY 1, 2),
k AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p, a AS q, a FROM r UNION ALL SELECT doc_id, max(b), NULL, max(b) FROM r GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(CASE WHEN q IS NULL THEN substr(x, 2 * p + 1) ELSE substr(x, 2 * p + 1, 2 * (q - p)) END, '' ORDER BY a) AS kept FROM k JOIN h ON h.doc_id = k.doc_id GROUP BY 1),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY 1)
SELECT h.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN n ON n.doc_id = h.doc_id LEFT JOIN t ON t.doc_id = h.doc_id
"""
