"""Repeated passages by compact windows of min-hashes.

Words are lower-cased (A-Z) and shingled by five. A passage is a sequence of at least WIDTH shingles,
51 words. Under each of HASHES hash functions a text's Cartesian tree over its shingles'
hashes groups the sequences: node c stands for all sequences [i, j], low <= i <= c <= j <= high,
whose least hash is at c, its compact window. Only nodes with windows of WIDTH and more
matter; these are the minima of sliding windows, and their parents are among them, so the tree
is built over them alone, some 2 of WIDTH shingles a hash function.

Texts whose compact windows have one least shingle under one function meet: all pairs of a key with FEW
rows. Of two texts that met so, windows are joined by interval: a hit counts if hits of AGREE functions at
least hold sequences of WIDTH shingles in common in both texts. Two passages of similarity LIKE have one
least shingle under a function with a probability of LIKE, and so are passed over with one of about 0.007.

Rows of larger groups, as a frequent line has, meet by what stands around the least shingle, NEAR shingles on
either side, so no pair of like windows that hold it is lost: such windows have all but 5 shingles in common, at the
edges or about one word that was changed, put in or left out, and each way to choose these is a key of its own
(like_rows()). Rows that share one are like each other, so each meets the smallest document with it: a group
costs its rows and not their square, and between them these pairs have all words and all classes that
all pairs would have. Groups of over GROUP_ROWS are dealt into blocks, each pair of which meets. In a block
of documents, rows with the same shingles around meet the first of them at once.

A pair with hits is verified: the exact sets of shingles of a window of `width` + 4
words here and of the one there must have a similarity of LIKE. A passage of any length that is that
like another holds a window that is, as windows differ by the passage's share on average.
Windows with a similarity of LIKE differ in 5 of 47 at most: they have one edited word, or some at their
edges, and so a run of RUN words in common (if no shingle repeats within them). Only verified pairs are
linked, and only words of shingles that both windows have count as repeated.

Cases: null text is empty; texts with fewer than `width` + 4 words have no passage; rows with a
null id are left out of linking and get a null class; rows with one id are one document, and
repeats within a document are not passages; empty in, empty out; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, components, delete_table, give_back, joined, small_batches, written
from .simhash_wide import _in_blocks, _whole_groups

SHINGLE = 5
#: Shingles of the least passage: 47 shingles are 51 words.
WIDTH = 47
#: Words that like windows have in a row.
RUN = 25
SEED = 11
#: Hash functions, and how many of them have to agree on a pair of passages.
HASHES = 5
AGREE = 2
#: Shingles on either side of a place that windows of WIDTH which hold it reach to.
NEAR = WIDTH - 1
#: Words that are worked on at once; positions fit the bits that a hash gives up.
_WORDS = 400_000
#: Bytes of texts that are hashed at once, or one text.
_BYTES = 500_000
_BITS = np.uint64(20)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
#: A factor for each byte of a word; longer words are hashed by XXH64.
_FACTORS = mix(np.arange(SEED, SEED + 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, end to end, and the number of words of each: a sum of bytes
    times factors by place, mixed."""
    raw = b" ".join(texts).lower()
    codes = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[codes], [True]])))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), 100_000):
        lo, size = starts[k : k + 100_000], (ends - starts)[k : k + 100_000]
        part = codes[lo[0] : lo[-1] + size[-1]]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        values = (part[~_SPACE[part]].astype(np.uint64) + np.uint64(1)) * _FACTORS[np.minimum(place, len(_FACTORS) - 1)]
        out[k : k + 100_000] = mix(np.add.reduceat(values, first))
        for j in np.flatnonzero(size > len(_FACTORS)).tolist():
            out[k + j] = xxhash.xxh64_intdigest(raw[lo[j] : lo[j] + size[j]], SEED)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return out, np.diff(np.searchsorted(starts, bounds))


def _spans(x: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every n consecutive values, by doubling."""
    base, out, have, block, size, power = 0x9E3779B97F4A7C15, None, 0, x, 1, 0x9E3779B97F4A7C15
    while n:
        if n & 1:
            if out is None:
                out, have = block, size
            else:
                m = len(block) - have
                out = out[:m] + block[have : have + m] * np.uint64(pow(base, have, 1 << 64))
                have += size
        n >>= 1
        if n:
            block = block[: len(block) - size] + block[size:] * np.uint64(power)
            power = power * power % (1 << 64)
            size *= 2
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Values of x in order, each once."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def sliding_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def smaller_before(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Place of the last smaller value before each value with the same owner; -1 if none.

    All places jump at once: what lies between a place and its candidate is larger, so a
    candidate that is larger too is replaced by its own candidate.
    """
    n = len(values)
    at = np.arange(-1, n - 1)
    if n:
        at[1:][owner[1:] != owner[:-1]] = -1
    todo = np.flatnonzero(at >= 0)
    while len(todo := todo[values[at[todo]] > values[todo]]):
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def compact_windows(h: np.ndarray, inside: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, low, high) of the compact windows of `width` and more.

    h: hashes of shingles of several texts, end to end; inside: whether the `width` shingles from a place
    on are of one text; first, last: places of the first and the last shingle of each place's text.
    Of equal hashes the first is the less.
    """
    mask = np.uint64((1 << int(_BITS)) - 1)
    packed = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    c = (sliding_minima(packed, width)[inside] & mask).astype(np.int64)
    # As a window moves on, the place of its minimum does not go back.
    c = c[np.append(True, c[1:] != c[:-1])] if len(c) else c
    values, owner = packed[c], first[c]
    before = smaller_before(values, owner)
    after = len(c) - 1 - smaller_before(values[::-1], owner[::-1])[::-1]
    low = np.where(before < 0, first[c], c[np.maximum(before, 0)] + 1)
    high = np.where(after >= len(c), last[c], c[np.minimum(after, len(c) - 1)] - 1)
    return c, low, high


def _salt(k: int) -> np.uint64:
    """What tells hash function k from the others."""
    return np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))


def _pack(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Two places of less than 2**31 as one number."""
    return first << 32 | last


def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x >> 32, x & 0xFFFFFFFF


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, … of n values."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def signatures(words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, document, places, window, around) arrays of each hash function, places and window as _pack()
    gives them; around: hash of the shingles from NEAR before the first place to NEAR after the last.

    words: hashes of the words of all documents, end to end; lengths: words of each document.
    Places are of shingles within the document. Windows of one document and key that overlap, as a
    shingle that repeats has, are one row: from its first place to its last.
    """
    if len(words) < WIDTH + SHINGLE - 1:
        return
    span = _spans(words, SHINGLE)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    inside = owner[: len(words) - WIDTH - SHINGLE + 2] == owner[WIDTH + SHINGLE - 2 :]
    starts = (ends - lengths)[owner[: len(span)]]
    stops = (ends - SHINGLE)[owner[: len(span)]]
    sums = np.append(np.uint64(0), np.cumsum(span * _powers(_BASE, len(span))))
    back = _powers(_INVERSE, len(span))
    for k in range(HASHES):
        h = mix(span + _salt(k))
        c, low, high = compact_windows(h, inside, starts, stops, WIDTH)
        if not len(c):
            continue
        order = np.lexsort((c, h[c], owner[c]))
        c, low, high = c[order], low[order], high[order]
        new = np.append(True, (h[c][1:] != h[c][:-1]) | (owner[c][1:] != owner[c][:-1]) | (low[1:] > high[:-1] + 1))
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(c)) - 1
        base, key = starts[c[at]], h[c[at]].view(np.int64)
        lo, hi = np.maximum(c[at] - NEAR, base), np.minimum(c[end] + NEAR, stops[c[at]])
        around = mix((sums[hi + 1] - sums[lo]) * back[lo] + mix(_pack(c[at] - lo, hi - c[end]).view(np.uint64)))
        yield key, owner[c[at]], _pack(c[at] - base, c[end] - base), _pack(np.minimum.reduceat(low, at) - base, np.maximum.reduceat(high, at) - base), around


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, word hashes, lengths) of whole documents, about _WORDS at a time; a document
    longer than that is a block of its own, cut in overlapping pieces that share its id."""
    overlap = WIDTH + SHINGLE - 2
    ids, parts, total = [], [], 0

    def texts():
        """(id, word hashes), hashed some at a time."""
        for batch in batches:
            some, size = [], 0
            rows = batch.column(0).to_pylist()
            for k, (i, t) in enumerate(zip(rows, batch.column(1))):
                if i is not None:
                    some.append((i, (t.as_py() or "").encode()))
                    size += len(some[-1][1])
                if some and (size > _BYTES or k + 1 == len(rows)):
                    h, n = hashed_words([t for _, t in some])
                    yield from zip([i for i, _ in some], np.split(h, np.cumsum(n)[:-1]))
                    some, size = [], 0

    for i, h in texts():
        if len(h) <= overlap:
            continue
        if len(h) > _WORDS:
            for at in range(0, len(h) - overlap, _WORDS - overlap):
                yield [(i, at)], h[at : at + _WORDS], np.array([len(h[at : at + _WORDS])])
            continue
        if total + len(h) > _WORDS:
            yield ids, np.concatenate(parts), np.array(list(map(len, parts)))
            ids, parts, total = [], [], 0
        ids.append((i, 0))
        parts.append(h)
        total += len(h)
    if parts:
        yield ids, np.concatenate(parts), np.array(list(map(len, parts)))


#: The rep of a row whose first document is still to be found, and of such a row that others met already.
_OPEN, _MET_BY = -(2**63), -(2**63) + 1
#: Rows of a signature up to which all of its pairs are verified.
FEW = 6
#: Rows of a signature above which they are dealt into blocks.
GROUP_ROWS = 20_000
#: The hash function of a hit that counts by itself, as what is around it was compared.
_SURE = HASHES
#: Least Jaccard similarity of two windows of WIDTH shingles.
LIKE = 0.8


_SIDES = ("places", "window", "rep_places", "rep_window")
#: Columns of a row of a signature, and of a pair of rows that met. `places` are the first and the last
#: place of the least shingle, `window` the ends of its window.
_SIGNED = ["key", "doc_id", "hash", "rep", *_SIDES]
_MET = ["doc_id", "rep", "hash", *_SIDES]
_TYPES = {n: "int" if n == "hash" else "long" for n in _SIGNED}


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {_TYPES[n]}" for n in names)


def _batch(names: list[str], columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(columns[n], types[_TYPES[n]]) for n in names], names=names)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of signatures. Of the rows of a block that share a key and all that is around it, if over FEW, only
    the first goes on under it; the others meet that one here, so a key that very many copies have
    meets as FEW rows a block at most."""
    for ids, words, lengths in _blocks(batches):
        who_of, shift = np.array([i for i, _ in ids], np.int64), np.array([s for _, s in ids], np.int64)
        for k, (key, who, places, window, around) in enumerate(signatures(words, lengths)):
            doc, moved = who_of[who], _pack(shift[who], shift[who])
            places, window = places + moved, window + moved
            order = np.lexsort((places, doc, around, key))
            key, doc, places, window, around = key[order], doc[order], places[order], window[order], around[order]
            first, size = _groups(key, around)
            done = (size > FEW) & (doc != doc[first])
            yield _batch(_SIGNED, {
                "key": np.where(done, mix(doc.view(np.uint64)).view(np.int64), key), "doc_id": doc, "hash": np.where(done, _SURE, k), "rep": np.where(done, doc[first], np.where(size > FEW, _MET_BY, _OPEN)),
                "places": places, "window": window, "rep_places": np.where(done, places[first], 0), "rep_window": np.where(done, window[first], 0)})


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, rows) of each row's group; rows of one group are side by side."""
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    return at[group], np.diff(np.append(at, len(new)))[group]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and document, to pairs of rows that share a key, if it has at most FEW rows and none that
    stands for others; rows of other groups go on as they are, open, with the key as rep_places."""
    names = ["key", "doc_id", "hash", "places", "window", "rep"]
    held: list[list[np.ndarray]] = []

    def solve(key, doc, k, places, window, rep):
        if not len(key):
            return
        several = _groups(key)[1] > 1
        if not several.any():
            return
        key, doc, k, places, window, rep = (x[several] for x in (key, doc, k, places, window, rep))
        first, size = _groups(key)
        row = np.arange(len(key))
        many = ((size > FEW) | np.isin(key, key[rep == _MET_BY])) & (doc[first] != doc[first + size - 1])
        if many.any():
            none = np.zeros(many.sum(), np.int64)
            yield _batch(_MET, {"doc_id": doc[many], "rep": none + _OPEN, "hash": k[many], "places": places[many], "window": window[many], "rep_places": key[many], "rep_window": none})
        for lag in range(1, FEW):
            other = np.maximum(first, row - lag)
            pair = (doc != doc[other]) & (row - lag >= first) & (size <= FEW) & ~many
            if pair.any():
                to = other[pair]
                yield _batch(_MET, {"doc_id": doc[pair], "rep": doc[to], "hash": k[pair], "places": places[pair], "window": window[pair], "rep_places": places[to], "rep_window": window[to]})

    for b in batches:
        open_ = b.column("rep").to_numpy() <= _MET_BY
        if not open_.all():
            yield b.select(_MET).filter(pa.array(~open_))
        if not open_.any():
            continue
        rows = [b.column(n).to_numpy()[open_] for n in names]
        if held and (rows[0][0] != held[-1][0][-1] or rows[0][-1] != rows[0][0]):
            rows, held = [np.concatenate(c) for c in zip(*held, rows)], []
        cut = np.searchsorted(rows[0], rows[0][-1])
        yield from solve(*(c[:cut] for c in rows))
        held.append([c[cut:] for c in rows])
    if held:
        yield from solve(*(np.concatenate(c) for c in zip(*held)))


def agreeing(k: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], agree: int = 0) -> np.ndarray:
    """Which hits of a pair of texts count: those whose windows hold, in both texts, a sequence of WIDTH
    shingles in common with hits of `agree` hash functions, their own included, and those of _SURE.
    k: hash functions of the hits; sides: (places, window) in each text."""
    if (k == _SURE).any():
        keep, some = k == _SURE, k != _SURE
        keep[some] = agreeing(k[some], [(places[some], window[some]) for places, window in sides], agree)
        return keep
    agree = agree or AGREE
    n = len(k)
    keep = np.zeros(n, bool)
    for at in range(0, n, 256):
        some = np.arange(at, min(n, at + 256))
        together = np.ones((len(some), n), bool)
        for places, window in sides:
            (place, last), (low, high) = _unpack(places), _unpack(window)
            lo, hi = np.maximum(low[some, None], low), np.minimum(high[some, None], high)
            together &= (lo <= np.minimum(last[some, None], last)) & (np.maximum(place[some, None], place) <= hi) & (hi - lo + 1 >= WIDTH)
        keep[some] = sum(together[:, k == f].any(axis=1).astype(np.int64) for f in range(HASHES)) >= agree
    return keep


def _again(key: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, code) without most of the entries whose key no other has."""
    bits = len(key).bit_length() + 2
    slot = (key * np.uint64(_BASE) >> np.uint64(64 - bits)).astype(np.int64)
    some = (np.bincount(slot, minlength=1 << bits) > 1)[slot]
    return key[some], code[some]


def _same(key: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, least code) of the entries whose key others have too."""
    order = np.argsort(key)
    key = key[order]
    again = key[1:] == key[:-1]
    at = np.flatnonzero(np.append(again, False) | np.append(False, again))
    if not len(at):
        return at, at
    new = ~np.append(False, again)[at]
    code = code[order[at]]
    return code, np.minimum.reduceat(code, np.flatnonzero(new))[np.cumsum(new) - 1]


def _forks(group: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Which places of a row's shingles are the first, from the middle on, that another row of its group has
    otherwise. All rows with what lies between in common fork there, or none does; where none does, a part that
    is left out from there on may as well begin a place further from the middle."""
    n, out = len(group), np.zeros(around.shape, bool)
    if n < 2:
        return out
    for way in (1, -1):
        rows = np.concatenate([group[:, None].view(np.uint32).reshape(n, 2), around[:, NEAR::way].astype(np.uint32)], axis=1)
        order = np.argsort(rows.view("V" + str(4 * rows.shape[1])).ravel())
        rows = rows[order]
        other = rows[1:] != rows[:-1]
        common = np.where(other.any(axis=1), np.argmax(other, axis=1) - 2, NEAR + 1)
        for d in range(1, NEAR + 1):
            part = np.append(0, np.cumsum(common < d))
            has = np.zeros(part[-1] + 1, bool)
            has[part[1:][common == d]] = True
            out[order, NEAR + way * d] = has[part]
    return out


def like_rows(group: np.ndarray, doc: np.ndarray, around: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shift) of rows a and the first row b of one group that has a like window about its middle.

    around: NEAR shingles, the middle one and NEAR shingles of each row, of which `left` and `right` on
    either side are of its text. Rows of a group come in order of documents. Windows of WIDTH that hold the middle
    and have WIDTH - SHINGLE shingles in common are like. Either these are side by side, or SHINGLE
    lie between them in one text, about a word, and in the other as many or one less, if a word was put
    in; there the rest is a place further on, and so is the diagonal of a second hit, by `shift`.
    Rows that have the same shingles at the same places are like each other, so b stands for all of them.
    """
    n, common = len(doc), WIDTH - SHINGLE
    sums = np.zeros((2 * NEAR + 2, n), np.uint64)
    np.cumsum(around.T * _powers(_BASE, 2 * NEAR + 1)[:, None], axis=0, out=sums[1:])
    salt, base, back, odd = mix(group.view(np.uint64)), np.uint64(_BASE), np.uint64(_INVERSE), np.uint64(0xD6E8FEB86659FD93)
    # Rows with all in common: the first goes on, for others of its document as well.
    code, low = _same(sums[-1] * odd + mix(_pack(left, right).view(np.uint64)) + salt, np.arange(n))
    copy = doc[code] != doc[low]
    found = [(code[copy], low[copy], np.zeros(copy.sum(), np.int64))]
    alone_, of = np.ones(n, bool), code[~copy & (code != low)]
    alone_[code[code != low]] = False
    of_low = low[~copy & (code != low)]
    kept = np.flatnonzero(alone_)
    sums, salt, left, right, place = sums[:, kept], salt[kept], left[kept], right[kept], doc[kept]
    low_i, high_i = NEAR - left, right
    last, last_doc = np.full(len(kept), -1), np.full(len(kept), -1)
    covered, pairs = np.zeros((len(kept), 2 * NEAR + 1), bool), []
    forks = _forks(group[kept], around[kept])

    def add(row, first, shift, ranges):
        """Rows that share a key, each with the first one, if that is another document than the last one it met, or if
        some of the shingles in the key are not yet among those that it shares. ranges: places of these shingles."""
        some = np.flatnonzero((place[row] != place[first]) & ((last[row] != first) | (shift != 0)))
        if not len(some):
            return
        row, first, shift = row[some], first[some], shift[some]
        if isinstance(ranges, tuple):
            x, y = ranges
            fresh = (last_doc[row] != place[first]) | ~covered[row, x:y].all(axis=1)
            row, first = row[fresh], first[fresh]
            covered[row, x:y], last[row], last_doc[row] = True, first, place[first]
            pairs.append((row * len(kept) + first) * 3 + 1)
            return
        ranges = [(x[some], y[some]) for x, y in ranges]
        of_row, at = np.unique(row, return_inverse=True)
        over = np.zeros((len(of_row), 2 * NEAR + 2), np.int16)
        np.cumsum(covered[of_row], axis=1, out=over[:, 1:])
        fresh = last_doc[row] != place[first]
        for x, y in ranges:
            fresh |= over[at, y] - over[at, x] < y - x
        row, first, shift, at, ranges = row[fresh], first[fresh], shift[fresh], at[fresh], [(x[fresh], y[fresh]) for x, y in ranges]
        if not len(row):
            return
        still, more = shift == 0, np.zeros((len(of_row), 2 * NEAR + 2), np.int32)
        for x, y in ranges:
            np.add.at(more, (at[still], x[still]), 1)
            np.add.at(more, (at[still], y[still]), -1)
        covered[of_row] |= np.cumsum(more, axis=1)[:, :-1] > 0
        last[row], last_doc[row] = first, place[first]
        pairs.append(distinct((row * len(kept) + first) * 3 + shift + 1))

    # What is side by side: the same shingles at several ends of a window make the same groups, unless texts end there.
    for u in range(SHINGLE, NEAR + 1):
        rows = np.flatnonzero((low_i <= u) & (high_i >= u - SHINGLE))
        code, low = _same(sums[u + common, rows] - sums[u, rows] + salt[rows], rows)
        if not len(code):
            continue
        at = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        size = np.diff(np.append(at, len(low)))
        whole = (low_i[code] <= u - SHINGLE) & (high_i[code] >= u)
        part = ~np.repeat(np.logical_and.reduceat(whole, at), size)
        found_u = [code[~part] * len(kept) + low[~part]]
        if part.any():
            code, size = code[part], size[part[at]]
            at = np.cumsum(size) - size
            for x in range(SHINGLE + 1):
                valid = (low_i[code] <= u - x) & (high_i[code] >= u - x)
                found_u.append((code * len(kept) + np.repeat(np.minimum.reduceat(np.where(valid, code, len(kept)), at), size))[valid])
        row, first = np.divmod(distinct(np.concatenate(found_u)), len(kept))
        add(row, first, np.zeros(len(row), np.int64), (u, u + common))
    tags = mix(np.arange(1, WIDTH + 1, dtype=np.uint64))
    for i in range(NEAR + 1):
        rows = np.flatnonzero((low_i <= i) & (high_i >= i))
        if len(rows) < 2:
            continue
        # Of rows with the whole window in common the first goes on, and others of its document that have
        # shingles there which are not yet shared.
        code, low = _same(sums[i + WIDTH, rows] - sums[i, rows] + salt[rows], np.arange(len(rows)))
        live = np.ones(len(rows), bool)
        code, low = code[code != low], low[code != low]
        live[code[(place[rows[code]] != place[rows[low]]) | covered[rows[code], i : i + WIDTH].all(axis=1)]] = False
        rows = rows[live]
        t, at = salt[rows], lambda k: sums[i + k, rows]
        # The longer part has half of what is common, and the other one the window's end.
        half, one = (common + 1) // 2, lambda k: at(k + 1) - at(k)
        head, tail, first, last_one = at(half) - at(0), at(WIDTH) - at(WIDTH - half), one(0), one(WIDTH - 1)
        ends = [
            (head * odd + last_one, head * odd + one(WIDTH - 2) * base, (at(half + 1) - at(1)) * back * odd + last_one),
            (tail * odd + first, (at(WIDTH - 1) - at(WIDTH - 1 - half)) * base * odd + first, tail * odd + one(1) * back)]
        live = np.zeros(len(rows), bool)
        for three in ends:
            code, low = _same(*_again(np.concatenate(three) + np.tile(t, 3), np.tile(np.arange(len(rows)), 3)))
            other = np.zeros(len(rows), bool)
            other[low[place[rows[code]] != place[rows[low]]]] = True
            live[code[other[low]]] = True
        rows = rows[live]
        if len(rows) < 2:
            continue
        s, t = sums[i : i + WIDTH + 1, rows], salt[rows]
        # Places p of a part that is left out which have a fork at its side of the middle.
        split = np.zeros((len(rows), common), bool)
        after, before = max(1, NEAR + 1 - i), max(1, min(common, NEAR + 1 - i - SHINGLE))
        split[:, after:] = forks[rows, i + after : i + common]
        split[:, 1:before] |= forks[rows, i + SHINGLE : i + before + SHINGLE - 1]
        for some in np.array_split(np.arange(1, common), 1 + int(split.sum()) // 100_000):
            r, p = np.nonzero(split[:, some])
            if not len(r):
                continue
            p = some[p]
            middle_left = NEAR < i + p
            salted = t[r] + tags[p]
            head, tail = (s[p, r] - s[0, r]) * odd + salted, s[WIDTH, r] - s[p + SHINGLE, r]
            less = np.where(middle_left, head + (s[WIDTH - 1, r] - s[p + SHINGLE - 1, r]) * base, (s[p + 1, r] - s[1, r]) * back * odd + salted + tail)
            codes = (rows[r] << 1) * WIDTH + p
            code, low = _same(np.concatenate([head + tail, less]), np.concatenate([codes, codes + WIDTH]))
            (row, p), first = np.divmod(code, WIDTH), low // WIDTH
            kind, theirs = row & 1, first & 1
            # The part without the middle stands `shift` further on in the first row than in this one.
            middle_left = NEAR < i + p
            shift = np.where(middle_left, kind - theirs, theirs - kind)
            ahead, behind = kind * ~middle_left, kind * middle_left
            add(row >> 1, first >> 1, shift, [(i + ahead, i + ahead + p), (i + p + SHINGLE - behind, i + WIDTH - behind)])
    if pairs:
        both, shift = np.divmod(distinct(np.concatenate(pairs)), 3)
        a, b = (kept[x] for x in np.divmod(both, len(kept)))
        found.append((a, b, shift - 1))
        if len(of):
            order = np.argsort(a, kind="stable")
            lo, hi = (np.searchsorted(a[order], of_low, side=w) for w in ("left", "right"))
            at = order[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())]
            found.append((np.repeat(of, hi - lo), b[at], shift[at] - 1))
    return tuple(np.concatenate(x) for x in zip(*found))


def needed(text: np.ndarray, pair: np.ndarray, give: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which hits are enough: others of the text cover what each hit that is left out may, and each pair keeps one.

    give: first and last place of the shingles that a hit covers for sure, (0, -1) for none; need: of all those it may.
    """
    (lo, hi), n = give, len(text)
    keep = hi < lo
    some = np.flatnonzero(~keep)
    if not len(some):
        return keep
    some = some[np.lexsort((-hi[some], lo[some], text[some]))]
    base = (np.unique(text[some], return_inverse=True)[1] + 1) << 34
    start, stop = base + lo[some], base + hi[some]
    reach = np.maximum.accumulate(stop)
    wide = (need[0][some] != lo[some]) | (need[1][some] != hi[some])
    held = np.append(False, reach[:-1] >= stop[1:])
    held[wide] = np.append(-1, reach)[np.searchsorted(start, base[wide] + need[0][some][wide], side="right")] >= base[wide] + need[1][some][wide]
    keep[some[wide & ~held]] = True
    # What is left has growing ends: of those that begin within what is covered, the one that reaches furthest.
    left = np.flatnonzero(~held & ~wide)
    covered = best = -1
    starts, stops = start[left].tolist(), stop[left].tolist()
    for k, at in enumerate(starts):
        if at > covered + 1:
            if best >= 0 and stops[best] > covered:
                keep[some[left[best]]], covered = True, stops[best]
            if at > covered + 1:
                covered = at - 1
        best = k
    if best >= 0:
        keep[some[left[best]]] = True
    # A pair that has no sure hit among these keeps its longest.
    has = np.zeros(int(pair.max()) + 1, bool)
    has[pair[some[keep[some]]]] = True
    rest = some[~has[pair[some]]]
    rest = rest[np.lexsort((lo[rest] - hi[rest], pair[rest]))]
    keep[rest[np.append(True, pair[rest][1:] != pair[rest][:-1])[: len(rest)]]] = True
    return keep


def shared(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(give, need) of pairs of rows of like_rows(), as distances from the middle: the ends of the equal shingles
    about it, if these hold a window, and of all windows that may be like."""
    place = np.arange(2 * NEAR + 1)
    same = (x == y) & (place >= NEAR - left[:, None]) & (place <= NEAR + right[:, None])
    end = np.zeros((len(x), 1), bool)
    give = np.stack([1 - np.argmin(np.concatenate([same[:, NEAR::-1], end], axis=1), axis=1), np.argmin(np.concatenate([same[:, NEAR:], end], axis=1), axis=1) - 1])
    sums = np.zeros((len(x), 2 * NEAR + 2), np.int8)
    np.cumsum(same, axis=1, dtype=np.int8, out=sums[:, 1:])
    like = sums[:, WIDTH:] - sums[:, :-WIDTH] >= WIDTH - SHINGLE
    like[:, 0] |= ~like.any(axis=1)
    need = np.stack([np.argmax(like, axis=1), 2 * NEAR - np.argmax(like[:, ::-1], axis=1)])
    # No further than the outermost shingles in common.
    first, last = np.argmax(same & (place >= need[0][:, None]), axis=1), 2 * NEAR - np.argmax((same & (place <= need[1][:, None]))[:, ::-1], axis=1)
    need = np.stack([np.minimum(first - NEAR, give[0]), np.maximum(last - NEAR, give[1])])
    return np.where(give[1] - give[0] + 1 >= WIDTH, give, np.array([[0], [-1]])), need


_NEAR = ["key", "doc_id", "place", "text", "around", "more"]


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, open), open being (key, places, hash) of its rows of large groups, to a row for each
    place with the shingles around, in 32 bits, and how many of these are the text's on either side. The key is
    the shingle's, whatever functions have it as the least, so a place is one row, and the rows of a shingle that is the least
    under several functions meet once. Places of one key that have all that in common, as in a text of one line over and
    over, are one row: `more` are the later ones; `text` tells texts of one id apart."""
    salts = np.array([_salt(k) for k in range(HASHES)])
    for b in batches:
        out, have, ends_at = [], 0, b.column(2).offsets.to_numpy()
        keys, places, hashes = (b.column(2).values.field(n).to_numpy(zero_copy_only=False) for n in ("key", "places", "hash"))
        first, last = _unpack(places)
        for i, doc, raw, words in _hashed(b):
            span = _spans(words, SHINGLE)
            rows = np.arange(ends_at[i], ends_at[i + 1])
            # Of several texts of one id, a row is of those that have its shingle there.
            rows = rows[last[rows] < len(span)]
            rows = rows[mix(span[first[rows]] + salts[hashes[rows]]).view(np.int64) == keys[rows]]
            if not len(rows):
                continue
            wide = np.concatenate([np.zeros(NEAR, "<u4"), span.astype("<u4"), np.zeros(NEAR, "<u4")])
            at = first[rows]
            if (long := rows[last[rows] > at]).size:
                ranges = set(zip(first[long].tolist(), last[long].tolist()))
                at = np.concatenate([at, *(np.flatnonzero(span[x : y + 1] == span[x]) + x for x, y in ranges)])
            at = distinct(at)
            key = mix(span[at]).view(np.int64)
            several = len(set(key.tolist())) < len(key)
            if several:
                at, key = at[order := np.argsort(key, kind="stable")], key[order]
                of, size = _groups(key)
            one = size == 1 if several else np.ones(len(key), bool)
            at_all, key_all, more = [at[one]], [key[one]], [b""] * int(one.sum())
            for k in np.flatnonzero(~one & (of == np.arange(len(key)))).tolist() if several else ():
                same = at[k : k + size[k]]
                _, low, which = np.unique(_contexts(wide, same, len(span)).view("V" + str(4 * (2 * NEAR + 3))).ravel(), return_index=True, return_inverse=True)
                later = np.ones(len(same), bool)
                later[low] = False
                order = np.argsort(which[later], kind="stable")
                cuts = np.searchsorted(which[later][order], np.arange(1, len(low)))
                at_all.append(same[low])
                key_all.append(np.full(len(low), key[k]))
                more += [x.tobytes() for x in np.split(same[later][order], cuts)]
            at, key, which = np.concatenate(at_all), np.concatenate(key_all), xxhash.xxh64_intdigest(raw) >> 1
            for lo in range(0, len(at), 4000):
                some = at[lo : lo + 4000]
                out.append((key[lo : lo + 4000], np.full(len(some), doc), some, np.full(len(some), which, np.int64), _contexts(wide, some, len(span)), more[lo : lo + 4000]))
                have += len(some)
                if have >= 4000:
                    yield _near_batch(out)
                    out, have = [], 0
        if out:
            yield _near_batch(out)


def _hashed(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(row, id, bytes, word hashes) of a batch's (id, text), hashed some at a time."""
    some, size = [], 0
    for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
        some.append((i, doc, text.as_py().encode()))
        size += len(some[-1][2])
        if size > _BYTES or i + 1 == b.num_rows:
            h, n = hashed_words([raw for *_, raw in some])
            yield from ((*row, words) for row, words in zip(some, np.split(h, np.cumsum(n)[:-1])))
            some, size = [], 0


def _contexts(wide: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Shingles around the places `at` of n, and how many there are on either side."""
    ends = np.stack([np.minimum(at, NEAR), np.minimum(n - 1 - at, NEAR)], axis=1).astype("<u4")
    return np.ascontiguousarray(np.concatenate([wide[at[:, None] + np.arange(2 * NEAR + 1)], ends], axis=1))


def _near_batch(out: list) -> pa.RecordBatch:
    *numbers, data = (np.concatenate(c) for c in zip(*(x[:-1] for x in out)))
    offsets = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]), pa.array([m for x in out for m in x[-1]], pa.binary())], names=_NEAR)


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _around(), sorted by key, document and place, to pairs that met for sure, less the hits that add
    neither words nor a pair to those of other hits."""

    def solve(key, doc, place, text, around, more):
        data = np.frombuffer(b"".join(around), "<u4").reshape(len(key), -1)
        left, right = data[:, -2:].astype(np.int64).T
        a, b, shift = like_rows(key, doc, data[:, :-2].astype(np.uint64), left, right)
        moved = np.flatnonzero(shift)
        a, b, shift = np.append(a, a[moved]), np.append(b, b[moved]), np.append(np.zeros(len(a), np.int64), shift[moved])
        if not len(a):
            return
        both, which = np.unique(a * len(key) + b, return_inverse=True)
        give, need = np.zeros((2, len(both)), np.int64), np.zeros((2, len(both)), np.int64)
        for lo in range(0, len(both), 10_000):
            x, y = np.divmod(both[lo : lo + 10_000], len(key))
            give[:, lo : lo + 10_000], need[:, lo : lo + 10_000] = shared(data[x, :-2], data[y, :-2], np.minimum(left[x], left[y]), np.minimum(right[x], right[y]))
        give, need = give[:, which], need[:, which]
        give[:, shift != 0] = [[0], [-1]]
        ours, many = place[a], np.array([len(x) for x in more]) >> 3
        if (times := many[a]).any():
            again = np.repeat(np.arange(len(a)), times)
            at = np.repeat((np.cumsum(many) - many)[a] - (np.cumsum(times) - times), times) + np.arange(len(again))
            ours = np.append(ours, np.frombuffer(b"".join(more), np.int64)[at])
            a, b, shift = np.append(a, a[again]), np.append(b, b[again]), np.append(shift, shift[again])
            give, need = np.append(give, give[:, again], axis=1), np.append(need, need[:, again], axis=1)
        sure, (_, who) = give[1] >= give[0], np.unique(doc, return_inverse=True)
        pair = np.unique(who[a] * len(key) + who[b], return_inverse=True)[1]
        own = np.unique(mix(doc.view(np.uint64)) ^ text.view(np.uint64), return_inverse=True)[1]
        keep = needed(own[a], pair, np.where(sure, give + ours, give), need + ours)
        a, b, shift, ours = a[keep], b[keep], shift[keep], ours[keep]
        diagonal = place[b] + shift - ours
        order = np.lexsort((ours, diagonal, doc[b], doc[a]))
        a, b, diagonal, ours = a[order], b[order], diagonal[order], ours[order]
        # One hit for a diagonal, from the first place on it to the last.
        new = np.append(True, (doc[a][1:] != doc[a][:-1]) | (doc[b][1:] != doc[b][:-1]) | (diagonal[1:] != diagonal[:-1]))
        lo, hi, diagonal = ours[new], ours[np.append(new[1:], True)], diagonal[new]
        theirs, ends = np.maximum(lo + diagonal, 0), (np.maximum(lo - NEAR, 0), hi + NEAR)
        yield _batch(_MET, {"doc_id": doc[a[new]], "rep": doc[b[new]], "hash": np.full(len(lo), _SURE), "places": _pack(lo, hi), "window": _pack(*ends), "rep_places": _pack(theirs, theirs + hi - lo), "rep_window": _pack(np.maximum(ends[0] + diagonal, 0), np.maximum(ends[1] + diagonal, 0))})

    return _whole_groups(batches, _NEAR, 20_000, solve)


_HITS = "array<struct<diagonal: long, from: long, to: long>>"


def _join_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, rep, met), met being all that met of a pair, to its hits by diagonal."""
    kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("diagonal", "from", "to")]))
    for b in batches:
        out = []
        at, met = b.column(2).offsets.to_numpy(), b.column(2).values
        k, *sides = (met.field(n).to_numpy(zero_copy_only=False) for n in _MET[2:])
        for doc, rep, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            places, window, rep_places, rep_window = (x[i:j] for x in sides)
            keep = agreeing(k[i:j], [(places, window), (rep_places, rep_window)])
            if not keep.any():
                continue
            (place, last), theirs = _unpack(places[keep]), _unpack(rep_places[keep])[0]
            diagonal = theirs - place
            order = np.argsort(diagonal, kind="stable")
            new = np.flatnonzero(np.append(True, np.diff(diagonal[order]) != 0))
            hits = zip(diagonal[order][new].tolist(), np.minimum.reduceat(place[order], new).tolist(), np.maximum.reduceat(last[order], new).tolist())
            out.append((doc, rep, [{"diagonal": d, "from": i, "to": j} for d, i, j in hits]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], kind)], names=["doc_id", "rep", "hits"])


def _like(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sets of shingles in rows of x and y have a similarity of LIKE."""
    values = lambda z: 1 + (np.diff(np.sort(z, axis=1), axis=1) != 0).sum(axis=1)
    union = values(np.concatenate([x, y], axis=1))
    return values(x) + values(y) - union >= LIKE * union - 1e-9


#: Bytes of texts, and places of hits, that are verified at once.
_VERIFIED = 1_000_000


def verify(pairs: list[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]) -> list[list[int]]:
    """For each pair (a, b, hits) ranges from, to, … of the words of a that b has in like windows: for each hit
    (diagonal, low, high), windows of a that start up to WIDTH before low, until high, against those of b
    a diagonal further on that share RUN words in a row. Of a like window count the words of
    shared shingles only. Windows whose words all count already are not compared again. The texts, and the hits' places,
    are laid end to end."""
    n, core = WIDTH + SHINGLE - 1, RUN - SHINGLE + 1
    lengths = [np.array([len(p[side]) for p in pairs]) for side in (0, 1)]
    # A place lies between two texts, so each has its ends.
    at_a, at_b = (np.cumsum(x + 1) - x - 1 for x in lengths)
    gap = np.zeros(SHINGLE, np.uint64)
    sa, sb = (_spans(np.concatenate([x for p in pairs for x in (p[side], gap[:1])] + [gap]), SHINGLE) for side in (0, 1))
    inside = np.zeros(int((lengths[0] + 1).sum()), bool)
    of = np.repeat(np.arange(len(pairs)), [len(p[2]) for p in pairs])
    diagonal, low, high = np.array([h for p in pairs for h in p[2]], np.int64).reshape(-1, 3).T
    start = np.maximum(np.maximum(0, -diagonal), low - WIDTH)
    stop = np.minimum(np.minimum(high, lengths[0][of] - n), lengths[1][of] - n - diagonal) + 1
    over = lambda flags, size: np.append((t := np.append(0, np.cumsum(flags)))[size:] - t[:-size], np.zeros(min(len(flags), size - 1), np.int64))

    def laid(hits):
        """(hit, place, shingles of a, of b, whether windows that start there are equal, whether they share a run and are not)."""
        size = stop[hits] - start[hits] + WIDTH - 1
        for some in np.split(hits, np.flatnonzero(np.diff(np.cumsum(size) // _VERIFIED)) + 1):
            if not len(some):
                continue
            size = stop[some] - start[some] + WIDTH - 1
            hit = np.repeat(some, size)
            at = np.arange(len(hit)) + np.repeat(start[some] - np.cumsum(size) + size, size)
            place = at + at_a[of[hit]]
            x, y = sa[place], sb[at + (at_b[of[some]] + diagonal[some]).repeat(size)]
            # What a window that starts at a hit's last places would take from the next hit does not count.
            same, window = x == y, at < stop[hit]
            equal = window & (over(same, WIDTH) == WIDTH)
            yield hit, place, x, y, equal, window & ~equal & (over(over(same, core) == core, WIDTH - core + 1) > 0)

    open_ = [np.zeros(0, np.int64)]
    for hit, place, _, _, equal, maybe in laid(np.flatnonzero(stop > start)):
        more = np.bincount(place[equal], minlength=len(inside) + 1) - np.bincount(place[equal] + n, minlength=len(inside) + 1)
        inside |= np.cumsum(more)[:-1] > 0
        open_.append(distinct(hit[maybe]))
    new = over(~inside, n) > 0
    for hit, place, x, y, _, maybe in laid(np.concatenate(open_)):
        maybe &= new[place]
        kept = np.isin(hit, distinct(hit[maybe]))
        if not kept.any():
            continue
        hit, place, x, y, maybe = hit[kept], place[kept], x[kept], y[kept], maybe[kept]
        salt, missing = mix(hit.view(np.uint64) + np.uint64(1)), np.zeros(len(x), bool)
        missing[np.unique(x + salt, return_index=True)[1]] = True
        missing &= ~np.isin(x + salt, y + salt)
        few = np.flatnonzero(maybe & (over(missing, WIDTH) <= (1 - LIKE) * WIDTH + 1e-9))
        for k in range(0, len(few), 1024):
            at = few[k : k + 1024]
            wx, wy = (z[at[:, None] + np.arange(WIDTH)] for z in (x, y))
            like = _like(wx, wy)
            row, col = np.nonzero((wx[like, :, None] == wy[like, None, :]).any(axis=2))
            inside[(place[np.unique(at[like][row] + col)][:, None] + np.arange(SHINGLE)).reshape(-1)] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    cuts = np.searchsorted(edges, np.append(at_a, len(inside) + 1))
    return [(edges[i:j] - at).tolist() for i, j, at in zip(cuts[:-1], cuts[1:], at_a)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, rep, hits, text, text_hash) with the words around the hits in place of the text, about _VERIFIED bytes at a time."""
    names = ["doc_id", "rep", "hits", "text_hash"]
    for b in batches:
        at, parts, size, begin, last, words = [], [], 0, 0, None, []
        for k, (text, hits) in enumerate(zip(b.column("text"), b.column("hits").to_pylist())):
            if (text := text.as_py()) != last:
                last, words = text, text.encode().split()
            at.append(max(0, min(h["from"] for h in hits) - WIDTH))
            parts.append(b" ".join(words[at[-1] : max(h["to"] for h in hits) + WIDTH + SHINGLE]))
            size += len(parts[-1])
            if size > _VERIFIED or k + 1 == b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(begin, len(at)) for c in names), pa.array(at, pa.int64()), pa.array(parts, pa.binary())], names=[*names, "at", "part"])
                at, parts, size, begin = [], [], 0, k + 1


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text_hash, rep, at, part, hits, text), text being the rep's, to verified ranges."""
    names = ["doc_id", "text_hash", "rep", "spans"]

    def words(texts):
        h, n = hashed_words(texts)
        return np.split(h, np.cumsum(n)[:-1])

    for b in batches:
        rows, texts, size = [], [], 0
        for k, (doc, text_hash, rep, at, part, hits, text) in enumerate(zip(*(b.column(c) for c in ("doc_id", "text_hash", "rep", "at", "part", "hits", "text")))):
            text, at = text.as_py(), at.as_py()
            if not texts or text != texts[-1]:
                texts.append(text)
                size += len(text)
            rows.append((doc.as_py(), text_hash.as_py(), rep.as_py(), at, part.as_py(), len(texts) - 1, [(h["diagonal"] + at, h["from"] - at, h["to"] - at) for h in hits.as_py()]))
            size += len(rows[-1][4]) + sum(high - low + 2 * WIDTH for _, low, high in rows[-1][6])
            if size < _VERIFIED and k + 1 < b.num_rows:
                continue
            ours, theirs = words([r[4] for r in rows]), words([t.encode() for t in texts])
            found = verify([(x, theirs[r[5]], r[6]) for x, r in zip(ours, rows)])
            out = [(*r[:3], [x + r[3] for x in f]) for r, f in zip(rows, found) if f]
            rows, texts, size = [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.list_(pa.int64()) if i == 3 else pa.int64()) for i in range(4)], names=names)


def candidates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rep, hits) of pairs of documents with agreeing windows, the smaller one as rep; a hit
    is a diagonal, rep's place less the document's, with the lowest and highest place."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = rows.mapInArrow(_sign, _schema(_SIGNED))
    met = written(signed.repartition(n, "key").sortWithinPartitions("key", "doc_id", "places").mapInArrow(_meet, _schema(_MET)))
    open_ = met.filter(F.col("rep") == _OPEN).select("doc_id", F.col("rep_places").alias("key"), "places", "hash")
    asked = open_.groupBy("doc_id").agg(F.collect_list(F.struct("key", "places", "hash")).alias("open"))
    around = written(rows.filter("text is not null").join(asked, "doc_id").mapInArrow(_around, "key long, doc_id long, place long, text long, around binary, more binary"))
    large = written(around.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_ROWS))
    dealt = _in_blocks(joined(around, large, "key", "left"), "key", "doc_id", F.col("n"), GROUP_ROWS).select(*_NEAR)
    sure = dealt.repartition(n, "key").sortWithinPartitions("key", "doc_id", "place").mapInArrow(_refine, _schema(_MET))
    sure = written(sure.distinct())
    delete_table(around)
    pairs = met.filter(F.col("rep") != _OPEN).unionByName(sure).groupBy("doc_id", "rep").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("hash"))).alias("functions"), F.collect_list(F.struct(*_MET[2:])).alias("met"))
    several = pairs.filter((F.bit_count("functions") >= AGREE) | (F.col("functions") >= 1 << _SURE)).select("doc_id", "rep", "met")
    return several.mapInArrow(_join_windows, f"doc_id long, rep long, hits {_HITS}")


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, rep, spans): word ranges from, to, … of a document's text that an earlier
    document, rep, has in windows that were verified. Each row of an id is verified for itself;
    text_hash tells them apart."""
    pairs = alone(lambda: candidates(df, doc_id, text))
    ids = pairs.select("doc_id").unionByName(pairs.select(F.col("rep").alias("doc_id"))).distinct()
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    texts = written(joined(texts, written(ids), "doc_id", "left_semi").distinct())
    ours = pairs.join(texts.withColumn("text_hash", F.xxhash64("text")), "doc_id")
    parts = ours.mapInArrow(_slices, f"doc_id long, rep long, hits {_HITS}, text_hash long, at long, part binary")
    theirs = texts.withColumnRenamed("doc_id", "rep")
    # Not broadcast, however few: else one task has the Python workers of both functions.
    return parts.join(theirs.hint("merge"), "rep").mapInArrow(_verify, "doc_id long, text_hash long, rep long, spans array<long>")


def merge_spans(ranges: list[list[int]]) -> list[tuple[int, int]]:
    """Word ranges [from, to) of several lists of from, to, …, merged, in order."""
    out: list[list[int]] = []
    for a, b in sorted(x for r in ranges for x in zip(r[::2], r[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, words): the merged word ranges of each text with repeats, as one
    array of from, to, from, to, …, and the words in them."""
    grouped = found.groupBy("doc_id", "text_hash").agg(F.collect_set("spans").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged = [merge_spans(s.as_py()) for s in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[x for s in m for x in s] for m in merged], pa.list_(pa.int64())), pa.array([sum(y - x for x, y in m) for m in merged], pa.int64())], names=["doc_id", "text_hash", "spans", "words"])

    return grouped.mapInArrow(run, "doc_id long, text_hash long, spans array<long>, words long")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, links, repeated_words) of every row: the smallest document reachable
    over shared passages, the earlier documents it is linked to (of those in a large group that have the same
    shared words, the first), and the words of its text that earlier documents have."""
    return alone(lambda: _classes(df, doc_id, text))


def _classes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    found = alone(lambda: repeats(df, doc_id, text))
    linked = found.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    reach = components(linked)
    counts = linked.groupBy(F.col("a").alias("doc_id")).agg(F.count(F.lit(1)).alias("links"))
    every = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"))
    out = every.join(reach.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(counts, "doc_id", "left").join(spans(found).drop("spans"), ["doc_id", "text_hash"], "left")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("words", F.lit(0)).cast("long").alias("repeated_words"))


def cut_text(text: str, ranges: list[int]) -> str:
    """A text without the given word ranges and the white space after them."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(ranges[::2], ranges[1::2]):
        b = min(b, len(places))
        if a >= b:
            continue
        out.append(text[at : places[a][0]])
        at = places[b][0] if b < len(places) else len(text)
    return "".join(out) + text[at:]


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the verified words of each repeated passage kept only in the smallest document
    that has them. Documents that are left without words are dropped; those that had none stay."""
    marks = spans(alone(lambda: repeats(df, doc_id, text))).select(F.col("doc_id").alias("_at"), F.col("text_hash").alias("_hash"), "spans")
    same = (F.col(doc_id).cast("long") == F.col("_at")) & (F.xxhash64(F.col(text)) == F.col("_hash"))
    marked = joined(df, written(marks), same, "left", 24 + 8 * F.size("spans")).drop("_at", "_hash")
    place = df.columns.index(text)
    schema = T.StructType(list(df.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            old, ranges = b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            new = [t if not r else cut_text(t, r) for t, r in zip(old, ranges)]
            columns = list(b.columns[:-1])
            columns[place] = pa.array(new, pa.string())
            keep = pa.array([not r or bool(_WORD.search(t)) for t, r in zip(new, ranges)])
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(keep)

    return marked.mapInArrow(run, schema)
