"""Maximal repeats across documents: common-prefix interval trees over a sparse, distributed enhanced suffix array.

A string of ``length`` bytes has a place of its own to be compared at: of the hashes of its ``GRAM``-byte substrings, the least.
Documents' positions that are such a place for some string (anchors, some 7 % of all positions) are dealt to buckets by hash, so
that all occurrences of a string meet, in three passes over the texts:

1. Anchors whose hash is in several documents become candidates. A worker that knows as much by itself sends one occurrence on.
2. Candidates' frames, the bytes that strings around the anchor can reach, go to the buckets. Equal frames of a worker go once, for
   the least document; all strings in the others repeat. In a bucket, frames are sorted by what follows the anchor: the suffix
   array, with its array of longest common prefixes. A scan with a stack gives the intervals of its prefix tree; the bytes
   before the anchor, sorted and scanned in the same way within each interval, give the left extensions, and tell
   where they diverge. Each node of both is a maximal repeat in the frame, with all its occurrences and their least document.
3. What the occurrences in other documents cover is taken out.

Frames bound memory: a repeat longer than a frame comes as one group for each of its anchors, and these overlap. Anchors that are very
frequent (their number is bounded) are taken apart into single strings, which are places of their own, so no bucket gathers
more of them than there are different strings and workers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, materialize, mix, release, sliced, trim, utf8
from .blobs import pack, unpack, xxhash_long
from .words import powers

GRAM = 24
BASE = 0xD6E8FEB86659FD93
UNBASE = pow(BASE, -1, 1 << 64)
CODES = mix(np.arange(1, 257, dtype=np.uint64))
#: The place of a null doc_id in the order of documents: after all others.
LAST = (1 << 63) - 1
#: Marks the frame of a single string of a very frequent anchor, which has nothing before it.
APART = 255
#: Rows that workers send: to a bucket of hashes, or back to documents.
TO_HASH, TO_DOC = 0, 1


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of all strings of ``length`` bytes inside documents, ascending, and their hashes."""
    n, span = len(data), length - GRAM + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(CODES[data] * powers(BASE, n)[:n], out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * powers(UNBASE, n)[: n - GRAM + 1])
    bits = np.uint64(max(23, int(n).bit_length()))
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < span:  # minima of ever longer runs
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    fits = np.repeat(offsets[1:], np.diff(offsets))[: len(least)] - np.arange(len(least)) >= length
    at = (least[fits] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, h[at]


def string_hashes(rows: np.ndarray) -> np.ndarray:
    """Hashes of equally long strings, a row each; of GRAM bytes, those of ``anchors``."""
    out = np.zeros(len(rows), np.uint64)
    for k, p in enumerate(powers(BASE, rows.shape[1])[: rows.shape[1]]):
        out += CODES[rows[:, k]] * p
    return mix(out)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 48-bit key of a hash."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64), hashes >> np.uint64(16)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows that are equal in all columns begin."""
    n = len(columns[0])
    if not n:
        return np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= (c[1:] != c[:-1]) if c.ndim == 1 else (c[1:] != c[:-1]).any(axis=1)
    return np.flatnonzero(new)


def _spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(starts, n)))


def _rows(kind: int, places: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One packed row for each place."""
    order = np.argsort(places, kind="stable")
    places = places[order]
    starts = _runs(places)
    for a, b in zip(starts, np.append(starts[1:], len(places))):
        yield kind, int(places[a]), pack(*(c[order[a:b]] for c in columns))


SENT = pa.schema([("kind", pa.int32()), ("place", pa.int64()), ("blob", pa.binary())])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SENT)], schema=SENT)


def _doc_places(docs: np.ndarray, n: int) -> np.ndarray:
    return xxhash_long(docs) % n


def _find_anchors(length: int, bits: int, doc_places: int, flush: int = 1 << 19) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sent(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int, bytes]]:
        h, doc, pos = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((pos, doc, h))
        h, doc, pos = h[order], doc[order], pos[order]
        starts, n = _runs(h), len(h)
        ends = np.append(starts[1:], n)
        known = _spread(doc[starts] != doc[ends - 1], starts, n)
        yield from _rows(TO_DOC, _doc_places(doc[known], doc_places), doc[known], pos[known].astype(np.int32))
        count = _spread(ends - starts, starts, n)
        first = np.zeros(n, bool)
        first[starts] = True
        go = ~known | first
        bucket, key = _places(h[go], bits)
        step = np.diff(key, prepend=np.uint64(0))
        new = _runs(bucket)
        step[new] = key[new]  # each bucket's keys are sums from its own first
        yield from _rows(TO_HASH, bucket, step, doc[go], pos[go].astype(np.int32), np.where(known[go], count[go], first[go] * count[go]).astype(np.int32), known[go])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sliced(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            at, h = anchors(data, offsets, length)
            row = np.searchsorted(offsets, at, side="right") - 1
            held.append((h, batch.column("doc").to_numpy()[row], at - offsets[row]))
            size += len(at)
            if size >= flush:
                yield from (_batch([x]) for x in sent(held))
                held, size = [], 0
        if size:
            yield from (_batch([x]) for x in sent(held))

    return run


def _by_place(batches: Iterator[pa.RecordBatch], single: Callable[[list[bytes]], Iterator[tuple[int, int, bytes]]]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind and place: those for documents go on as they are, the blobs of each bucket go to ``single``."""
    place, held = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            kind, to, blob = (batch.column(c)[k].as_py() for c in ("kind", "place", "blob"))
            if kind == TO_DOC:
                yield _batch([(TO_DOC, to, blob)])
                continue
            if held and to != place:
                yield from (_batch([x]) for x in single(held))
                held = []
            place = to
            held.append(blob)
    if held:
        yield from (_batch([x]) for x in single(held))
    trim()


def _find_candidates(doc_places: int, often: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def single(blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        parts = [unpack(b) for b in blobs]
        key = np.concatenate([np.cumsum(p[0]) for p in parts])
        doc, pos, count, known = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
        order = np.lexsort((doc, key))
        key, doc, pos, count, known = key[order], doc[order], pos[order], count[order], known[order]
        starts, n = _runs(key), len(key)
        if not n:
            return
        ends = np.append(starts[1:], n)
        several = (doc[starts] != doc[ends - 1]) | np.logical_or.reduceat(known, starts)
        take = _spread(several, starts, n) & ~known
        yield from _rows(TO_DOC, _doc_places(doc[take], doc_places), doc[take], pos[take])
        hot = key[starts][np.add.reduceat(count.astype(np.int64), starts) > often]
        if len(hot):
            yield TO_HASH, 0, pack(hot)

    return lambda batches: _by_place(batches, single)


class Numbered:
    """Numbers rows of one doc_id from 0, in rows that come sorted by it; nearly always all are 0."""

    def __init__(self) -> None:
        self.doc, self.n = None, 0

    def __call__(self, docs: np.ndarray) -> np.ndarray:
        starts = _runs(docs)
        out = np.arange(len(docs)) - _spread(starts, starts, len(docs))
        if len(docs):
            if docs[0] == self.doc:
                out[: starts[1] if len(starts) > 1 else len(docs)] += self.n
            self.doc, self.n = docs[-1], int(out[-1]) + 1
        return out


class Frames:
    """Frames around anchors: what follows them, then what goes before, reversed; how many bytes of both are in the document; and
    where they are: doc, text (the number of a row among those of its doc) and pos."""

    def __init__(self, key: np.ndarray, doc: np.ndarray, text: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, frame: np.ndarray) -> None:
        self.columns = [key, doc, text, pos, left, right, frame]
        self.key, self.doc, self.text, self.pos, self.left, self.right, self.frame = self.columns

    def take(self, index: np.ndarray) -> "Frames":
        return Frames(*(c[index] for c in self.columns))

    @staticmethod
    def joined(parts: list[list[np.ndarray]]) -> "Frames":
        return Frames(*(np.concatenate(c) for c in zip(*parts)))

    def sorted(self) -> "Frames":
        """By key, then what follows the anchor, then what goes before, then document: a suffix array of the anchors."""
        n, width = self.frame.shape
        wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
        wide[:, :width] = self.frame
        words = wide.view(">u8").astype(np.uint64)
        return self.take(np.lexsort((self.pos, self.text, self.doc, self.left, self.right, *words.T[::-1], self.key)))

    def classes(self) -> np.ndarray:
        """Where runs of equal frames begin, in sorted ones."""
        return _runs(self.key, self.frame, self.left, self.right)


def frames(data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right and frame (what follows, then what goes before, reversed) of anchors ``at`` in documents begin..end."""
    before = length - GRAM
    left, right = np.minimum(at - begin, before), np.minimum(end - at, length)
    step = np.append(np.arange(length), -np.arange(1, before + 1))
    inside = np.where(step >= 0, step < right[:, None], -step <= left[:, None])
    frame = np.where(inside, data[np.clip(at[:, None] + step, 0, max(len(data) - 1, 0))], 0).astype(np.uint8)
    return left.astype(np.uint8), right.astype(np.uint8), frame


def _send_frames(length: int, bits: int, doc_places: int, hot: np.ndarray, flush: int = 1 << 16) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by place, the candidates of a place before its documents."""
    before = length - GRAM

    def apart(f: Frames) -> Frames:
        """The single strings of frames of very frequent anchors: frames of their own, without anything before."""
        parts = []
        for o in range(before + 1):
            ok = np.flatnonzero((f.left >= o) & (f.right >= length - o))
            if len(ok):
                string = np.concatenate([f.frame[ok][:, length : length + o][:, ::-1], f.frame[ok][:, : length - o]], axis=1)
                wide = np.zeros((len(ok), f.frame.shape[1]), np.uint8)
                wide[:, :length] = string
                parts.append([string_hashes(string), f.doc[ok], f.text[ok], f.pos[ok] - o, np.full(len(ok), APART, np.uint8), np.full(len(ok), length, np.uint8), wide])
        return Frames.joined(parts) if parts else f.take(np.empty(0, np.int64))

    def sent(held: list[list[np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
        f = Frames.joined(held)
        if len(hot):
            often = np.isin(f.key >> np.uint64(16), hot)
            f = Frames.joined([f.take(~often).columns, apart(f.take(often)).columns])
        f = f.sorted()
        starts, n = f.classes(), len(f.key)
        if not n:
            return
        least = f.doc == _spread(f.doc[starts], starts, n)
        left = np.where(f.left == APART, 0, f.left).astype(np.int64)
        full = ~least & (left + f.right >= length)
        yield from _covered(f.doc[full], f.text[full], f.pos[full] - left[full], f.pos[full] + f.right[full], doc_places)
        f = f.take(least)
        bucket, _ = _places(f.key, bits)
        yield from _rows(TO_HASH, bucket, *f.columns[1:])  # the key is a hash of the frame

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, place, candidates = [], 0, None, None
        for batch in sliced(batches, "text"):
            for part in _same_place(batch):
                if part.column("place")[0].as_py() != place:
                    place, candidates, blobs, numbered = part.column("place")[0].as_py(), None, [], Numbered()
                coming = [b for b in part.column("blob").to_pylist() if b is not None]
                blobs += coming
                part = part.slice(len(coming))
                if not part.num_rows or not blobs:
                    continue
                if candidates is None:
                    doc, pos = (np.concatenate(c) for c in zip(*map(unpack, blobs)))
                    order = np.argsort(doc, kind="stable")
                    candidates = doc[order], pos[order]
                data, offsets = utf8(part.column("text"))
                own = part.column("doc").to_numpy()
                number = numbered(own)
                lo, hi = np.searchsorted(candidates[0], own), np.searchsorted(candidates[0], own, side="right")
                row = np.repeat(np.arange(len(own)), hi - lo)
                pos = candidates[1][np.repeat(lo - np.append(0, np.cumsum(hi - lo)[:-1]), hi - lo) + np.arange(len(row))].astype(np.int64)
                at = pos + offsets[row]
                ok = at + GRAM <= offsets[row + 1]  # rows of equal doc_id get one another's candidates
                row, pos, at = row[ok], pos[ok], at[ok]
                if not len(at):
                    continue
                left, right, frame = frames(data, offsets[row], offsets[row + 1], at, length)
                held.append([string_hashes(frame[:, :GRAM]), own[row], number[row], pos, left, right, frame])
                size += len(at)
                if size >= flush:
                    yield from (_batch([x]) for x in sent(held))
                    held, size = [], 0
        if size:
            yield from (_batch([x]) for x in sent(held))

    return run


def _same_place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    place = batch.column("place").to_numpy()
    starts = _runs(place)
    for a, b in zip(starts, np.append(starts[1:], len(place))):
        yield batch.slice(a, b - a)


def _covered(doc: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, doc_places: int) -> Iterator[tuple[int, int, bytes]]:
    """Covered bytes of documents, touching ones as one."""
    order = np.lexsort((start, text, doc))
    doc, text, start, end = doc[order], text[order], start[order], end[order]
    if not len(doc):
        return
    owner = _runs(doc, text)
    number = np.cumsum(np.isin(np.arange(len(doc)), owner)) - 1
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * far) - number * far  # of all spans before, in the same text
    new = np.append(True, (start[1:] > reach[:-1]) | (number[1:] != number[:-1]))
    first = np.flatnonzero(new)
    yield from _rows(TO_DOC, _doc_places(doc[first], doc_places), doc[first], text[first], start[first].astype(np.int32), np.maximum.reduceat(end, first).astype(np.int32))


def scan(lcp: list[int], whole: list[int], floor: int) -> Iterator[tuple[int, int, int, int]]:
    """The prefix tree of sorted strings, by a scan with a stack: (depth, depth of the parent, first, last + 1) of each interval
    deeper than ``floor``. lcp[k]: common prefix of strings k - 1 and k; whole[k]: length of string k, a leaf of that depth."""
    n = len(whole)
    stack: list[tuple[int, int]] = []  # depth, first string
    for k in range(n):
        up = lcp[k + 1] if k + 1 < n else floor
        up = max(up, floor)
        here = max(max(lcp[k], floor) if k else floor, up)
        if whole[k] > here:
            yield whole[k], here, k, k + 1
        first = k
        while stack and stack[-1][0] > up:
            depth, first = stack.pop()
            yield depth, max(up, stack[-1][0] if stack else floor), first, k + 1
        if up > floor and not (stack and stack[-1][0] == up):
            stack.append((up, first))


def groups(key: np.ndarray, frame: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, length: int) -> Iterator[tuple[list[int], int, int, int]]:
    """Maximal repeats of at least ``length`` bytes among different frames, sorted: (frames, bytes before the anchor, bytes from it
    on, least document). doc: the least document of each frame."""
    n, before = len(key), length - GRAM
    same = np.zeros((n, length), bool)
    same[1:] = frame[1:, :length] == frame[:-1, :length]
    lcp = np.where(same.all(axis=1), length, same.argmin(axis=1))
    lcp[1:] = np.minimum(np.minimum(lcp[1:], right[1:]), right[:-1])
    lcp[1:][key[1:] != key[:-1]] = 0
    lcp[:1] = 0
    # Left parts as numbers, so that the first byte in which two differ is the length of their exclusive or.
    behind = [int.from_bytes(x.tobytes(), "big") for x in frame[:, length:]]
    lefts, docs = left.tolist(), doc.tolist()
    for depth, parent, first, last in scan(lcp.tolist(), right.tolist(), GRAM - 1):
        low, high = max(0, length - depth), min(before, length - 1 - parent)  # bytes before the anchor, in strings that end in this node
        if low > high:
            continue
        if last - first == 1:
            if lefts[first] >= low:
                yield [first], min(high, lefts[first]), length - low, docs[first]
            continue
        members = sorted((m for m in range(first, last) if lefts[m] >= low), key=lambda m: (behind[m], lefts[m]))
        if not members:
            continue
        common = [0] + [min(before - ((behind[a] ^ behind[b]).bit_length() + 7) // 8, lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        for deep, above, i, j in scan(common, [lefts[m] for m in members], low - 1):
            if above >= high:  # the longer strings end in a parent of this node
                continue
            least, most = max(low, above + 1), min(high, deep)
            if least <= most:
                own = members[i:j]
                yield own, most, length - least, min(docs[m] for m in own)


def repeats_in(f: Frames, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of a bucket's sorted frames: group, occurrence (its row), start and end around the anchor's position, least document; with
    all occurrences."""
    starts, n = f.classes(), len(f.key)
    sizes = np.diff(np.append(starts, n))
    keys = f.key[starts]
    alone = np.ones(len(starts), bool)
    alone[1:] &= keys[1:] != keys[:-1]
    alone[:-1] &= keys[1:] != keys[:-1]
    which: list[int] = []
    left: list[int] = []
    right: list[int] = []
    least: list[int] = []
    group: list[int] = []
    # A frame without others around its anchor is a tree of one leaf.
    lone = np.flatnonzero(alone & (f.left[starts].astype(int) + f.right[starts] >= length))
    several = np.flatnonzero(~alone)
    at = starts[several]
    for g, (own, a, b, d) in enumerate(groups(f.key[at], f.frame[at], f.left[at].astype(int), f.right[at].astype(int), f.doc[at], length)):
        which += own
        left += [a] * len(own)
        right += [b] * len(own)
        least += [d] * len(own)
        group += [g] * len(own)
    owner = np.append(several[np.array(which, np.int64)], lone)
    size = sizes[owner]
    row = np.repeat(starts[owner] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    spread = lambda x, y: np.repeat(np.append(np.array(x, np.int64), y.astype(np.int64)), size)
    last = group[-1] + 1 if group else 0
    return spread(group, last + np.arange(len(lone))), row, f.pos[row] - spread(left, f.left[starts[lone]]), f.pos[row] + spread(right, f.right[starts[lone]]), spread(least, f.doc[starts[lone]])


def _bucket_frames(blobs: list[bytes], length: int) -> Frames:
    doc, text, pos, left, right, frame = (np.concatenate(c) for c in zip(*map(unpack, blobs)))
    apart = left == APART
    key = string_hashes(frame[:, :GRAM])
    if apart.any():
        key[apart] = string_hashes(frame[apart][:, :length])
    return Frames(key, doc, text, pos, np.where(apart, 0, left).astype(np.uint8), right, frame).sorted()


def _find_repeats(length: int, doc_places: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def single(blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        f = _bucket_frames(blobs, length)
        _, row, start, end, least = repeats_in(f, length)
        go = f.doc[row] > least
        yield from _covered(f.doc[row][go], f.text[row][go], start[go], end[go], doc_places)

    return lambda batches: _by_place(batches, single)


def _cut_out(keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, spans, numbers = None, {}, {}
        for batch in sliced(batches, "text"):
            out = []
            for r in batch.to_pylist():
                if r["place"] != place:
                    place, spans, numbers = r["place"], {}, {}
                if r["blob"] is not None:
                    doc, text, start, end = unpack(r["blob"])
                    owner = _runs(doc, text)
                    for a, b in zip(owner, np.append(owner[1:], len(doc))):
                        spans.setdefault((int(doc[a]), int(text[a])), []).append((start[a:b], end[a:b]))
                    continue
                raw = r["text"].encode()
                number = numbers[r["doc"]] = numbers.get(r["doc"], -1) + 1
                own = spans.get((r["doc"], number), [])
                cover = np.zeros(len(raw) + 1, np.int32)
                for start, end in own:
                    np.add.at(cover, start, 1)
                    np.add.at(cover, end, -1)
                gone = np.cumsum(cover)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if own else raw
                edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                first, last = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
                out.append((r["doc_id"], len(raw), len(raw) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), list(zip(first.tolist(), last.tolist())) if keep_text else None, kept if keep_text else None))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
                columns = list(zip(*out))
                columns[5] = [None if x is None else [{"start": a, "end": b} for a, b in x] for x in columns[5]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


_SENT = "kind int, place long, blob binary"


def _plan(docs: DataFrame, anchors_a_bucket: int, bytes_a_place: int) -> tuple[DataFrame, int, int, int]:
    """Texts with their places; bits of buckets, number of places, and from how many occurrences on an anchor is very frequent."""
    own = documents(docs).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("xh"), "text")
    total = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, total * 0.08 / anchors_a_bucket)))))
    places = max(16, -(-total // bytes_a_place))
    return own, bits, places, max(10_000, int(total * 0.08) // 100_000)


def _with_texts(own: DataFrame, blobs: DataFrame, places: int) -> DataFrame:
    """Blobs and texts that belong to a place, blobs first."""
    texts = own.select(F.pmod(F.xxhash64("doc"), F.lit(places)).alias("place"), F.lit(None).cast("binary").alias("blob"), "doc_id", "doc", "xh", "text")
    coming = blobs.select("place", "blob", *(F.lit(None).cast("long").alias(c) for c in ("doc_id", "doc", "xh")), F.lit("").alias("text"))
    return texts.unionByName(coming).repartition(places, "place").sortWithinPartitions("place", F.col("blob").isNull(), "doc", "xh")


def _frames_sent(docs: DataFrame, length: int, anchors_a_bucket: int, bytes_a_place: int) -> tuple[DataFrame, DataFrame, int]:
    """Texts, frames dealt to buckets, number of places."""
    own, bits, places, often = _plan(docs, anchors_a_bucket, bytes_a_place)
    tasks = max(8, ((1 << bits) + places) // 24)  # some 24 buckets and places a task, one at a time in memory, however large the input
    dealt = own.select("doc", "text").mapInArrow(_find_anchors(length, bits, places), _SENT).repartition(tasks, "kind", "place").sortWithinPartitions("kind", "place")
    candidates = materialize(dealt.mapInArrow(_find_candidates(places, often), _SENT), "candidates")
    del dealt
    release(docs.sparkSession)
    # Anchors with more than 1 / 100,000 of all occurrences: 100,000 at most.
    hot = [unpack(r["blob"])[0] for r in candidates.where(F.col("kind") == TO_HASH).select("blob").collect()]
    sent = _with_texts(own, candidates.where(F.col("kind") == TO_DOC), places).mapInArrow(_send_frames(length, bits, places, np.sort(np.concatenate(hot)) if hot else np.empty(0, np.uint64)), _SENT)
    return own, sent.repartition(tasks, "kind", "place").sortWithinPartitions("kind", "place"), places


def remove_repeats(docs: DataFrame, length: int = 50, keep_text: bool = False, anchors_a_bucket: int = 1 << 18, bytes_a_place: int = 16 << 20) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with ``keep_text``,
    spans (start and end, in bytes) and kept (the bytes that stay), else nulls.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id. Texts are
    their UTF-8 bytes as given; a null text is an empty one. A null doc_id is larger than any other, and rows with it aren't
    smaller than one another; nor are rows that repeat a doc_id. Texts shorter than ``length`` stay whole. An empty table gives
    no rows. Other columns are left out.
    """
    own, sent, places = _frames_sent(docs, length, anchors_a_bucket, bytes_a_place)
    covered = materialize(sent.mapInArrow(_find_repeats(length, places), _SENT), "covered")
    del sent
    release(docs.sparkSession)
    out = _with_texts(own, covered, places).mapInArrow(_cut_out(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept binary")
    return out
