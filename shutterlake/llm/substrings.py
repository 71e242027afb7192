"""Removal of repeated substrings by merged Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller doc_id. To find these strings:

1. Every window of LENGTH bytes has an anchor: the place of the least hash of its GRAM-byte substrings. Equal windows
   have equal anchors, so windows need comparing only where their anchors' hashes occur in several documents.
2. The windows of one anchor lie in one stretch of text. Where all stretches around an anchor hash are equal, the
   least doc_id answers for all their windows. Stretches are equal if the 64-bit hashes of anchor and stretch are.
   The windows of an anchor with very many different stretches, as one at the edge of a common passage has, are dealt
   one by one, by their ends as well.
3. Else the different stretches meet in a hash bucket. Each shard's stretches have their own Burrows-Wheeler transform;
   these are merged by refining their interleave, one symbol at a time, which yields the common prefixes: positions
   whose prefixes of LENGTH bytes stay together are one repeated interval, and the least doc_id of each is its answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.chunks import Chunk, bucketed, buckets_for, rows_of, store_chunks, with_messages
from shutterlake.llm.common import HOT_KEYS, forget, forget_part, read, release, stored
from shutterlake.llm.kernels import _BYTE, _INV, _POW, _SLICE, hash_spans, mix

#: Bytes of a repeated string, and of the substrings whose least hash is an anchor.
LENGTH, GRAM = 50, 20
#: Bytes of stretches that make up a shard of their own when transforms are merged.
SHARD_BYTES = 1 << 17
#: An anchor with more different stretches than this, and than one for HOT_KEYS documents, is dealt window by window.
HOT_KINDS = 2000
#: Rounds of merging after which strings of a single document are left out.
CLOSE_EVERY = 4
#: No byte of a UTF-8 text; ends each stretch.
END = 0xFF


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the `size` bytes from each place on."""
    n = len(data) - size + 1
    out = np.empty(max(0, n), np.uint64)
    step = (_SLICE >> 2) - size
    for a in range(0, n, step):
        b = min(n, a + step)
        part = data[a : b + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POW[: len(part)], out=sums[1:])
        out[a:b] = mix((sums[size : size + b - a] - sums[: b - a]) * _INV[: b - a])
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, its document's row, and the first and last start of the windows that have it."""
    found: list[tuple[np.ndarray, ...]] = []
    reach = length - gram + 1
    # Runs of whole documents, or pieces of one long document that overlap by a window.
    for a, b, row in _runs(offsets, length):
        part = data[a:b]
        n = len(part) - length + 1
        if n <= 0:
            continue
        h = gram_hashes(part, gram)
        # The high bits decide, then the place: the leftmost of equals, whatever the text around.
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        span, least = 1, key
        while span * 2 <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:n], least[reach - span : reach - span + n])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int32)
        inside = offsets[row[0] : row[1] + 1] - a
        inside = np.clip(inside, 0, len(part))
        starts = np.ones(n, bool)
        starts[1:] = place[1:] != place[:-1]
        live = np.ones(n, bool)
        for edge in inside[1:-1]:  # windows over a document's end are none
            live[max(0, edge - length + 1) : edge] = False
            if edge < n:
                starts[edge] = True
        first = np.flatnonzero(starts & live)
        ends = np.zeros(n, bool)
        ends[:-1] = starts[1:] | ~live[1:]
        ends[-1] = True
        last = np.flatnonzero(ends & live)
        p = place[first]
        found.append((h[p], p.astype(np.int64) + a, np.searchsorted(inside, first, side="right") - 1 + row[0], first + a, last + a))
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_RUN = 1 << 20


def _runs(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, tuple[int, int]]]:
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _RUN, side="right")) - 1)
        end = min(end, n)
        a, b = int(offsets[row]), int(offsets[end])
        if end - row == 1 and b - a > _RUN:
            # Each window lies in exactly one piece.
            for k in range(a, b - length + 1, _RUN):
                yield k, min(b, k + _RUN + length - 1), (row, end)
        else:
            yield a, b, (row, end)
        row = end


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32-bit fingerprint of an anchor hash, as one number."""
    return ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _unique(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the index of each row's key among them, and whether several documents have it."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    index = np.empty(len(k), np.int64)
    index[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
    several = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start) if len(start) else np.empty(0, bool)
    return k[start], index, several


_TELL = "bucket int, chunk_id long, prints binary, several binary, counts binary"


def _kinds(c: Chunk, low: np.ndarray, high: np.ndarray, index: np.ndarray, several: np.ndarray) -> np.ndarray:
    """How many different stretches each fingerprint has in the chunk, for those that several documents have."""
    some = np.flatnonzero(several[index])
    stretch, own = hash_spans(c.data, low[some], high[some]), index[some]
    order = np.lexsort((stretch, own))
    stretch, own = stretch[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (stretch[1:] != stretch[:-1])
    return np.minimum(np.bincount(own[new], minlength=len(several))[several], 0xFFFF).astype("<u2")


def _tell(buckets: int):
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            c = Chunk(row)
            h, _, doc, low, last = anchors(c.data, c.offsets)
            keys, index, several = _unique(_keys(h, buckets), c.doc_ids[doc])
            kinds = np.zeros(len(keys), "<u2")
            kinds[several] = _kinds(c, low, last + LENGTH, index, several)
            at = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
            full = np.flatnonzero(np.diff(at))
            prints = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([c.id] * len(full), pa.int64()),
                    pa.array([prints[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()),
                    pa.array([np.packbits(several[at[b] : at[b + 1]]).tobytes() for b in full], pa.binary()),
                    pa.array([kinds[at[b] : at[b + 1]][several[at[b] : at[b + 1]]].tobytes() for b in full], pa.binary()),
                ],
                names=["bucket", "chunk_id", "prints", "several", "counts"],
            )

    return tell


_MASK = "chunk_id long, bucket int, mask binary"


def shared_masks(table: pa.Table) -> pa.Table:
    """For each chunk's list of fingerprints in a bucket: which of them other chunks, or several of its documents, have."""
    lists = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("prints")]
    several = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("several"), lists, strict=True)]
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = s[1:] == s[:-1]
    mask = np.zeros(len(s), bool)
    mask[order[1:][same]] = True
    mask[order[:-1][same]] = True
    mask |= np.concatenate(several)
    at = np.concatenate([[0], np.cumsum([len(p) for p in lists])])
    return pa.table(
        [table.column("chunk_id"), table.column("bucket"), pa.array([np.packbits(mask[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())],
        names=["chunk_id", "bucket", "mask"],
    )


def counted_masks(limit: int):
    def masks(table: pa.Table) -> pa.Table:
        """shared_masks(), and under the chunk_id -1 the fingerprints whose counts are more than `limit` together."""
        shared = shared_masks(table.drop_columns(["counts"]))
        prints = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("prints")]
        numbers = []
        for own, several, counts in zip(prints, table.column("several"), table.column("counts"), strict=True):
            n = np.ones(len(own), np.int64)
            n[np.unpackbits(np.frombuffer(several.as_buffer(), np.uint8), count=len(own)).astype(bool)] = np.frombuffer(counts.as_buffer(), "<u2")
            numbers.append(n)
        every, number = np.concatenate(prints), np.concatenate(numbers)
        order = np.argsort(every, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) != 0]))
        hot = every[order][start][np.add.reduceat(number[order], start) > limit]
        if not len(hot):
            return shared
        row = pa.table([pa.array([-1], pa.int64()), table.column("bucket").slice(0, 1), pa.array([hot.astype("<u4").tobytes()], pa.binary())], names=["chunk_id", "bucket", "mask"])
        return pa.concat_tables([shared, row])

    return masks


def hot_of(masks: DataFrame) -> bytes:
    """The sorted keys of counted_masks()'s hot fingerprints."""
    rows = masks.where("chunk_id = -1").select("bucket", "mask").collect()
    hot = [(np.uint64(r.bucket) << np.uint64(32)) | np.frombuffer(r.mask, "<u4").astype(np.uint64) for r in rows]
    return np.sort(np.concatenate(hot or [np.empty(0, np.uint64)])).tobytes()


def unpack_masks(messages: list[dict], keys: np.ndarray, buckets: int) -> np.ndarray:
    """The masks of a chunk's buckets as one flag for each of its sorted distinct keys."""
    at = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    flags = np.zeros(len(keys), bool)
    for m in messages:
        a, b = at[m["bucket"]], at[m["bucket"] + 1]
        flags[a:b] = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=b - a)
    return flags


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(x.tobytes() for x in arrays), 1)


def _expand(blob, *types: tuple[object, int]) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(bytes(blob)), [], 0
    for kind, n in types:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


_BLOCK = "bucket int, chunk_id long, n long, body binary"
#: Of each distinct (anchor hash, stretch hash): both hashes, the least doc_id, one stretch's start and size.
_BODY = ("<u8", "<u8", "<i8", "<u4", "u1")
#: Of each occurrence: the index of its (anchor hash, stretch hash) in the chunk, its document's row, start, windows.
_OCCURRENCE = ("<u4", "<u4", "<u4", "u1")


def _one_by_one(data: np.ndarray, h: np.ndarray, low: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of anchors' stretches each window alone: which anchor's it is, its start, and a key by its anchor and both its ends.

    Equal windows have equal keys. The windows over the edge of a passage that very many documents have differ at an end.
    """
    count = last - low + 1
    owner = np.repeat(np.arange(len(h)), count)
    start = _ranges(low, count)
    fours = np.ndarray(max(0, len(data) - 3), "<u4", data.tobytes(), strides=(1,))
    ends = fours[start].astype(np.uint64) | fours[start + LENGTH - 4].astype(np.uint64) << np.uint64(32)
    return owner, start, mix(h[owner] ^ mix(ends))


def _gather(buckets: int, sent):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys = np.frombuffer(sent.value, np.uint64)
        for row in rows_of(batches):
            c = Chunk(row)
            h, place, doc, low, last = anchors(c.data, c.offsets)
            every = _keys(h, buckets)
            keys, index, _ = _unique(every, doc)
            keep = unpack_masks(row["messages"], keys, buckets)[index]
            h, place, doc, low, last, every = (x[keep] for x in (h, place, doc, low, last, every))
            if len(hot_keys):
                hot = hot_keys[np.minimum(np.searchsorted(hot_keys, every), len(hot_keys) - 1)] == every
                owner, start, key = _one_by_one(c.data, h[hot], low[hot], last[hot])
                h, place, doc = np.append(h[~hot], key), np.append(place[~hot], start), np.append(doc[~hot], doc[hot][owner])
                low, last = np.append(low[~hot], start), np.append(last[~hot], start)
            high = last + LENGTH
            stretch = mix(hash_spans(c.data, low, high) + (place - low).astype(np.uint64))
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((stretch, h, bucket))
            hs, cs, bs = h[order], stretch[order], bucket[order]
            new = np.ones(len(order), bool)
            new[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1]) | (bs[1:] != bs[:-1])
            start = np.flatnonzero(new)
            own = np.empty(len(order), np.int64)
            own[order] = np.cumsum(new) - 1
            least = np.minimum.reduceat(c.doc_ids[doc[order]], start) if len(start) else np.empty(0, np.int64)
            one = order[start]
            columns = [hs[start], cs[start], least, low[one], high[one] - low[one]]
            columns = [x.astype(t) for x, t in zip(columns, _BODY, strict=True)]
            at = np.searchsorted(bs[start], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(at))
            bodies = [_squeeze(*(x[at[b] : at[b + 1]] for x in columns)) for b in full]
            occurrence = [x.astype(t) for x, t in zip((own, doc, low, last - low + 1), _OCCURRENCE, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*full, -1], pa.int32()),
                    pa.array([c.id] * (len(full) + 1), pa.int64()),
                    pa.array([*np.diff(at)[full], len(own)], pa.int64()),
                    pa.array([*bodies, _squeeze(*occurrence)], pa.binary()),
                ],
                names=["bucket", "chunk_id", "n", "body"],
            )

    return gather


class Meeting:
    """All chunks' entries of one bucket, grouped by anchor hash and by stretch within it."""

    def __init__(self, counts: list[int], bodies: list) -> None:
        parts = [_expand(b, *((t, n) for t in _BODY)) for b, n in zip(bodies, counts, strict=True)]
        self.h, self.c, self.doc, self.low, self.size = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.chunk = np.repeat(np.arange(len(counts)), counts)
        self.at = np.concatenate([[0], np.cumsum(counts)])
        self.order = np.lexsort((self.chunk, self.c, self.h))
        h, c, doc = self.h[self.order], self.c[self.order], self.doc[self.order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        g, s = np.flatnonzero(new_h), np.flatnonzero(new_c)
        self.group = np.cumsum(new_h) - 1
        self.kind = np.cumsum(new_c) - 1
        #: For each group: least doc_id; whether documents differ; whether stretches differ.
        self.least = np.minimum.reduceat(doc, g)
        several = self.least != np.maximum.reduceat(doc, g)
        kinds = np.add.reduceat(new_c.astype(np.int64), g)
        #: An entry holds its chunk's least document only, so one stretch in one chunk may still have several.
        self.open = (kinds > 1) & several
        self.first = s
        self.kind_least = np.minimum.reduceat(doc, s)
        self.kind_open = self.open[self.group[s]]


#: What a row of a bucket's messages holds.
ASKED, CLOSED, STATE, FETCHED = range(4)
_TOLD = "chunk_id long, bucket int, what int, n long, body binary"


def _messages(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["chunk_id", "bucket", "what", "n", "body"])


def _ask(table: pa.Table) -> pa.Table:
    """A bucket's answers where all stretches of an anchor are equal; for the others its requests and its own notes.

    CLOSED, for a chunk: of each of its entries whether it is open, and of each closed one the least document.
    ASKED, for a chunk: number, start and size of the open stretches that this chunk is to send, each from one chunk.
    STATE, for the bucket itself: of each open stretch the least document that has it whole and its windows; of each
    chunk the numbers of its open entries' stretches.
    """
    bucket = table.column("bucket")[0].as_py()
    chunk_ids, counts = table.column("chunk_id").to_pylist(), table.column("n").to_pylist()
    m = Meeting(counts, [x.as_buffer() for x in table.column("body")])
    kind_of = np.empty(len(m.h), np.int64)
    kind_of[m.order] = m.kind
    is_open = m.kind_open[kind_of]
    single = np.empty(len(m.h), np.int64)
    single[m.order] = m.least[m.group]
    number = np.cumsum(m.kind_open) - 1
    chosen = m.order[m.first[m.kind_open]]  # one entry of each open stretch, in the order of their numbers
    by_chunk = np.argsort(m.chunk[chosen], kind="stable")
    at = np.searchsorted(m.chunk[chosen][by_chunk], np.arange(len(counts) + 1))
    out = []
    for k, (chunk_id, a, b) in enumerate(zip(chunk_ids, m.at, m.at[1:], strict=False)):
        out.append((chunk_id, bucket, CLOSED, int(b - a), _squeeze(is_open[a:b], single[a:b][~is_open[a:b]].astype("<i8"))))
        if at[k] < at[k + 1]:
            mine = by_chunk[at[k] : at[k + 1]]
            out.append((chunk_id, bucket, ASKED, len(mine), _squeeze(mine.astype("<u4"), m.low[chosen[mine]].astype("<u4"), m.size[chosen[mine]].astype("u1"))))
    if len(chosen):
        kinds = [number[kind_of[a:b][is_open[a:b]]].astype("<u4") for a, b in zip(m.at, m.at[1:], strict=False)]
        full = [k for k, x in enumerate(kinds) if len(x)]
        lengths = np.array([len(chosen), len(full)], "<i8")
        parts = [m.kind_least[m.kind_open].astype("<i8"), m.size[chosen].astype("u1"), np.array([chunk_ids[k] for k in full], "<i8"), np.array([len(kinds[k]) for k in full], "<i8")]
        out.append((-1, bucket, STATE, 1, _squeeze(lengths, *parts, *(kinds[k] for k in full))))
    return pa.Table.from_batches([_messages(out)])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches that buckets ask for, one block per chunk and bucket."""
    for row in rows_of(batches):
        c = Chunk(row)
        raw = c.data.tobytes()
        out = []
        for m in row["messages"]:
            kind, low, size = _expand(m["body"], ("<u4", m["n"]), ("<u4", m["n"]), ("u1", m["n"]))
            text = b"".join(raw[a : a + n] for a, n in zip(low.tolist(), size.tolist(), strict=True))
            out.append((c.id, m["bucket"], FETCHED, m["n"], zstandard.compress(kind.tobytes() + size.tobytes() + text, 1)))
        yield _messages(out)


def shard_transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted rotations of a shard's text (by at least `depth` bytes), its Burrows-Wheeler transform, its last-to-first map.

    Eight bytes at once decide first; only rotations that are still tied are then told apart, by doubled lengths.
    """
    n = len(text)
    # A rotation's rank is the first place that those tied with it take.
    key = np.ndarray(n, ">u8", np.resize(text, n + 7).tobytes(), strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    tied, size = np.arange(n), 8
    border = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    while True:
        rank[order[tied]] = np.maximum.accumulate(np.where(border, tied, 0))
        alone = border & np.append(border[1:], True)
        tied = tied[~alone]
        if size >= depth or not len(tied):
            break
        place = order[tied]
        key = rank[place] * n + rank[(place + size) % n]
        again = np.argsort(key)
        order[tied], key = place[again], key[again]
        border = np.concatenate([[True], key[1:] != key[:-1]])
        size *= 2
    position = np.empty(n, np.int32)
    position[order] = np.arange(n, dtype=np.int32)
    return order, text[order - 1], position[order - 1]


def merge_transforms(shards: list[np.ndarray], depth: int, ends: np.ndarray | None = None, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All shards' suffixes in the order of their first `depth` bytes, and the common prefix of each with the one before.

    The second array is the length, `depth` if at least that. The interleave starts as the shards one after another;
    each round takes the next symbol of every suffix's transform in the present order and deals the suffixes out by
    it, so that after k rounds they are in the order of k bytes. A border that appears in round k has the prefix k - 1.

    Given `ends`, places in the shards' texts one after another, only the strings of `depth` bytes before them are
    merged: each round follows the suffixes that they pass through, and those whose bytes so far are shared by a single
    `owner` are left out from then on. The first array then has the indices of the strings that are left, in order; the
    second has `depth` where a string equals the one before, else 0.
    """
    sa, bwt, lf, shift = [], [], [], 0
    for text in shards:
        order, symbols, back = shard_transform(text, depth)
        sa.append(order + shift)
        bwt.append(symbols)
        lf.append(back + np.int32(shift))
        shift += len(text)
    sa, bwt, lf = np.concatenate(sa), np.concatenate(bwt), np.concatenate(lf)
    if ends is None:
        current, index = np.arange(shift, dtype=np.int32), None
    else:
        current = np.empty(shift, np.int32)
        current[sa] = np.arange(shift, dtype=np.int32)
        current = current[ends]
        index = np.argsort(current)
        current = current[index]
    prefix = np.full(len(current), depth, np.int32)
    block, border = np.zeros(len(current), np.int32), np.zeros(len(current), bool)
    for k in range(1, depth + 1):
        symbol = bwt[current]
        dealt = np.argsort(symbol, kind="stable")  # bytes are dealt by counting
        symbol, block, current = symbol[dealt], block[dealt], lf[current[dealt]]
        border = np.empty(len(current), bool)
        border[:1] = True
        np.not_equal(symbol[1:], symbol[:-1], out=border[1:])
        border[1:] |= block[1:] != block[:-1]
        if index is None:
            prefix[border & (prefix == depth)] = k - 1
        else:
            index = index[dealt]
            if k % CLOSE_EVERY == 0 or k == depth:
                start = np.flatnonzero(border)
                own = owner[index]
                several = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start) if len(start) else np.empty(0, bool)
                left = np.repeat(several, np.diff(np.append(start, len(own))))
                index, current, border = index[left], current[left], border[left]
        block = np.cumsum(border, dtype=np.int32)
    if index is None:
        return sa[current], prefix
    return index, np.where(border, 0, depth)


def least_documents(texts: list[list[bytes]], docs: list[np.ndarray], depth: int = LENGTH) -> list[np.ndarray]:
    """For each shard's stretches, one after another, the least document among all that have each window of `depth` bytes."""
    end = bytes([END])
    shards = [np.frombuffer(end.join(t) + end, np.uint8) for t in texts]
    size = np.array([len(x) for t in texts for x in t])
    windows = np.maximum(0, size - depth + 1)
    cut = np.concatenate([[0], np.cumsum(windows)])
    stretch = np.repeat(np.arange(len(size)), windows)
    start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    ends = start[stretch] + np.arange(cut[-1]) - cut[stretch] + depth
    answer = np.concatenate(docs)[stretch]
    index, prefix = merge_transforms(shards, depth, ends, answer)
    interval = np.flatnonzero(prefix < depth)
    if len(interval):
        answer[index] = np.repeat(np.minimum.reduceat(answer[index], interval), np.diff(np.append(interval, len(index))))
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return [answer[cut[a] : cut[b]] for a, b in zip(first, first[1:], strict=False)]


_ANSWER = "chunk_id long, bucket int, n long, body binary"


def _answer(shard_bytes: int):
    def answer(table: pa.Table) -> pa.Table:
        """For each chunk with open entries in a bucket the least document of each of their windows, in order."""
        bucket = table.column("bucket")[0].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("chunk_id", "what", "n", "body")), strict=True))
        state = zstandard.decompress(next(body for _, what, _, body in rows if what == STATE))
        n_kinds, n_chunks = np.frombuffer(state, "<i8", 2).tolist()
        least_of, at = np.frombuffer(state, "<i8", n_kinds, 16), 16 + 8 * n_kinds
        windows, at = np.frombuffer(state, "u1", n_kinds, at).astype(np.int64) - LENGTH + 1, at + n_kinds
        chunk_ids, counts = np.frombuffer(state, "<i8", n_chunks, at), np.frombuffer(state, "<i8", n_chunks, at + 8 * n_chunks)
        kinds = np.split(np.frombuffer(state, "<u4", offset=at + 16 * n_chunks), np.cumsum(counts)[:-1])
        start = np.concatenate([[0], np.cumsum(windows)])
        least = np.empty(start[-1], np.int64)
        shards: list[tuple[list[bytes], np.ndarray]] = []
        texts: list[bytes] = []
        numbers: list[np.ndarray] = []
        held = 0
        for _, _, n, body in sorted(r for r in rows if r[1] == FETCHED):
            raw = zstandard.decompress(body)
            size = np.frombuffer(raw, "u1", n, 4 * n)
            cut = (5 * n + np.concatenate([[0], np.cumsum(size, dtype=np.int64)])).tolist()
            texts += [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            numbers.append(np.frombuffer(raw, "<u4", n))
            held += cut[-1] - cut[0]
            if held >= shard_bytes:
                shards.append((texts, np.concatenate(numbers)))
                texts, numbers, held = [], [], 0
        if texts:
            shards.append((texts, np.concatenate(numbers)))
        found = least_documents([t for t, _ in shards], [least_of[k] for _, k in shards])
        for (_, k), values in zip(shards, found, strict=True):
            least[_ranges(start[k], windows[k])] = values
        bodies = [_squeeze(least[_ranges(start[k], windows[k])].astype("<i8")) for k in kinds]
        sizes = [int(windows[k].sum()) for k in kinds]
        return pa.table([pa.array(chunk_ids, pa.int64()), pa.array([bucket] * n_chunks, pa.int32()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], names=["chunk_id", "bucket", "n", "body"])

    return answer


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(c: Chunk, messages: list[dict]) -> np.ndarray:
    """Which bytes of the chunk go."""
    n = len(c.data)
    steps = np.zeros(n + 1, np.int64)
    lists = [m for m in messages if m["bucket"] < 0]
    closed = sorted((m for m in messages if m["bucket"] >= 0 and m["what"] == CLOSED), key=lambda m: m["bucket"])
    answers = sorted((m for m in messages if m["bucket"] >= 0 and m["what"] != CLOSED), key=lambda m: m["bucket"])
    if not closed or not lists:
        return np.zeros(n, bool)
    own, doc, low, count = _expand(lists[0]["body"], *((t, lists[0]["n"]) for t in _OCCURRENCE))
    flags, values = [], []
    for m in closed:
        raw = zstandard.decompress(bytes(m["body"]))
        flags.append(np.frombuffer(raw, bool, m["n"]))
        values.append(np.frombuffer(raw, "<i8", offset=m["n"]))
    is_open = np.concatenate(flags)
    single = np.empty(len(is_open), np.int64)
    single[~is_open] = np.concatenate(values)
    doc, low, count = c.doc_ids[doc], low.astype(np.int64), count.astype(np.int64)
    one = ~is_open[own] & (single[own] < doc)
    np.add.at(steps, low[one], 1)
    np.add.at(steps, low[one] + count[one] - 1 + LENGTH, -1)
    if answers:
        least = np.concatenate([np.frombuffer(zstandard.decompress(bytes(m["body"])), "<i8") for m in answers])
        # An entry has as many windows as each of its occurrences.
        windows = np.zeros(len(is_open), np.int64)
        windows[own] = count
        windows[~is_open] = 0
        start = np.cumsum(windows) - windows
        many = np.flatnonzero(is_open[own])
        hit = least[_ranges(start[own[many]], count[many])] < np.repeat(doc[many], count[many])
        at = _ranges(low[many], count[many])[hit]
        np.add.at(steps, at, 1)
        np.add.at(steps, at + LENGTH, -1)
    return np.cumsum(steps[:-1]) > 0


def _finish(keep_bytes: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            c = Chunk(row)
            gone = covered(c, row["messages"] or [])
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[c.offsets[1:]] - total[c.offsets[:-1]]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = c.offsets[:-1][c.offsets[:-1] < len(gone)]
            begins[edge] = gone[edge]
            total = np.concatenate([[0], np.cumsum(begins)])
            spans = total[c.offsets[1:]] - total[c.offsets[:-1]]
            kept = []
            for i, (a, b) in enumerate(zip(c.offsets, c.offsets[1:], strict=False)):
                kept.append((c.data[a:b][~gone[a:b]] if removed[i] else c.data[a:b]).tobytes())
            columns = [c.ids(), pa.array(np.diff(c.offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return finish


def deduplicated(docs: DataFrame, keep_bytes: bool = False, shard_bytes: int = SHARD_BYTES, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """For each row of docs(doc_id, text) what is left without repeated strings: n_bytes, n_removed, n_spans, kept_sha256.

    With keep_bytes also `kept`, the bytes left (they may break a character, so they are binary). Null and empty texts
    have no bytes; texts of fewer than LENGTH bytes lose none. A text of any length is whole in one chunk and compared
    throughout, in pieces that overlap by a string. Rows that share a doc_id don't take from each other, so of equal
    texts those with the least doc_id all keep theirs. A null doc_id counts as larger than all others. An empty table
    gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    stored_chunks = store_chunks(docs.select("doc_id", "text"), "substrings")
    chunks = stored_chunks.drop("others")
    buckets = buckets_for(stored_chunks)
    told = chunks.mapInArrow(_tell(buckets), _TELL)
    masks = stored(bucketed(told, counted_masks(max(hot_kinds, docs.count() // HOT_KEYS)), _MASK, buckets), "masks")
    release(spark)
    sent = spark.sparkContext.broadcast(hot_of(masks))  # at most HOT_KEYS times the mean number of a document's anchors
    # Each step's rows are stored, so that what the step before has shuffled can go.
    blocks = stored(with_messages(chunks, masks.where("chunk_id >= 0"), keep_all=False).mapInArrow(_gather(buckets, sent), _BLOCK).withColumn("occurrences", F.col("bucket") < 0), "anchors", "occurrences")
    release(spark)
    said = stored(bucketed(blocks.where("NOT occurrences").drop("occurrences"), _ask, _TOLD, buckets), "answers")
    forget_part(blocks, "occurrences=false")
    release(spark)
    fetched = with_messages(chunks, said.where(F.col("what") == ASKED).drop("what"), keep_all=False).mapInArrow(_fetch, _TOLD)
    answers = bucketed(said.where(F.col("what") == STATE).unionByName(fetched), _answer(shard_bytes), _ANSWER, buckets)
    lists = blocks.where("occurrences").select("chunk_id", "bucket", "n", "body")
    replies = said.where(F.col("what") == CLOSED).unionByName(answers.unionByName(lists).withColumn("what", F.lit(None).cast("int")))
    final = with_messages(chunks, replies, keep_all=True)
    out = stored(final.mapInArrow(_finish(keep_bytes), _RESULT + (", kept binary" if keep_bytes else "")), "substrings-result")
    for table in (masks, said, blocks, stored_chunks):
        forget(table)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents without the 50-byte strings that start in a document with a smaller doc_id."""
    return deduplicated(read(spark, sf_dir, "documents"))


SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS p FROM h)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
u AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE m < doc_id),
b AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM u),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM b),
s AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM k GROUP BY 1, 2),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
q AS (SELECT t.doc_id, sum(b - a)::BIGINT AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM t JOIN h USING (doc_id) GROUP BY 1)
SELECT h.doc_id, h.n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM h LEFT JOIN q USING (doc_id)
"""
