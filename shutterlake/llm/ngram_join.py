"""Join of documents by the Jaccard similarity of their word n-grams, over count vectors in R-trees.

Tokens (hashed n-grams) fall into GROUPS groups; a document's numbers of tokens per group are a point. The overlap of
two documents is at most the sum of the smaller of each pair of coordinates, and that of a document with all points in
a box at most the sum of its coordinates' minima with the box's upper corner. R-trees over the points give the pairs
whose bound reaches the threshold; these are verified on the token sets.

One tree over a whole corpus would compare nearly everything in so many dimensions. So trees are built over the
documents that share a token among their first tokens in hash order, which documents similar enough must. Tokens that
very many documents have, such as those of a common line, come last in this order, so that they only count where a
document has little else. A document few of whose first tokens occur elsewhere is left out beforehand. Documents with equal sets are one class throughout.
All trees first try to link their members to one of them, that most of whose tokens occur elsewhere; pairs are looked
for only across what isn't connected then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.chunks import Chunk, bucketed, buckets_for, row_id, rows_of, store_chunks, with_messages
from shutterlake.llm.common import HOT_KEYS, copied_join, forget, hot_limit, read, release, shares_of, spread_join, standing_on, stored
from shutterlake.llm.components import components
from shutterlake.llm.kernels import SPACED, combined, groups, mix, words
from shutterlake.llm.substrings import _MASK, _TELL, _unique, counted_masks, hot_of, unpack_masks

#: Tokens that more documents have among their first ones than this, and than one in HOT_KEYS, come last in all orders.
HOT_TOKEN_ROWS = 1000

NGRAM = 5
#: Similarity threshold as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Groups of tokens, that is dimensions of the points; points in an R-tree's leaf, children of its other nodes.
GROUPS, LEAF = 256, 16
#: A tree of this many documents is one leaf, whose members are compared pair by pair; rounds after which all pairs
#: left are verified.
SMALL_TREE, ROUNDS = LEAF, 3
#: The turn that tells all pairs at once.
ALL = -1
#: Documents of a large tree that ask for their pairs before the last round.
ASKING = 64

#: Routing keys in one bucket, and the least number of buckets.
BUCKET_KEYS, LEAST_BUCKETS = 1 << 19, 8
#: Classes whose sets are fetched by a broadcast of their places (about 10 MB); more are joined by a shuffle.
BROADCAST_CLASSES = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def token_sets(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct token hashes of each row, one row after another, and their bounds.

    ASCII capitals count as small letters; words are what spaces and tabs to carriage returns separate. A row of fewer
    words than n has the whole sequence as one token, a row without words none.
    """
    tokens, sizes = [], []
    for a, b in groups(offsets):
        own = offsets[a : b + 1] - offsets[a]
        hashes, at = words(_LOWER[data[offsets[a] : offsets[b]]], own, SPACED)
        count = np.diff(at)
        row = np.repeat(np.arange(b - a), count)
        keys, rows = [], []
        for k in range(1, n + 1):
            h = combined(hashes, tuple(range(k)))
            first = row[: len(h)]
            fits = (first == row[k - 1 : k - 1 + len(h)]) & ((count[first] == k) if k < n else True)
            keys.append(h[fits])
            rows.append(first[fits])
        keys, rows = np.concatenate(keys), np.concatenate(rows)
        order = np.lexsort((keys, rows))
        keys, rows = keys[order], rows[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        tokens.append(keys[new])
        sizes.append(np.bincount(rows[new], minlength=b - a))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    return (np.concatenate(tokens) if tokens else np.empty(0, np.uint64)), bounds


def least_overlap(size: np.ndarray) -> np.ndarray:
    """What a set of this size must share with any set similar enough."""
    return -(-NUMERATOR * size // DENOMINATOR)


def pair_overlap(size: np.ndarray) -> np.ndarray:
    """What two sets must share, by the sum of their sizes."""
    return -(-NUMERATOR * size // (NUMERATOR + DENOMINATOR))


def extra(size: np.ndarray) -> np.ndarray:
    """How many shared tokens are asked for among the first ones before a document is compared at all."""
    return np.minimum(least_overlap(size), np.maximum(1, -(-size // 10)))


def _first_tokens(tokens: np.ndarray, bounds: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the tokens among which similar rows share extra() ones: which they are, their row, their rank.

    Tokens are in the order of their hashes, the hot ones after all others.
    """
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    rank = np.arange(len(tokens)) - bounds[row]
    if hot is not None and hot.any():
        late = np.cumsum(hot) - hot
        late -= late[bounds[row]]  # hot tokens of the row before each token
        n_hot = np.bincount(row[hot], minlength=len(size))
        rank = np.where(hot, size[row] - n_hot[row] + late, rank - late)
    first = rank < (size - least_overlap(size) + extra(size))[row]
    return first, row, rank


def _fitting(most: int) -> str:
    """The smallest type that holds counts up to `most`."""
    return "u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"


def _points(blob: bytes, n: int) -> np.ndarray:
    """n points, whose type shows in their size."""
    return np.frombuffer(blob, {1: "u1", 2: "<u2", 4: "<u4"}[len(blob) // (n * GROUPS)]).reshape(n, GROUPS)


def _bucket_keys(tokens: np.ndarray, buckets: int) -> np.ndarray:
    spread = mix(tokens)
    return ((spread >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (spread & np.uint64(0xFFFFFFFF))


def _tell(buckets: int):
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in rows_of(batches):
            c = Chunk(line)
            tokens, bounds = token_sets(c.data, c.offsets)
            first, row, _ = _first_tokens(tokens, bounds)
            keys, index, several = _unique(_bucket_keys(tokens[first], buckets), row[first])
            # A document has a token once, so that these are numbers of documents.
            counts = np.minimum(np.bincount(index, minlength=len(keys)), 0xFFFF).astype("<u2")
            at = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
            full = np.flatnonzero(np.diff(at))
            prints = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([c.id] * len(full), pa.int64()),
                    pa.array([prints[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()),
                    pa.array([np.packbits(several[at[b] : at[b + 1]]).tobytes() for b in full], pa.binary()),
                    pa.array([counts[at[b] : at[b + 1]][several[at[b] : at[b + 1]]].tobytes() for b in full], pa.binary()),
                ],
                names=["bucket", "chunk_id", "prints", "several", "counts"],
            )

    return tell


_DOC = "chunk_id long, row int, doc_id long, n_shingles long, class binary, share double, keys binary, point binary, tokens binary"


def _describe(buckets: int, sent):
    """Size and class of every document; tokens, point and routing keys of those that may have a partner."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys = np.frombuffer(sent.value, np.uint64)
        for line in rows_of(batches):
            c = Chunk(line)
            tokens, bounds = token_sets(c.data, c.offsets)
            size = np.diff(bounds)
            told, row, _ = _first_tokens(tokens, bounds)
            keys, index, _ = _unique(_bucket_keys(tokens[told], buckets), row[told])
            shared = np.zeros(len(tokens), bool)
            shared[told] = unpack_masks(line["messages"] or [], keys, buckets)[index]
            hot = None
            if len(hot_keys):
                every = _bucket_keys(tokens, buckets)
                hot = hot_keys[np.minimum(np.searchsorted(hot_keys, every), len(hot_keys) - 1)] == every
            first, row, rank = _first_tokens(tokens, bounds, hot)
            # Tokens that are among the first only because hot ones came last were not told: they may be shared.
            shared = first & (shared | ~told)
            wanted = (np.bincount(row[shared], minlength=len(size)) >= extra(size)) & (size > 0)
            route = shared & (rank <= (size - least_overlap(size))[row])
            share = np.bincount(row[route], minlength=len(size)) / (size - least_overlap(size) + 1)
            # Equal sets have equal sums of two mixes of their tokens, 128 bits together; other sets don't.
            sums = []
            for salt in (np.uint64(0), np.uint64(0x9E3779B97F4A7C15)):
                total = np.append(np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ salt), dtype=np.uint64))
                sums.append(mix(total[bounds[1:]] - total[bounds[:-1]] + mix(size.astype(np.uint64) ^ salt)))
            sums = np.column_stack(sums)
            blobs = [
                (tokens[a:b][route[a:b]].tobytes(), np.bincount((tokens[a:b] & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(_fitting(b - a)).tobytes(), tokens[a:b].tobytes()) if w else (None, None, None)
                for a, b, w in zip(bounds, bounds[1:], wanted, strict=False)
            ]
            for a in range(0, len(size), 1024):
                part = slice(a, a + 1024)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(size[part]), c.id), pa.int64()),
                        pa.array(np.arange(a, a + len(size[part])), pa.int32()),
                        c.ids()[part],
                        pa.array(size[part], pa.int64()),
                        pa.array([x.tobytes() if n else None for x, n in zip(sums[part], size[part], strict=True)], pa.binary()),
                        pa.array(share[part], pa.float64()),
                        *(pa.array([x[k] for x in blobs[part]], pa.binary()) for k in range(3)),
                    ],
                    names=["chunk_id", "row", "doc_id", "n_shingles", "class", "share", "keys", "point", "tokens"],
                )

    return describe


_ROUTED = "bucket int, n long, classes binary, sizes binary, labels binary, shares binary, points binary, keys binary, owners binary"


def _route(buckets: int):
    """Packs batches of at most 2**16 classes(class, n_shingles, label, keys, point) for the buckets of their keys."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            if len(batch) > 1 << 15:
                yield from route(batch.slice(k, 1 << 15) for k in range(0, len(batch), 1 << 15))
                continue
            lists = [np.frombuffer(k.as_buffer(), np.uint64) for k in batch.column("keys")]
            keys = np.concatenate(lists)
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            bucket = ((mix(keys) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            classes, sizes, labels = (batch.column(c).to_numpy().astype("<i8") for c in ("class", "n_shingles", "label"))
            shares = batch.column("share").to_numpy()
            points = np.concatenate([_points(p.as_py(), 1) for p in batch.column("point")])
            points = points.astype(_fitting(int(points.max(initial=0))))
            for b in np.flatnonzero(np.diff(at)):
                mine = order[at[b] : at[b + 1]]
                who, index = np.unique(owner[mine], return_inverse=True)
                binaries = (classes[who], sizes[who], labels[who], shares[who], points[who], keys[mine], index.astype("<u2"))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(who)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in binaries)], names=["bucket", "n", "classes", "sizes", "labels", "shares", "points", "keys", "owners"])

    return route


class Tree:
    """An R-tree over points and set sizes, packed by repeatedly halving along the coordinate of greatest spread."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.points, self.sizes = points, sizes
        order, parts = np.arange(len(points)), [(0, len(points))]
        while max(b - a for a, b in parts) > LEAF:
            halves = []
            for a, b in parts:
                if b - a <= LEAF:
                    halves.append((a, b))
                    continue
                own = order[a:b]
                values = np.column_stack([points[own], sizes[own]])
                middle = (b - a) // 2
                axis = int(values.std(axis=0).argmax())
                order[a:b] = own[np.argpartition(values[:, axis], middle)]
                halves += [(a, a + middle), (a + middle, b)]
            parts = halves
        self.order = order
        # Levels from the leaves up; each node's range of children on the level below.
        spans = np.array(parts)
        box = lambda a, b: (points[order[a:b]].max(axis=0), sizes[order[a:b]].min(), sizes[order[a:b]].max())
        upper, small, large = (np.array(x) for x in zip(*(box(a, b) for a, b in parts), strict=True))
        self.levels = [(spans, upper, small, large)]
        while len(spans) > LEAF:
            starts = np.arange(0, len(spans), LEAF)
            spans = np.column_stack([starts, np.minimum(starts + LEAF, len(upper))])
            upper, small, large = np.maximum.reduceat(upper, starts), np.minimum.reduceat(small, starts), np.maximum.reduceat(large, starts)
            self.levels.append((spans, upper, small, large))

    def probe(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs (query, point), queries among the tree's own points, whose bound reaches the threshold."""
        for at in range(0, len(which), 64):
            query = which[at : at + 64]
            q, node = np.repeat(query, len(self.levels[-1][0])), np.tile(np.arange(len(self.levels[-1][0])), len(query))
            for level in range(len(self.levels) - 1, -1, -1):
                spans, upper, small, large = self.levels[level]
                n = self.sizes[q]
                sized = (large[node] * DENOMINATOR >= n * NUMERATOR) & (n * DENOMINATOR >= small[node] * NUMERATOR)
                q, node = q[sized], node[sized]
                ok = self._bound(q, upper, node) >= pair_overlap(self.sizes[q] + np.maximum(small[node], least_overlap(self.sizes[q])))
                q, node = q[ok], node[ok]
                count = spans[node, 1] - spans[node, 0]
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                q, node = np.repeat(q, count), np.repeat(spans[node, 0], count) + inner
            p = self.order[node]
            ok = likely(self.points, self.sizes, q, p)
            yield q[ok], p[ok]

    def _bound(self, q: np.ndarray, upper: np.ndarray, node: np.ndarray) -> np.ndarray:
        return overlap_bound(self.points, q, upper, node)


def overlap_bound(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of left[a] and right[b]."""
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 1 << 14):
        out[k : k + (1 << 14)] = np.minimum(left[a[k : k + (1 << 14)]], right[b[k : k + (1 << 14)]]).sum(axis=1, dtype=np.int32)
    return out


def likely(points: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes and bounds leave it possible that the pairs are similar enough."""
    ok = (sizes[a] * DENOMINATOR >= sizes[b] * NUMERATOR) & (sizes[b] * DENOMINATOR >= sizes[a] * NUMERATOR)
    some = np.flatnonzero(ok)
    ok[some] = overlap_bound(points, a[some], points, b[some]) >= pair_overlap(sizes[a[some]] + sizes[b[some]])
    return ok


def tree_pairs(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, shares: np.ndarray, ranks: np.ndarray, turn: int, small: int = SMALL_TREE) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs to verify among documents that share a token and aren't all connected; whether more may be left.

    The first turn pairs all with the one of greatest share, the same one in all trees that have it.
    """
    m = len(points)
    if turn == 0:
        centre = int(np.lexsort((ranks, -shares))[0])
        b = np.flatnonzero(np.arange(m) != centre)
        a = np.full(m - 1, centre)
        ok = likely(points, sizes, a, b)
        return a[ok], b[ok], m > 2
    names, label, count = np.unique(labels, return_inverse=True, return_counts=True)
    if m <= small:
        a, b = np.triu_indices(m, 1)
        ok = label[a] != label[b]
        a, b = a[ok], b[ok]
        ok = likely(points, sizes, a, b)
        return a[ok], b[ok], False
    # Only what isn't in the largest component asks; whatever is in another one answers.
    asking = np.flatnonzero(label != count.argmax())
    if ALL < turn < ROUNDS - 1 and len(asking) > ASKING:
        # Many left: each turn asks for some of them, those that the turn's hash puts first.
        asking = asking[np.argsort(mix(ranks[asking].astype(np.uint64) + np.uint64(turn)))[:ASKING]]
        more = True
    else:
        more = False
    tree, left, right = Tree(points, sizes), [], []
    for q, p in tree.probe(asking):
        ok = label[q] != label[p]
        left.append(np.minimum(q[ok], p[ok]))
        right.append(np.maximum(q[ok], p[ok]))
    return np.concatenate(left), np.concatenate(right), more


_PAIR = "a long, others binary, more boolean"


def _pairs(turn: int, small: int):
    def pairs(table: pa.Table) -> pa.Table:
        counts = table.column("n").to_numpy()
        join = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
        classes, sizes, labels, shares, keys = join("classes", "<i8"), join("sizes", "<i8"), join("labels", "<i8"), join("shares", "<f8"), join("keys", np.uint64)
        points = np.concatenate([_points(x.as_py(), n) for x, n in zip(table.column("points"), counts.tolist(), strict=True)])
        owners = [np.frombuffer(x.as_buffer(), "<u2") for x in table.column("owners")]
        who = np.concatenate([o.astype(np.int64) + s for o, s in zip(owners, np.cumsum(counts) - counts, strict=True)])
        order = np.lexsort((classes[who], keys))
        keys, who = keys[order], who[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(start, len(keys)))
        found, more, done = [], False, set()
        for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            own = who[s : s + n]
            if (labels[own] == labels[own[0]]).all() or (turn > 1 and n <= small):
                continue  # connected, or all its pairs were told in the second turn
            same = classes[own].tobytes()
            if same in done:  # another token of just the same documents
                continue
            done.add(same)
            a, b, rest = tree_pairs(points[own], sizes[own], labels[own], shares[own], classes[own], turn, small)
            more |= rest
            found.append(np.column_stack([classes[own[a]], classes[own[b]]]))
        both = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.empty((0, 2), np.int64)
        first = np.flatnonzero(np.concatenate([[True], both[1:, 0] != both[:-1, 0]])) if len(both) else np.empty(0, np.int64)
        lists = [x.tobytes() for x in np.split(np.ascontiguousarray(both[:, 1]), first[1:])] if len(both) else []
        marks = 1 if more else 0
        return pa.table([pa.array([*both[first, 0].tolist(), *[None] * marks], pa.int64()), pa.array([*lists, *[None] * marks], pa.binary()), pa.array([*[False] * len(first), *[True] * marks], pa.bool_())], names=["a", "others", "more"])

    return pairs


def _distinct_pairs(table: pa.Table) -> pa.Table:
    """The pairs of one document, which several buckets may have told."""
    b = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("others")]))
    return pa.table([pa.array(np.full(len(b), table.column("a")[0].as_py()), pa.int64()), pa.array(b)], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, overlap = [], []
        for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            n = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep.append(n >= pair_overlap(np.int64(len(x) + len(y))))
            overlap.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(overlap, pa.int64())], names=["a", "b", "overlap"]).filter(pa.array(keep, pa.bool_()))


class _Classes:
    """The documents of a table described once: `known` all of them, `wanted` those that may have a partner, `classes`
    one row for each different set among these."""

    def __init__(self, docs: DataFrame, name: str, small: int, keep_chunks: bool, hot_token_rows: int = HOT_TOKEN_ROWS) -> None:
        spark = docs.sparkSession
        self.name, self.small, self.left_over = name, small, []
        self.chunks = store_chunks(docs, name)
        release(spark)
        slim = self.chunks.drop("others")
        buckets = buckets_for(self.chunks)
        limit = max(hot_token_rows, docs.count() // HOT_KEYS)
        masks = self._stored(bucketed(slim.mapInArrow(_tell(buckets), _TELL), counted_masks(limit), _MASK, buckets), "masks")
        release(spark)
        sent = spark.sparkContext.broadcast(hot_of(masks))  # at most HOT_KEYS times the mean number of first tokens
        self.known = self._stored(with_messages(slim, masks.where("chunk_id >= 0"), keep_all=True).mapInArrow(_describe(buckets, sent), _DOC), "known")
        if not keep_chunks:
            forget(self.chunks)
        release(spark)
        # One row stands for each class; its binaries stay where they are until a pair asks for them.
        self.wanted = self.known.where(F.col("tokens").isNotNull())
        chosen = self.wanted.groupBy("class").agg(F.min(F.struct("chunk_id", "row")).alias("at")).select("at.chunk_id", "at.row")
        light = self.wanted.select("chunk_id", "row", "n_shingles", "share", "keys", "point").join(chosen, ["chunk_id", "row"])
        self.classes = self._stored(light.select(row_id().alias("class"), "chunk_id", "row", "n_shingles", "share", "keys", "point"), "classes")
        # A class's point goes to every bucket that one of its keys falls into: as few buckets as their size allows.
        n_keys = (self.classes.agg(F.sum(F.octet_length("keys")).alias("n")).first().n or 0) // 8
        self.routes = max(LEAST_BUCKETS, -(-int(n_keys) // BUCKET_KEYS))

    def _stored(self, df: DataFrame, what: str) -> DataFrame:
        self.left_over.append(stored(df, f"{self.name}-{what}"))
        return self.left_over[-1]

    def forget(self) -> None:
        for table in self.left_over:
            forget(table)

    def pairs(self, labels: DataFrame | None, turn: int, tested: DataFrame | None) -> tuple[DataFrame, bool]:
        """(a, b) of classes to verify that aren't connected yet, but for those tested; whether a later turn may find more."""
        members = self.classes.select("class", "n_shingles", "share", "keys", "point")
        if labels is None:
            members = members.withColumn("label", F.col("class"))
        else:
            members = members.join(labels, members["class"] == labels.node, "left").withColumn("label", F.coalesce("label", "class")).drop("node")
        told = stored(bucketed(members.mapInArrow(_route(self.routes), _ROUTED), _pairs(turn, self.small), _PAIR, self.routes), f"{self.name}-pairs")
        fresh = told.where("a is not null").groupBy("a").applyInArrow(_distinct_pairs, "a long, b long")
        if tested is not None:
            fresh = fresh.join(tested, ["a", "b"], "left_anti")
        fresh = self._stored(fresh, "tests")
        more = told.where("more").limit(1).count() > 0
        forget(told)
        return fresh, more

    def verified(self, fresh: DataFrame) -> DataFrame:
        """(a, b, overlap) of the pairs that are similar enough. Only the sets that some pair needs are moved."""
        needed = fresh.select(F.col("a").alias("class")).union(fresh.select("b")).distinct().join(self.classes.select("class", "chunk_id", "row"), "class")
        needed = stored(needed, f"{self.name}-needed")
        small_enough = needed.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
        sets = self.wanted.select("chunk_id", "row", "tokens").join(F.broadcast(needed) if small_enough else needed, ["chunk_id", "row"])
        limit = hot_limit(fresh.count())
        left = copied_join(fresh, sets.select(F.col("class").alias("b"), F.col("tokens").alias("right")), "b", ["a"], shares_of(fresh, "b", limit))
        full = copied_join(left, sets.select(F.col("class").alias("a"), F.col("tokens").alias("left")), "a", ["b"], shares_of(fresh, "a", limit))
        new = self._stored(full.select("a", "b", "left", "right").mapInArrow(_verify, "a long, b long, overlap long"), "links")
        release(fresh.sparkSession)
        forget(needed)
        return new

    def rows(self) -> DataFrame:
        """chunk_id, row, doc_id, n_shingles, class and `own`, by which rows are in order, of every document."""
        own = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("key"), "chunk_id", "row", "doc_id")
        return self.known.select("chunk_id", "row", "doc_id", "n_shingles", "class").withColumn("own", own)

    def per_class(self) -> DataFrame:
        """class, least `own`, number of documents `n`, and `node`, the number by which pairs tell the class."""
        found = self.rows().where("class is not null").groupBy("class").agg(F.min("own").alias("own"), F.min(F.struct("chunk_id", "row")).alias("at"), F.count(F.lit(1)).alias("n"))
        return found.select("class", "own", "n", "at.chunk_id", "at.row").withColumn("node", row_id()).drop("chunk_id", "row")


def similar(docs: DataFrame, name: str = "ngrams", small: int = SMALL_TREE, keep_chunks: bool = True, hot_token_rows: int = HOT_TOKEN_ROWS) -> tuple[DataFrame, DataFrame]:
    """The chunks of docs, and for each row chunk_id, row, doc_id, n_shingles, component_id and `first`.

    component_id is the smallest doc_id that a row reaches by links of similarity NUMERATOR / DENOMINATOR or more, its
    own included; `first` marks one row of each component (the first with that doc_id). Null texts and those without
    words have no shingles, are linked with nothing and each the first of their own. A null doc_id counts as larger
    than all others; a component of such rows has a null component_id. Rows that share a doc_id are rows of their own; of
    rows equal in every way the first by chunk and place is the first. A text of any length counts whole. An empty
    table gives no rows; other columns of docs, whatever their names, stay with the chunks. Equal sets are recognised
    by 128 bits, words by 64.
    Without keep_chunks the chunks are deleted as soon as nothing needs them, and only the rows are of use.
    """
    c = _Classes(docs, name, small, keep_chunks, hot_token_rows)
    labels = tested = None
    for turn in range(ROUNDS):
        fresh, more = c.pairs(labels, turn, tested)
        tested = fresh if tested is None else tested.union(fresh)
        if fresh.limit(1).count():
            new = c.verified(fresh).select("a", "b")
            if new.limit(1).count():
                # What is connected already stands for itself by one link per document.
                labels = components(new if labels is None else new.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
                c.left_over.append(labels)
        if not more:
            break
    # From rows to classes, from classes to components and back, each by counts first: no class and no component, however
    # large, is gathered.
    rows, per_class = c.rows(), c.per_class().withColumnRenamed("node", "group")
    limit = hot_limit(c.known.count())
    if labels is not None:
        per_class = per_class.join(labels, per_class["group"] == labels.node, "left").withColumn("group", F.coalesce("label", "group")).drop("node", "label")
    per_group = per_class.groupBy("group").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("m"))
    facts = c._stored(spread_join(per_class.select("class", "n", "group"), per_group, "group", F.col("m") > limit, ["class"]).select("class", "n", "least"), "facts")
    found = spread_join(rows, facts, "class", F.col("n") > limit, ["chunk_id", "row"]).withColumn("least", F.coalesce("least", "own"))
    out = stored(found.select("chunk_id", "row", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("least") == F.col("own")).alias("first")), f"{name}-rows")
    c.forget()
    return c.chunks, out


def links(docs: DataFrame, name: str = "links", small: int = SMALL_TREE) -> tuple[DataFrame, DataFrame]:
    """All links of docs(doc_id, text), told once for each two classes of documents with equal sets.

    The first frame has each row's doc_id, n_shingles, class_id and n_links, the number of other rows that it is linked
    with: those of its class and those of all linked classes. The second has (class_a, class_b, overlap, union) of
    every two classes whose similarity is NUMERATOR / DENOMINATOR or more. Rows without shingles have no class and no
    links. Every other case is as in similar(); nothing is left out because it is connected in another way.
    """
    c = _Classes(docs, name, small, keep_chunks=False)
    found = c.verified(c.pairs(None, ALL, None)[0])
    sizes = c.classes.select(F.col("class").alias("node"), F.col("n_shingles").alias("size"))
    sized = found.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("node").alias("b"), F.col("size").alias("size_b")), "b")
    pairs = stored(sized.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "overlap", (F.col("size_a") + F.col("size_b") - F.col("overlap")).alias("union")), f"{name}-pairs")
    per_class = c._stored(c.per_class().select("class", "node", "n"), "per-class")
    both = pairs.select("class_a", "class_b").union(pairs.select("class_b", "class_a"))
    limit = hot_limit(c.known.count())
    # Numbers of rows of the neighbours, each class's by a join that a class with many neighbours doesn't gather.
    degree = both.groupBy(F.col("class_b").alias("node")).agg(F.count(F.lit(1)).alias("m"))
    asked = per_class.select("node", "n").join(degree, "node")
    heard = spread_join(both, asked.withColumnRenamed("node", "class_b"), "class_b", F.col("m") > hot_limit(both.count()), ["class_a", "class_b"]).groupBy(F.col("class_a").alias("node")).agg(F.sum("n").alias("near"))
    facts = c._stored(per_class.join(heard, "node", "left").select("class", F.col("node").alias("class_id"), "n", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links")), "facts")
    rows = spread_join(c.rows(), facts, "class", F.col("n") > limit, ["chunk_id", "row"])
    out = stored(rows.select("doc_id", "n_shingles", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links")), f"{name}-rows")
    c.forget()
    return out, pairs


def _firsts(names: list[str]):
    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in rows_of(batches):
            c = Chunk(line)
            keep = pa.array(sorted(m["row"] for m in line["messages"]), pa.int32())
            table, no_text = c.others()
            text = pc.if_else(no_text, pa.scalar(None, pa.large_string()), c.texts()).cast(pa.string())
            table = table.append_column("text", text).take(keep).select(names)
            yield from table.combine_chunks().to_batches(max_chunksize=512)

    return firsts


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component, with all their columns; see similar().

    They are read from the chunks; once they are written elsewhere, forget() of the frame deletes these.
    """
    chunks, rows = similar(docs, "one_of_each")
    kept = with_messages(chunks, rows.where("first").select("chunk_id", "row"), keep_all=False)
    return standing_on(kept.mapInArrow(_firsts(docs.columns), docs.schema), chunks, rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document's number of shingles and component."""
    _, rows = similar(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_chunks=False)
    return rows.select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
