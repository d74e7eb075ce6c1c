"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct ``n``-word shingles (with fewer words, of the whole sequence). Documents of
equal sets form one class; all further work is on classes, so groups of copies cost one class each.

1. Candidates. Shingles have one total order: by an estimate of their number of documents (counts in ``slots`` hashed counters over all
   documents), then by hash. Two sets that link share one of the first n - ceil(t n) + 1 shingles of this order. Classes that share such
   a shingle form a run.
2. Tiles. Each run (of runs of the same classes, one), ordered by size, is cut into tiles of at most ``tile`` classes; in a tile, all pairs of classes of
   different components and of compatible sizes (a size band: up to 1/t times the smaller) are compared by their bitmaps.
3. Rounds. ``rounds`` times each class passes on its nearest partner in each tile alone, which joins most components; then all pairs of different
   components that are left pass on.
4. Bitmaps. Each shingle toggles one bit; the differing bits of two bitmaps are at most the size of the sets' symmetric difference, so
   they bound the overlap from above. A bitmap has as many bits as its size band needs; a wider one is folded to the narrower.
5. Pairs that pass are verified on the sorted arrays: 100 |A n B| >= 100 t |A u B|.

``similar_classes`` is the join itself: it tests every pair of different classes that steps 1, 2 and 4 pass, with no rounds, and returns all links.
``near_duplicates`` is the component search alone: a pair that it leaves out has its two classes already in one component, so components are exact,
but it does not list all links.

Defined results: null, empty or wordless texts have no shingles and link with nothing; repeated rows are copies of each other; null doc_ids
count as rows but never name a component unless all its rows are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyops.llm.common import slices, stage, texts, unused
from skyops.llm.components import components
from skyops.llm.words import grams, mix, word_hashes

U = np.uint64


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all documents of a slice, their offsets, and a 64-bit key of each set."""
    hashes, words = word_hashes(data, off)
    parts, at = grams(hashes, words, n)
    sizes = np.diff(words)
    for k in range(1, n):  # shorter texts: the whole sequence
        few = np.flatnonzero(sizes == k)
        if len(few):
            own = grams(hashes[(words[few][:, None] + np.arange(k)).ravel()], np.arange(len(few) + 1) * k, k)[0]
            parts = np.insert(parts, at[few], own)
            grown = np.zeros(len(at), np.int64)
            grown[few + 1] = 1
            at = at + np.cumsum(grown)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        parts[a:b].sort()
    new = np.ones(len(parts), bool)
    new[1:] = parts[1:] != parts[:-1]
    new[at[:-1][at[:-1] < len(parts)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    parts, at = parts[new], kept[at]
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(parts ^ U(0x5851F42D4C957F2D)), dtype=U)])
    return parts, at, mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U)).view(np.int64)


def width_of(size: int) -> int:
    """Bits of the bitmap of a set: a power of two above twice its size, 64 at least."""
    return max(64, 1 << int(2 * size).bit_length())


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity bitmap: each shingle toggles one bit."""
    width = width_of(len(shingles))
    odd = np.bincount((shingles % U(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (64-bit words) as one of ``words`` words."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def _need(size: np.ndarray | int, percent: int):
    """Least overlap with any linked set."""
    return -(-size * percent // 100)


def _may_link(size_a, size_b, differing, percent: int):
    """Whether an overlap of (a + b - differing) / 2 would be enough."""
    overlap = (size_a + size_b - differing) // 2
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def classes_of(docs: DataFrame, n: int) -> DataFrame:
    """Rows: doc_id, text_hash, n_shingles, key of the set, bitmap (key and bitmap null for empty sets)."""

    def run(batches):
        for batch in batches:
            for i, j, data, off in slices(batch.column("text")):
                parts, at, keys = shingle_sets(data, off, n)
                sizes = np.diff(at)
                empty = sizes == 0
                maps = [None if e else bitmap(parts[a:b]) for a, b, e in zip(at[:-1].tolist(), at[1:].tolist(), empty.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("text_hash").slice(i, j - i), pa.array(sizes.astype(np.int64)),
                     pa.array(keys, mask=empty), pa.array(maps, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "key", "bitmap"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (texts(docs).withColumn("text_hash", F.xxhash64("text"))
            .mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, key bigint, bitmap binary"))


def counter_slots(docs: DataFrame, n: int, slots: int) -> np.ndarray:
    """How many (document, shingle) pairs fall into each of the hashed counters, over all documents."""

    def run(batches):
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for _, _, data, off in slices(batch.column("text")):
                total += np.bincount((shingle_sets(data, off, n)[0] % U(slots)).astype(np.int64), minlength=slots)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["slot", "n"])

    rows = texts(docs).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(slots, np.int64)
    out[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def prefix_entries(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Rows (shingle, size, key): the prefix of each class in the common order, once per class and task."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, off in slices(batch.column("text")):
                parts, at, keys = shingle_sets(data, off, n)
                rank = shared.value[(parts % U(len(shared.value))).astype(np.int64)]
                picked, sizes, owners = [], [], []
                for a, b, key in zip(at[:-1].tolist(), at[1:].tolist(), keys.tolist(), strict=True):
                    if a == b or key in seen:
                        continue
                    seen.add(key)
                    first = np.argsort(rank[a:b], kind="stable")[: b - a - _need(b - a, percent) + 1]  # ties stay in hash order
                    picked.append(parts[a:b][first])
                    sizes.append(b - a)
                    owners.append(key)
                if picked:
                    k = [len(p) for p in picked]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(picked).view(np.int64)), pa.array(np.repeat(sizes, k), pa.int32()),
                                                      pa.array(np.repeat(owners, k), pa.int64())], names=["shingle", "size", "key"])

    return texts(docs).mapInArrow(run, "shingle bigint, size int, key bigint")


def _runs(batches, names: list[str], by: list[str]):
    """Arrow batches of sorted rows as numpy columns, whole runs of equal ``by`` together."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        last = [t.column(c)[-1].as_py() for c in by]
        same = np.logical_and.reduce([np.asarray(t.column(c)) == v for c, v in zip(by, last, strict=True)])
        cut = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield t.slice(0, cut).select(names)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.select(names)


def run_members(entries: DataFrame) -> DataFrame:
    """Rows (shingle, size, key) of all runs of two classes or more, each class once. Streams over rows sorted by shingle, size and key, holding
    one row."""

    def run(batches):
        first = None  # the row that waits for a second class of its shingle
        last = None
        for batch in batches:
            shingle, size, key = (np.asarray(batch.column(c)) for c in ("shingle", "size", "key"))
            if not len(shingle):
                continue
            # rows without a neighbour of the same shingle can only be runs of one class
            lone = np.ones(len(shingle), bool)
            equal = shingle[1:] == shingle[:-1]
            lone[1:] &= ~equal
            lone[:-1] &= ~equal
            lone[0] = lone[-1] = False
            out: list[tuple] = []
            for row in zip(shingle[~lone].tolist(), size[~lone].tolist(), key[~lone].tolist(), strict=True):
                if last is None or row[0] != last[0]:
                    first = row
                elif row != last:  # the same class comes from other tasks too
                    if first is not None:
                        out.append(first)
                        first = None
                    out.append(row)
                last = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)],
                                                 names=["shingle", "size", "key"])

    return (entries.repartition("shingle").sortWithinPartitions("shingle", "size", "key")
            .mapInArrow(run, "shingle bigint, size int, key bigint"))


def key_filter(keys: DataFrame, max_bits: int = 1 << 27) -> np.ndarray:
    """A Bloom filter (64-bit words, at most ``max_bits`` bits) of a column ``key``; beyond that size it only lets more through."""
    keys = keys.select("key").distinct()
    n = keys.count()
    size = min(max_bits, 1 << max(16, (10 * n).bit_length())) // 64

    def run(batches):
        out = np.zeros(size, U)
        for batch in batches:
            for p in _places(size, np.asarray(batch.column(0))):
                np.bitwise_or.at(out, (p >> U(6)).astype(np.int64), U(1) << (p & U(63)))
        held = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(out[held].view(np.int64))], names=["word", "bits"])

    rows = keys.coalesce(1 + n // 500_000).mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(U)


#: odd multipliers of the filter's hash functions
_PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _places(size: int, keys: np.ndarray) -> list[np.ndarray]:
    """The filter's bits of each key; ``size``: its 64-bit words, a power of two."""
    shift = U(64 - ((size * 64).bit_length() - 1))
    return [(keys.view(U) * U(m)) >> shift for m in _PROBES]


def _probe(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(words[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1) == 1 for p in _places(len(words), keys)])


def sets_of(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """(key, shingles) of the classes in ``keys``, and perhaps of a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(keys))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, off in slices(batch.column("text")):
                parts, at, found = shingle_sets(data, off, n)
                rows = []
                for i in np.flatnonzero(_probe(shared.value, found) & (np.diff(at) > 0)).tolist():
                    if (key := int(found[i])) not in seen:
                        seen.add(key)
                        rows.append((key, parts[at[i]: at[i + 1]].tobytes()))
                if rows:
                    k, s = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.binary())], names=["key", "shingles"])

    return texts(docs).mapInArrow(run, "key bigint, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by exact intersection."""

    def run(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                u, v = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                common = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key")))
    sets = sets_of(docs, keys, n)
    return (pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("set_b")), "b")
            .join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("set_a")), "a")
            .select("a", "b", "set_a", "set_b").coalesce(1 + pairs.count() // 2_000).mapInArrow(run, "a bigint, b bigint"))


def tile_pairs(members: DataFrame, maps: DataFrame, percent: int, tile: int, nearest: bool) -> DataFrame:
    """Pairs of classes of different components that share a run and pass the size and bitmap bounds; ``nearest``: of each class and tile, the
    pair with the fewest differing bits.

    ``members``: shingle, size, key, root. A run of more than ``tile`` classes is dealt into several blocks by hash of the key, and each pair of
    blocks is one tile, so no task holds a whole hot run."""
    runs = (members.groupBy("shingle").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("held"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            .where("lo <> hi").groupBy("n", "held").agg(F.min("shingle").alias("shingle"))  # runs of the same classes
            .select("shingle", F.ceil(F.col("n") / tile).cast("int").alias("blocks")))
    split = members.join(runs, "shingle").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).join(maps.select("key", "bitmap"), "key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = (split.select("shingle", "size", "key", "root", "bitmap", "block", other)
             .select("shingle", "size", "key", "root", "bitmap", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))

    def pairs_of(size, key, root, bits) -> list[tuple[int, int]]:
        n, out = len(size), []
        width = np.array([len(b) for b in bits])
        folded: dict[int, tuple[int, np.ndarray]] = {}
        best, at = np.full(n, 1 << 60), np.full(n, -1)
        for x in range(n - 1):  # sizes ascend: partners of x are the next rows up to its band's end
            end = int(np.searchsorted(size, size[x] * 100 // percent, "right"))
            y = x + 1 + np.flatnonzero(root[x + 1: end] != root[x])
            if not len(y):
                continue
            w = int(width[x])
            if w not in folded:
                first = int(np.searchsorted(width, w))
                folded[w] = first, np.stack([fold(b, w) for b in bits[first:]])
            first, rows = folded[w]
            differing = np.bitwise_count(rows[y - first] ^ rows[x - first]).sum(1).astype(np.int64)
            near = _may_link(size[x], size[y], differing, percent)
            y, differing = y[near], differing[near]
            if not nearest:
                out += [(x, k) for k in y.tolist()]
            elif len(y):
                better = differing < best[y]
                best[y[better]], at[y[better]] = differing[better], x
                k = int(differing.argmin())
                if differing[k] < best[x]:
                    best[x], at[x] = differing[k], y[k]
        out += [(x, int(at[x])) for x in np.flatnonzero(at >= 0).tolist()]
        return [(int(min(key[x], key[y])), int(max(key[x], key[y]))) for x, y in out]

    def run(batches):
        seen: set[tuple[int, int]] = set()  # only spares rows: distinct() follows
        for t in _runs(batches, ["shingle", "i", "j", "size", "key", "root", "bitmap"], ["shingle", "i", "j"]):
            where = [np.asarray(t.column(c)) for c in ("shingle", "i", "j")]
            size, key, root = (np.asarray(t.column(c)).astype(np.int64) for c in ("size", "key", "root"))
            maps = t.column("bitmap").combine_chunks()
            edge = np.flatnonzero(np.logical_or.reduce([w[1:] != w[:-1] for w in where])) + 1
            out = []
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(size)], strict=True):
                if (root[a:b] != root[a]).any():
                    out += [p for p in pairs_of(size[a:b], key[a:b], root[a:b], [np.frombuffer(maps[i].as_buffer(), U) for i in range(a, b)]) if p not in seen]
            seen.update(out)
            if len(seen) > 1_000_000:
                seen.clear()
            if out:
                p, q = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=["a", "b"])

    return (dealt.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "size", "key")
            .mapInArrow(run, "a bigint, b bigint").distinct())


def _prepared(docs: DataFrame, n: int, percent: int, slots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their classes, bitmaps of the classes, and the runs."""
    found = stage(classes_of(docs, n), "classes")
    maps = stage(found.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("bitmap").alias("bitmap")), "bitmaps")
    return found, maps, stage(run_members(prefix_entries(docs, n, percent, counter_slots(docs, n, slots))), "runs")


def similar_classes(docs: DataFrame, n: int = 5, percent: int = 80, slots: int = 1 << 18, tile: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, class_key) of all documents, and every link (a, b), a < b, between different classes. The links of two
    documents are those of their classes; documents of one class link too."""
    found, maps, members = _prepared(docs, n, percent, slots)
    pairs = stage(tile_pairs(members.withColumn("root", F.col("key")), maps, percent, tile, nearest=False), "pairs")
    links = stage(verified(docs, pairs, n, percent), "links") if not pairs.isEmpty() else pairs
    return found.select("doc_id", "text_hash", "n_shingles", F.col("key").alias("class_key")), links


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, slots: int = 1 << 18, tile: int = 2048, rounds: int = 2) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, class_key, root_key (the component's own key, null for empty sets), component_id (the smallest
    doc_id reachable by links)."""
    found, maps, members = _prepared(docs, n, percent, slots)
    roots = tested = None
    for last in [False] * rounds + [True]:
        labelled = members.withColumn("root", F.col("key")) if roots is None else \
            members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        pairs = tile_pairs(labelled, maps, percent, tile, nearest=not last)
        pairs = stage(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = stage(verified(docs, pairs, n, percent), "links") if not pairs.isEmpty() else pairs
        tested = pairs if tested is None else tested.union(pairs)
        if roots is None or not links.isEmpty():
            roots = stage(components(links if roots is None else links.union(roots.where("node <> root").select("node", "root"))), "roots")
    joined = maps.select("key", "first_id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = joined.join(least, "root").select("key", F.col("root").alias("root_key"), "component_id")
    return (found.drop("bitmap").join(component, "key", "left")
            .select("doc_id", "text_hash", "n_shingles", F.col("key").alias("class_key"), "root_key", F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: the one whose doc_id names it. Rows that repeat a doc_id and a text stay once. Groups are components:
    null or repeated doc_ids never join them."""
    found = stage(near_duplicates(docs, **options), "members")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    repeated = not kept.where("times > 1").isEmpty()
    # of different texts of one group under one doc_id, the one of the smallest hash stays
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("n_shingles") > 0)).groupBy("root_key", "component_id").agg(F.min("text_hash").alias("text_hash")).drop("root_key")
    lone = found.where("n_shingles = 0").select(F.col("doc_id").alias("component_id"), "text_hash")
    kept = own.union(lone).distinct().withColumnsRenamed({"component_id": "_id", "text_hash": "_hash"})
    own_hash, = unused(docs, "_text_hash")
    rows = docs.withColumn(own_hash, F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows[own_hash] == kept["_hash"]), "left_semi")
    return (rows.dropDuplicates(["doc_id", own_hash]) if repeated else rows).drop(own_hash)
