"""Exact self-join of documents on the Jaccard similarity of their word n-grams.

1. Documents with the same n-gram set form one class. Of every class a hash-chosen share of the
   n-grams is exchanged; n-grams found in one class alone are counted. A class with more than a
   quarter (at threshold 0.75) of such n-grams can link with nothing and is done.
2. The remaining classes learn how many of them hold each of their n-grams. A batch of classes
   asks once for each different n-gram, so that a very common one costs an entry for each batch
   and not for each class. That gives several global orders, all rare first, with different ties.
   Two linked classes share an n-gram of their prefixes under each of the orders.
3. The first order's prefixes connect classes to candidate clusters; no pair is listed. Clusters
   of more than a block are cut further by the second and third order's prefixes inside them.
   What is still larger is cut into blocks, and each pair of blocks is one task: candidates are
   those that share prefix n-grams under every order (intersected), and each of them is verified
   exactly.
4. Verified links give components.

Classes are told apart by 128 bits, n-grams by 64.

Defined results: null and wordless texts have no n-grams and link with nothing, so each is its
own component; a text of fewer words than n is one n-gram; repeated rows share a class; a null
id takes part in links and gets the smallest other id of its component, or null; other columns
are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bucket_count, slices, task_number, text_column
from .components import connected_components
from .kernel import NOT_SPACE, mix, ragged, spans, windows, word_hashes
from .packed import bloom, bloom_slots, buckets, exchange, groups, may_hold, pack, ragged_binary, schema, unpack

_BYTES = 3 << 20
_NULL = np.iinfo(np.int64).min
#: Classes, and bytes of n-grams, of one block of a candidate cluster.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Seeds of the tie-breaking hashes of the global orders.
ORDERS = (101, 211, 307)
_DOC = "doc_id long, c1 long, c2 long, n long, sampled long"


def ngram_sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, ascending, and the n + 1 row bounds."""
    data, offs = text_column(batch, "text")
    start, end, words = spans(data, offs, NOT_SPACE)
    h, count = word_hashes(data, start, end, True), np.diff(words)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = ragged(words[:-1], per)
    w = windows(h, first, np.repeat(np.minimum(count, n), per))
    bounds = np.concatenate(([0], np.cumsum(per)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        w[a:b].sort()
    keep = np.ones(len(w), bool)
    keep[1:] = w[1:] != w[:-1]
    keep[bounds[:-1][per > 0]] = True
    return w[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def _signatures(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free hashes of each set."""
    out = []
    with np.errstate(over="ignore"):
        for seed in (7, 13):
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(seed)))))
            out.append(mix(run[bounds[1:]] - run[bounds[:-1]] + np.uint64(seed)).view(np.int64))
    return out[0], out[1]


def _longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _need(threshold: Fraction, n: np.ndarray) -> np.ndarray:
    """The least number of common n-grams that a link asks of a set of size n."""
    return -(-threshold.numerator * n // threshold.denominator)


def _survivors(docs: DataFrame, n: int, threshold: Fraction, share: float, carried: list[str], work: Workspace, parts: int) -> tuple[DataFrame, DataFrame]:
    """The table of documents with their classes, and the classes that may link with others."""
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BYTES):
            grams, bounds = ngram_sets(batch, n)
            c1, c2 = _signatures(grams, bounds)
            size = np.diff(bounds)
            low = grams < limit
            part = np.concatenate(([0], np.cumsum(low)))[bounds]
            ids = _longs(batch, "doc_id")
            # Document rows pass through the same exchange.
            at = buckets(mix(c1.view(np.uint64)), parts)
            yield _rows(at, {"d": ids, "c1": c1, "c2": c2, "n": size, "s": np.diff(part)} | {c: _longs(batch, c) for c in carried})
            _, once = np.unique(c1, return_index=True)  # copies inside the batch count once
            row = np.repeat(np.arange(len(size)), np.diff(part))
            take = np.isin(row, once)
            h, owner = grams[low][take], c1[row[take]]
            if not len(h):
                continue
            order, group = groups(h)
            several = np.bincount(group)[group] > 1
            first = np.ones(len(order), bool)
            first[1:] = group[1:] != group[:-1]
            # A gram of several classes is known to be shared: they count it here, and one entry
            # without an owner tells the other batches.
            shared, counts = np.unique(owner[order][several], return_counts=True)
            lead = order[first]
            alone = np.where(several[first], 0, 1)
            # Half of a hash tells the n-grams of a bucket apart; two that it confuses count as
            # shared, which rules out less.
            yield _rows(buckets(h[lead], parts), {"h": h[lead].astype(np.uint32), "o": owner[lead] * alone})
            yield _rows(buckets(mix(shared.view(np.uint64)), parts), {"k": shared, "v": counts})

    names = ("h", "o", "k", "v", "d", "c1", "c2", "n", "s", *carried)

    def _rows(bucket: np.ndarray, full: dict) -> pa.RecordBatch:
        made = pack(bucket, full)
        rows = made.num_rows
        blank = pa.array([b""] * rows, pa.binary())
        have = {c: made.column(k + 1) for k, c in enumerate(full)}
        return pa.RecordBatch.from_arrays([made.column(0), *(have.get(c, blank) for c in names)], ["bucket", *names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = unpack(batches, **dict.fromkeys(names, np.int64) | {"h": np.uint32})
        order, group = groups(e["h"], e["o"])
        h, o = e["h"][order], e["o"][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, o = h[new], o[new]  # each class once
        edge = np.ones(len(h) + 1, bool)
        edge[1:-1] = h[1:] != h[:-1]
        at = np.flatnonzero(edge)
        size = np.diff(at)
        ownerless = np.add.reduceat((o == 0).astype(np.int64), at[:-1]) if len(h) else size
        several = np.repeat((size > 1) | (ownerless > 0), size) & (o != 0)
        k, v = np.unique(o[several], return_counts=True)
        k, v = np.concatenate([k, e["k"]]), np.concatenate([v, e["v"]])
        zero = np.zeros(len(k), np.int64)
        yield _table(kind=np.ones(len(k), np.int32), doc_id=zero, c1=k, c2=zero, n=v, sampled=zero, **dict.fromkeys(carried, zero))
        yield _table(kind=np.zeros(len(e["d"]), np.int32), doc_id=e["d"], c1=e["c1"], c2=e["c2"], n=e["n"], sampled=e["s"], **{c: e[c] for c in carried})

    sent = exchange(docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"), "text", *carried).mapInArrow(scan, schema(*names)), parts)
    both = work.save(sent.mapInArrow(count, f"kind int, {_DOC}" + "".join(f", {c} long" for c in carried)))
    rows = both.where("kind = 0").drop("kind")
    shared = both.where("kind = 1").groupBy("c1").agg(F.sum("n").alias("shared"))
    classes = rows.where("n > 0").groupBy("c1", "c2", "n", "sampled").agg(F.min(F.when(F.col("doc_id") != _NULL, F.col("doc_id"))).alias("rep"), F.min("doc_id").alias("any"), F.count("*").alias("copies"))
    # alone > n - need: even if all else were common, too little would be.
    spare = F.col("n") - F.ceil(F.col("n") * threshold.numerator / threshold.denominator)
    alone = F.col("sampled") - F.least(F.coalesce("shared", F.lit(0)), F.col("sampled"))
    kept = classes.join(shared, "c1", "left").where(alone <= spare)
    # Written with a number of its own for each class: one word that names it, and no two the same.
    return rows, work.save(kept.select("c1", "c2", "n", "any", "copies", F.monotonically_increasing_id().alias("c")))


def _classes(docs: DataFrame, kept: DataFrame, n: int) -> DataFrame:
    """The remaining classes with their n-grams, packed: batch, and c, n, m (copies), bounds, grams of its classes."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom(kept, "any"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BYTES):
            may = np.flatnonzero(may_hold(sent.value, _longs(batch, "s1"), _longs(batch, "s2")))
            if len(may):
                batch = batch.take(pa.array(may))
                grams, bounds = ngram_sets(batch, n)
                c1, c2 = _signatures(grams, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), ragged_binary(grams, bounds)], ["c1", "c2", "grams"])

    ids = F.coalesce("doc_id", F.lit(_NULL)).alias("any")
    found = docs.select(ids, "text").select("*", *bloom_slots("any")).mapInArrow(sets, "c1 long, c2 long, grams binary")
    # By class alone, so that the sets travel once; equal classes have equal sets.
    found = found.groupBy("c1", "c2").agg(F.first("grams").alias("grams")).join(kept.select("c1", "c2", "c", "n", "copies"), ["c1", "c2"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(slices(batches, "grams", _BYTES)):
            raw, offs = text_column(batch, "grams")
            cols = [_longs(batch, c).astype(np.int64).tobytes() for c in ("c", "n", "copies")] + [(offs // 8).tobytes(), raw.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([task_number() << 32 | k]), *(pa.array([x], pa.binary()) for x in cols)], ["batch", "c", "n", "m", "bounds", "grams"])

    return found.select("c", "n", "copies", "grams").mapInArrow(packed, "batch long, c binary, n binary, m binary, bounds binary, grams binary")


def _read(r: dict, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(r[c], np.uint64 if c in ("grams", "h") else np.uint32 if c == "f" else np.int64) for c in names]


def _orders(classes: DataFrame, threshold: Fraction, parts: int) -> DataFrame:
    """For each remaining class its shared n-grams and, as places among them, its prefixes under every order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, m = np.unique(_read(r, "grams")[0], return_counts=True)
                yield pack(buckets(h, parts), {"h": h, "b": np.full(len(h), r["batch"]), "m": m.astype(np.uint32)})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = unpack(batches, h=np.uint64, b=np.int64, m=np.uint32)
        order, group = groups(e["h"])
        df = np.bincount(group, e["m"][order])[group].astype(np.int64) if len(group) else np.empty(0, np.int64)
        # An n-gram of one class alone needs no reply.
        take, f = order[df > 1], df[df > 1].astype(np.uint32)
        for lo in range(0, len(take), 1 << 20):
            t = take[lo : lo + (1 << 20)]
            yield pack(buckets(mix(e["b"][t].view(np.uint64)), parts), {"b": e["b"][t], "h": e["h"][t], "f": f[lo : lo + (1 << 20)]})

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = unpack(batches, b=np.int64, h=np.uint64, f=np.uint32)
        order, _ = groups(e["b"], e["h"])
        ids, at = np.unique(e["b"][order], return_index=True)
        for i, lo, hi in zip(ids.tolist(), at.tolist(), [*at.tolist()[1:], len(order)]):
            x = order[lo:hi]
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([e["h"][x].tobytes()], pa.binary()), pa.array([e["f"][x].tobytes()], pa.binary())], ["batch", "h", "f"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c", "n", "copies", "grams", *(f"p{i}" for i in range(len(ORDERS)))]
        kinds = {"c": pa.int64(), "n": pa.int64(), "copies": pa.int64()}
        for batch in batches:
            for r in batch.to_pylist():
                c, n, m, bounds, grams, h, f = _read(r, "c", "n", "m", "bounds", "grams", "h", "f")
                at = np.minimum(np.searchsorted(h, grams), len(h) - 1)
                df = np.where(h[at] == grams, f[at], 0)
                out: dict[str, list] = {x: [] for x in names}
                for k, (a, b, size) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), n.tolist())):
                    x = np.flatnonzero(df[a:b]) + a
                    need = int(_need(threshold, np.int64(size)))
                    if len(x) < need:
                        continue
                    slots = size - need + 1 - (size - len(x))  # n-grams of this class alone come first
                    mine, d = grams[x], df[x]
                    out["c"].append(int(c[k]))
                    out["n"].append(size)
                    out["copies"].append(int(m[k]))
                    out["grams"].append(mine.tobytes())
                    for i, seed in enumerate(ORDERS):
                        # The second order ranks frequencies by their magnitude only, the third mixes both.
                        rank = d if i == 0 else np.log2(d).astype(np.int64) >> (i - 1)
                        out[f"p{i}"].append(np.lexsort((mix(mine ^ np.uint64(seed)), rank))[:slots].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(x, pa.binary())) for x, v in out.items()], names)

    asked = exchange(classes.select("batch", "grams").mapInArrow(ask, schema("h", "b", "m")), parts)
    replies = exchange(asked.mapInArrow(answer, schema("b", "h", "f")), parts).mapInArrow(by_batch, "batch long, h binary, f binary")
    # Batches without a reply hold no shared n-gram.
    return classes.join(replies, "batch").mapInArrow(prefixes, "c long, n long, copies long, grams binary, " + ", ".join(f"p{i} binary" for i in range(len(ORDERS))))


def _stars(classes: DataFrame, order: int, parts: int) -> DataFrame:
    """Edges from the holders of a prefix n-gram in a cluster to the smallest of them (c, cluster, p, grams)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "grams", _BYTES):
            raw, offs = text_column(batch, "p")
            grams, starts = text_column(batch, "grams")
            per = np.diff(offs) // 4
            h = np.frombuffer(grams.tobytes(), np.uint64)[np.frombuffer(raw.tobytes(), np.uint32) + np.repeat(starts[:-1] // 8, per)]
            inside = mix(_longs(batch, "cluster").astype(np.int64).view(np.uint64))
            h = mix(h ^ np.repeat(inside, per))
            k = np.repeat(_longs(batch, "c"), per)
            group_order, group = groups(h, k)
            new = np.ones(len(h), bool)
            new[1:] = h[group_order][1:] != h[group_order][:-1]
            lead = np.repeat(k[group_order][new], np.diff(np.append(np.flatnonzero(new), len(h))))
            e = np.unique(np.stack([k[group_order], lead], 1)[k[group_order] != lead], axis=0)
            low = group_order[new]  # one entry for each n-gram of the batch; the others follow their leader
            yield _pair(pack(buckets(h[low], parts), {"h": h[low], "k": k[low]}), ("a", "b"))
            if len(e):
                yield _pair(pack(buckets(mix(e[:, 0].view(np.uint64)), parts), {"a": e[:, 0], "b": e[:, 1]}), ("h", "k"))

    def _pair(made: pa.RecordBatch, blank: tuple[str, str]) -> pa.RecordBatch:
        none = pa.array([b""] * made.num_rows, pa.binary())
        have = {c: made.column(made.schema.get_field_index(c)) for c in made.schema.names} | dict.fromkeys(blank, none)
        return pa.RecordBatch.from_arrays([have[c] for c in ("bucket", "h", "k", "a", "b")], ["bucket", "h", "k", "a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = unpack(batches, h=np.uint64, k=np.int64, a=np.int64, b=np.int64)
        by, _ = groups(e["h"], e["k"])
        h, k = e["h"][by], e["k"][by]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        lead = np.repeat(k[new], np.diff(np.append(np.flatnonzero(new), len(h))))
        pairs = np.unique(np.concatenate([np.stack([k, lead], 1), np.stack([e["a"], e["b"]], 1)]), axis=0)
        yield _table(a=pairs[:, 0], b=pairs[:, 1])

    return exchange(classes.select("c", "cluster", F.col(f"p{order}").alias("p"), "grams").mapInArrow(ask, schema("h", "k", "a", "b")), parts).mapInArrow(join, "a long, b long")


def _clusters(classes: DataFrame, work: Workspace, parts: int) -> tuple[DataFrame, DataFrame]:
    """node and root of candidate clusters, and root, size and bytes of each.

    Linked classes share a prefix n-gram under every order, so parts of a cluster that share none
    under a further order may be parted.
    """
    weights = classes.select(F.col("c").alias("node"), F.octet_length("grams").alias("bytes"))

    def sized(now: DataFrame) -> DataFrame:
        # Written, so that both sides of the joins with it are plain exchanges.
        return work.save(now.join(weights, "node").groupBy("root").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes")))

    now = connected_components(_stars(classes.withColumn("cluster", F.lit(0).cast("long")), 0, parts), work)
    sizes = sized(now)
    for order in range(1, len(ORDERS)):
        large = sizes.where((F.col("size") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select("root")
        if large.isEmpty():
            break
        members = now.join(large, "root").select(F.col("node").alias("c"), F.col("root").alias("cluster"))
        finer = connected_components(_stars(classes.join(members, "c"), order, parts), work)
        now = work.save(now.join(large, "root", "left_anti").select("node", "root").unionByName(finer))
        sizes = sized(now)
    return now, sizes


class _Lists:
    """Ragged lists of n-grams under local numbers, for counting against a marked set."""

    def __init__(self, size: np.ndarray, flat: np.ndarray):
        self.size, self.flat = size, flat
        self.first = np.concatenate(([0], np.cumsum(size)))

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.first[i] : self.first[i + 1]]

    def common(self, mark: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many marked n-grams each of the given rows holds."""
        size = self.size[rows]
        out = np.zeros(len(rows), np.int64)
        full = size > 0
        if full.any():
            got = mark[self.flat[ragged(self.first[rows[full]], size[full])]].astype(np.int64)
            out[full] = np.add.reduceat(got, np.concatenate(([0], np.cumsum(size[full])[:-1])))
        return out


def _verify(threshold: Fraction):
    def block(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in ("c", "n", "copies", "blk", "i", "j", "grams", *(f"p{i}" for i in range(len(ORDERS))))}
        ids, n, copies, blk = (np.array(col[c], np.int64) for c in ("c", "n", "copies", "blk"))
        cross = col["i"][0] != col["j"][0]
        universe = np.unique(np.frombuffer(b"".join(col["grams"]), np.uint64))
        sizes = np.array([len(b) // 8 for b in col["grams"]], np.int64)
        whole = _Lists(sizes, np.searchsorted(universe, np.frombuffer(b"".join(col["grams"]), np.uint64)))
        prefix = []
        for i in range(len(ORDERS)):
            per = np.array([len(b) // 4 for b in col[f"p{i}"]], np.int64)
            at = np.frombuffer(b"".join(col[f"p{i}"]), np.uint32) + np.repeat(whole.first[:-1], per)
            prefix.append(_Lists(per, whole.flat[at]))
        order = np.argsort(n, kind="stable")
        root, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        mark = np.zeros(len(universe), bool)
        for k, x in enumerate(order.tolist()):
            later = order[k + 1 :]
            later = later[n[later] * threshold.numerator <= n[x] * threshold.denominator]  # sizes apart can't link
            if cross:
                later = later[blk[later] != blk[x]]
            for p in prefix:  # candidates under one order after the other
                if not len(later):
                    break
                mark[p.row(x)] = True
                later = later[p.common(mark, later) > 0]
                mark[p.row(x)] = False
            if len(later):
                mark[whole.row(x)] = True
                both = whole.common(mark, later)
                mark[whole.row(x)] = False
                hit = later[both * threshold.denominator >= threshold.numerator * (n[x] + n[later] - both)]
                if len(hit):
                    links[x] += copies[hit].sum()
                    links[hit] += copies[x]
                    joined = np.isin(root, np.append(root[hit], root[x]))
                    root[joined] = root[joined].min()
        return pa.table({"c": ids, "root": ids[root], "links": links})

    return block


def link_documents(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(3, 4), share: float = 1 / 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (documents that it links with).

    share: the part of each set that the first step exchanges; it must exceed 1 - threshold to
    rule anything out, and steers cost alone. carry: long columns to return with each row, after
    `component`, a name that no two components share (ids of other rows may).
    """
    spark, threshold = docs.sparkSession, Fraction(threshold)
    work, parts = Workspace(spark, "links"), bucket_count(docs, 8 << 20)
    carried = [f"x{k}" for k in range(len(carry))]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(x) for c, x in zip(carry, carried)))
    rows, kept = _survivors(texts, n, threshold, share, carried, work, parts)
    classes = work.save(_orders(work.save(_classes(texts, kept, n)), threshold, parts))
    clusters, sizes = _clusters(classes, work, parts)
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    cut = clusters.join(sizes.where("size > 1"), "root").select(F.col("node").alias("c"), F.col("root").alias("cluster"), blocks.alias("blocks"))
    cut = cut.withColumn("blk", F.pmod(F.xxhash64("c", F.lit(5)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sides = classes.join(cut, "c").select("*", other).withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")}).drop("other", "blocks")
    found = work.save(sides.groupBy("cluster", "i", "j").applyInArrow(_verify(threshold), "c long, root long, links long"))
    named = connected_components(found.select(F.col("c").alias("a"), F.col("root").alias("b")), work)
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    doc = F.when(F.col("doc_id") != _NULL, F.col("doc_id"))
    full = rows.where("n > 0").groupBy("c1", "c2").agg(F.min(doc).alias("low"), F.count("*").alias("copies"))
    # By c first, which the other classes lack: their nulls would all go to one task.
    known = kept.select("c1", "c2", "c").join(named.withColumnRenamed("node", "c"), "c", "left").join(links, "c", "left")
    full = full.join(known, ["c1", "c2"], "left")
    full = work.save(full)
    # Most classes are their own component; only the others meet.
    low = work.save(full.where("root is not null").groupBy("root").agg(F.min("low").alias("least")))
    full = full.join(low, "root", "left").select(
        "c1",
        "c2",
        F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce(F.concat(F.lit("links "), F.col("root").cast("string")), F.concat_ws(" ", F.lit("set"), F.hex("c1"), F.hex("c2"))).alias("component"),
    )
    more = ["component", *carried] if carry else []
    single = rows.where("n = 0").select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), doc.alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("string").alias("component"), *carried)
    linked = rows.where("n > 0").join(work.save(full), ["c1", "c2"]).select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_links", "component", *carried)
    out = ["doc_id", "n_shingles", "component_id", "n_links", *more]
    return linked.select(*out).unionByName(single.select(*out)).withColumnsRenamed(dict(zip(carried, carry)))
