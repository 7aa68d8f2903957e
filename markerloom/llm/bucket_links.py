"""Links within buckets of similar sets, none of them lost, without a table of all pairs of a bucket.

A bucket is a key that documents share; sets that are similar enough share one. What is linked is decided on full sets.

1. The hub of a bucket is the member that shares most buckets with others (an original shares more with its copies than they
   do with each other). Every member is compared with the hubs of its buckets: as many pairs as rows.
2. Buckets whose members are then in several components are open. Those with the same main component (that of most of their
   members) are one group. Each member of a group is cut down to a prefix: its shingles, those that are rarest in the group
   first, as far as a similar set must share one of them with it. What the members of a family have in common stays out of
   their prefixes if each has enough shingles of its own (a ninth of them for links at 0.8, which is a similarity below 0.64
   between members), so members that are that far apart hardly meet again.
3. Of members in different components, those that share a prefix shingle are compared, where up to ``FEW`` have it; others
   by their hub again.
4. Members that more than ``FEW`` share a prefix shingle with and that are in different components even now are compared in
   blocks of bounded size, by the counts of their common shingles. This alone grows faster than a group: by its members times
   the blocks of those outside its main component.

How rare a shingle is, is told by a bounded sample of the group; it only sets an order, and any order finds all links.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.llm.components import components
from markerloom.llm.shared import hinted, only, tasks, whole_groups, written
from markerloom.llm.textvec import grams, mixed, words

#: Documents, and shingles of all of them, in a block of a group; pairs that share one copy of their pivot's data.
BLOCK, WORDS, SALT = 2000, 2_000_000, 1000
#: Members of a group whose shingles tell which are common; members with one prefix shingle that are all compared.
SAMPLE, FEW = 32, 16


SET_KEY = ["set_a", "set_b", "n_shingles"]


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, from the hashes of its words."""
    all_grams = grams(hashes, k)
    out = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - begin >= k:
            out.append(np.unique(all_grams[begin : end - k + 1]))
        else:
            out.append(grams(hashes[begin:end], end - begin) + np.uint64(k) if end > begin else np.zeros(0, np.uint64))
    return out


def shingles(text: str | None, k: int) -> set:
    """The set itself, of tuples of words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else {tuple(w)} if w else set()


def similar(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return bool(both) and 100 * both >= percent * (len(x) + len(y) - both)


class Texts:
    """Texts of nodes: ``nodes`` is a stored table of ``rep, doc_id, text_key`` for all nodes that may be asked for."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.rows, self.nodes = only(docs, id=F.col("doc_id").cast("long"), key=F.xxhash64(F.col("text")), text=F.col("text")), nodes

    def of(self, reps: DataFrame, name: str) -> DataFrame:
        """``rep, text``, stored, for a table of distinct ``rep``."""
        asked = hinted(written(self.nodes.join(reps, "rep", "left_semi"), "asked"))
        found = self.rows.join(asked, (F.col("id") == F.col("doc_id")) & (F.col("key") == F.col("text_key")))
        return written(found.select("rep", "text").dropDuplicates(["rep"]), name)


def beside_pivots(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """``a, salt, b, data``: for each ``SALT`` pairs of a pivot its own row (whose ``b`` is null), then those of its ``b``.

    ``pairs`` and ``data`` (rep, data) are stored tables. A pivot's data is moved once for ``SALT`` of its pairs, and
    no task has to take all of them."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SALT)).cast("int").alias("salts"))
    own = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("rep"))
    split = hinted(written(counts.where("salts > 1"), "split"))  # a row for SALT pairs at most
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")
    others = pairs.join(split, "a", "left").select("a", salt.alias("salt"), "b", F.col("b").alias("rep"))
    rows = own.unionByName(others).join(data, "rep").select("a", "salt", "b", "data")
    return rows.repartition(tasks(pairs, 4000), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())


def _confirmed(pairs: DataFrame, texts: Texts, k: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose full sets are similar enough."""
    both = texts.of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "texts")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set = set()
        for batch in batches:
            good = []
            for i, (b, text) in enumerate(zip(batch.column("b").to_pylist(), batch.column("data"))):
                own = shingles(text.as_py(), k)
                if b is None:
                    held = own
                elif similar(held, own, percent):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return beside_pivots(pairs, both.withColumnRenamed("text", "data")).mapInArrow(confirm, "a long, b long")


def _open_groups(members: DataFrame, known: DataFrame) -> DataFrame:
    """``grp, rep, component, n, main``: what buckets whose members are in several components still have to compare.

    The component that has most members in such a bucket is its main one. Buckets with the same main component (the many
    buckets that one group of copies fills) are one group, so a pair is compared once and not in each of its buckets."""
    placed = members.join(known, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("rows"))
    mains = shares.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("rows", -F.col("component"))).alias("grp")).where("parts > 1")
    return placed.join(mains.select("key", "grp"), "key").select("grp", "rep", "component", "n", (F.col("component") == F.col("grp")).alias("main")).distinct()


def _blocks(groups: DataFrame) -> DataFrame:
    """Groups dealt out in tasks ``grp, i, j`` of bounded size: block i of the main component's members with block j of
    the others (``i = 0`` compares the others of block j among themselves, too), or for ``i < 0`` blocks -1 - i and j of
    the others. Only members outside the main component are in several of its blocks."""
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.count_if(c) / F.lit(BLOCK)), F.ceil(F.sum(F.when(c, F.col("n")).otherwise(0)) / F.lit(WORDS))).cast("int")
    sizes = groups.groupBy("grp").agg(blocks(F.col("main")).alias("mains"), blocks(~F.col("main")).alias("others"))
    sizes = hinted(written(sizes.where("mains > 1 OR others > 1"), "sizes"))  # a row for a block's rows at least
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    placed = groups.join(sizes, "grp", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("mains", "others")}).withColumn("own", own)
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    with_others = F.transform(upto("others"), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))
    with_mains = F.transform(upto("mains"), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    among = F.transform(F.filter(upto("others"), lambda j: j != F.col("own")), lambda j: F.struct((-1 - F.least(j, "own")).alias("i"), F.greatest(j, "own").alias("j")))
    return placed.withColumn("at", F.explode(F.when(F.col("main"), with_others).otherwise(F.concat(with_mains, among)))).select("grp", "at.i", "at.j", "own", "main", "rep", "component")


def new_links(sets: list[np.ndarray], component: np.ndarray, main: np.ndarray, block: np.ndarray, i: int, percent: int) -> Iterator[tuple[int, int]]:
    """Rows of a task of :func:`_blocks` that are similar enough and in different components, most similar first; a pair is
    taken to be linked unless ``False`` is sent back. No pair of components is given again once it is linked.

    The common shingles of a row with all others are counted at once, over the lists of the rows that have a shingle."""
    sizes = np.array([len(s) for s in sets])
    ends, label = np.cumsum(sizes), component.copy()
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    rows, begins = np.repeat(np.arange(len(sets)), sizes)[order], np.append(0, np.cumsum(np.bincount(token)))
    for x in np.flatnonzero(~main).tolist():
        mine = token[ends[x] - sizes[x] : ends[x]]
        n = begins[mine + 1] - begins[mine]
        at = np.repeat(begins[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(rows[at], minlength=len(sets))
        near = (100 * both >= percent * (sizes[x] + sizes - both)) & (label != label[x])
        near &= main | ((np.arange(len(sets)) < x) if i == 0 else (block != block[x]) if i < 0 else False)
        while near.any():
            y = int(np.where(near, both / (sizes[x] + sizes - both), -1).argmax())
            if (yield x, y) is False:
                near[y] = False
                continue
            label[label == label[y]] = label[x]
            near &= label != label[x]


def _between(groups: DataFrame, texts: Texts, k: int, percent: int) -> DataFrame:
    """Links of members of a group that are still in different components."""
    held = texts.of(groups.select("rep").distinct(), "near-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in whole_groups(batches, ["grp", "i", "j"]):
            w = words(task.column("text"))
            sets = shingle_hashes(w.hashes(), w.bounds, k)
            rep, component, main, own = (task.column(c).to_numpy() for c in ("rep", "component", "main", "own"))
            exact: dict[int, set] = {}
            pairs, links, answer = new_links(sets, component, main, own, task.column("i")[0].as_py(), percent), [], None
            with contextlib.suppress(StopIteration):
                while True:
                    x, y = pairs.send(answer)
                    for z in (x, y):
                        if z not in exact:
                            exact[z] = shingles(task.column("text")[z].as_py(), k)
                    if answer := similar(exact[x], exact[y], percent):
                        links.append(sorted((int(rep[x]), int(rep[y]))))
            yield pa.RecordBatch.from_arrays([pa.array([v[n] for v in links], pa.int64()) for n in (0, 1)], ["a", "b"])

    rows = _blocks(groups).join(held, "rep").repartition(tasks(groups, 500), "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "rep")
    return rows.mapInArrow(compare, "a long, b long")


def hub_pairs(members: DataFrame) -> DataFrame:
    """``a, b``: each member of a bucket with its hub. ``members`` is a stored table of distinct ``key, rep`` with ``rows``, the
    number of members of the bucket."""
    degrees = members.groupBy("rep").agg(F.sum("rows").alias("degree"))
    hubs = members.join(degrees, "rep").groupBy("key").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("hub"))
    return members.join(hinted(written(hubs, "hubs")), "key").where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()


def _orders(groups: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """``grp, tokens, counts``, stored: shingles that several members of a sample of the group have, and how many; sorted."""
    by_hash = groups.groupBy("grp", F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)).alias("part")).agg(F.min_by(F.struct("rep", "n"), F.xxhash64(F.lit(1), "rep")).alias("x"))
    upto = F.sum("x.n").over(W.partitionBy("grp").orderBy("x.n", "x.rep").rowsBetween(W.unboundedPreceding, 0))  # ``SAMPLE`` rows
    sample = by_hash.select("grp", "x.rep", "x.n", upto.alias("upto")).where((F.col("upto") <= WORDS) | (F.col("upto") == F.col("n")))

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["grp"]):
            w = words(t.column("text"))
            tokens, counts = np.unique(np.concatenate(shingle_hashes(w.hashes(), w.bounds, k)), return_counts=True)
            tokens, counts = tokens[counts > 1], counts[counts > 1]
            yield pa.RecordBatch.from_pylist([{"grp": t.column("grp")[0].as_py(), "tokens": tokens.tobytes(), "counts": counts.astype(np.uint8).tobytes()}], pa.schema([("grp", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())]))

    rows = sample.join(held, "rep").select("grp", "rep", "text").repartition("grp").sortWithinPartitions("grp", "rep")
    return written(rows.mapInArrow(common, "grp long, tokens binary, counts binary"), "orders")


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many of the first shingles of a set of ``n`` any similar set shares one with: as far as sets go that aren't smaller,
    and those that aren't larger (whose own prefix is the first of these)."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def _prefixes(groups: DataFrame, held: DataFrame, k: int, percent: int) -> DataFrame:
    """``tk, rep, component, n, small``: prefix shingles of the members of groups; ``small`` marks the shorter prefix, that for
    sets which aren't smaller."""
    orders = _orders(groups, held, k)
    counts = groups.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(SALT)).cast("int").alias("salts"))
    own = counts.join(orders, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "tokens", "counts")
    split = hinted(written(counts.where("salts > 1"), "split"))  # a row for SALT members at most
    salt = F.pmod(F.xxhash64("rep"), F.coalesce("salts", F.lit(1))).cast("int")
    others = groups.join(split, "grp", "left").select("grp", salt.alias("salt"), "rep", "component").join(held, "rep")
    rows = own.unionByName(others, allowMissingColumns=True).repartition(tasks(groups, 500), "grp", "salt").sortWithinPartitions("grp", "salt", F.col("rep").asc_nulls_first())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        for b in batches:
            w = words(b.column("text"))
            sets, out = shingle_hashes(w.hashes(), w.bounds, k), []
            rep, component, grp = (b.column(c).fill_null(0).to_numpy() for c in ("rep", "component", "grp"))
            for i, own in enumerate(b.column("tokens")):
                if own.is_valid:
                    tokens, counts = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(b.column("counts")[i].as_py(), np.uint8)
                    continue
                s = sets[i]
                at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                weight = np.where(tokens[at] == s, counts[at], 0) if len(tokens) else np.zeros(len(s), np.uint8)
                short, long = prefix_lengths(len(s), percent)
                first = s[np.lexsort((s, weight))[:long]]
                key = mixed(first + mixed(grp[i : i + 1].view(np.uint64)))
                out.append((key.view(np.int64), np.full(long, rep[i]), np.full(long, component[i]), np.full(long, len(s)), np.arange(long) < short))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["tk", "rep", "component", "n", "small"])

    return rows.mapInArrow(cut, "tk long, rep long, component long, n long, small boolean")


def _again(known: DataFrame, links: DataFrame) -> DataFrame:
    return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def links_within(members: DataFrame, texts: Texts, k: int, percent: int, likely: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """``node, component`` of the links between members of the same bucket. ``members`` is a stored table of distinct ``key, rep,
    n`` and ``rows`` (of the bucket, two or more); ``likely`` may drop pairs that can't be similar."""
    pairs = written(hub_pairs(members), "pairs")
    known = components(written(_confirmed(likely(pairs), texts, k, percent), "confirmed"))
    groups = written(_open_groups(members, known), "groups")
    if groups.isEmpty():
        return known
    held = texts.of(groups.select("rep").distinct(), "near-texts")
    prefixes = written(_prefixes(groups, held, k, percent), "prefixes")
    shared = prefixes.groupBy("tk").agg(F.count("*").alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_or("small").alias("small")).where("lo != hi AND small")
    near = written(prefixes.join(shared.select("tk", "rows"), "tk"), "near")
    few, many = near.where(F.col("rows") <= FEW), near.where(F.col("rows") > FEW)
    x, y = few.where("small").select("tk", "rep", "n", "component").toDF("tk", "a", "na", "ca"), few.select("tk", "rep", "n", "component").toDF("tk", "b", "nb", "cb")
    near_pairs = x.join(y, "tk").where((F.col("ca") != F.col("cb")) & (F.col("na") <= F.col("nb")) & (100 * F.col("na") >= percent * F.col("nb")))
    many = written(many.select(F.col("tk").alias("key"), "rep", "n", "rows").distinct(), "many")
    pairs = written(near_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(hub_pairs(many)).distinct(), "near-pairs")
    more = written(_confirmed(likely(pairs), texts, k, percent), "near-links")
    known = known if more.isEmpty() else _again(known, more)
    rest = written(_open_groups(many, known), "rest")
    if not rest.isEmpty():
        last = written(_between(rest, texts, k, percent), "between")
        known = known if last.isEmpty() else _again(known, last)
    return known


def classes_of(linkable: DataFrame) -> DataFrame:
    """``rep``, the set's key, ``doc_id, text_key, rows``, stored: equal sets are one node, which its first row stands for."""
    first = F.min(F.struct("doc_id", "text_key"))
    grouped = linkable.groupBy(*SET_KEY).agg(first.alias("row"), F.count("*").alias("rows"))
    return written(grouped.select(F.monotonically_increasing_id().alias("rep"), *SET_KEY, "row.*", "rows"), "classes")


def bucket_members(buckets: DataFrame) -> DataFrame:
    """``key, rep, n, rows``, stored: distinct rows of ``buckets`` (key, rep, n) whose key several have."""
    shared = buckets.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("key")
    each = written(buckets.join(hinted(written(shared, "shared-keys")), "key").distinct(), "bucket-rows")
    counts = each.groupBy("key").agg(F.count("*").alias("rows"))
    return written(each.join(hinted(written(counts, "bucket-sizes")), "key"), "members")


def named(all_docs: DataFrame, classes: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id`` of all documents: components are named by the smallest id of their
    nodes; those of one node with one row need no join."""
    linked = known.select(F.explode(F.array("node", "component")).alias("rep"), "component").distinct()
    linked = written(classes.join(linked, "rep", "left").where("component IS NOT NULL OR rows > 1"), "linked")
    names = linked.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("name"))
    grouped = hinted(written(linked.join(names, "component", "left").select(*SET_KEY, F.coalesce("name", "doc_id").alias("component_id")), "named-classes"))
    out = all_docs.select("doc_id", "text_key", *SET_KEY).join(grouped, SET_KEY, "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def set_keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """Sizes of sets of hashes, and 128 bits that equal sets share."""
    a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    b = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
