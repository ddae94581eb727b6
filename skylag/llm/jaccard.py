"""Near-duplicate join on word shingles by prefix filters under several global orders (operator 4).

A document's set holds the hashes of its distinct runs of five words (of all its words if there are fewer). Two
sets of which 75 % is shared must share a token among the first ``floor(n / 4) + 1`` of each under *every* total order of
the tokens. Three orders are used:

1. common tokens last, then by hash. Tokens of each document's prefix are dealt into buckets; documents that meet on a
   token are candidates. The common tokens are a bounded list of the ``HEAVY_TOKENS`` most frequent; the order only
   decides how many candidates there are, never what is found.
2. a second hash: the first quarter of this order alone must not hold more tokens of one set only than linked sets may
   differ in, a bound that sets which share just a passage do not keep;
3. a third hash: the prefixes must share a token here too.

What passes all filters is verified exactly on the full sets. Links are transitive in the result, so not all pairs of a large
group are made: on each token every document meets the smallest one (the pivot). A token that very many documents share is
spread over all buckets with a pivot in each.

Documents that then still share a token but no component first pass a sketch of the second hash, one bit per token or two, which
never differ in more bits than the sets in tokens. Those left are dealt anew by longer sketches: documents that a chain of possible
links joins are one group, so that each is in one group only, however many tokens it was found by, and the work on whole sets is
bounded by the tokens of the input. They are compared by their differences to the core of their group, the tokens that most of it holds. The member nearest to the core is linked to every member that any other could be linked to without
sharing a part of the differences. All other links need shared parts, of which prefix filters under two opposite orders apply again;
members that pass meet in tiles, block against block, and only links leave a tile, so no row per pair is made anywhere.

Null and empty texts have no set, link with nothing and are their own component. Rows that repeat a doc_id share its
component; rows without doc_id have none. An empty table gives an empty result; other columns are ignored by ``classes`` and
carried along by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skylag.llm.components import components
from skylag.llm.tables import forget, free_name, written
from skylag.llm.words import batch_words, grams, mix, sequence_hash, sliced

SHINGLE = 5
PERCENT = 75
#: Bound of the broadcast list of common tokens (8 bytes each), and the count from which a token is common.
HEAVY_TOKENS, HEAVY_COUNT = 1 << 16, 16
#: Tokens that a bucket holds in one task's memory, about.
BUCKET_TOKENS = 1 << 20
#: Groups up to this size make all pairs at once.
SMALL_GROUP = 4
#: Longer sketches have so many times the bits; what then passes shares about 74 % and more.
LONGER = 8
#: Document ids below which a list of them is broadcast to a scan (8 bytes each); above, the scan is shuffled.
BROADCAST_IDS = 1 << 19
#: A block of a large group holds about so many tokens, each row counted as so many more. A member is copied once per block, so
#: large blocks move less; pairs of rows looked at, and meetings of tokens counted, at once bound what a tile needs in memory.
TILE, ROW_WEIGHT, PAIRS, MEETINGS = 1 << 20, 256, 1 << 18, 1 << 20
_SECOND, _THIRD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_QUARTER = np.uint64(1 << 62)


def token_set(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a document."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([sequence_hash(words) ^ 0x9E3779B9], np.uint64)
    return np.unique(grams(words, k))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Among so many tokens at the front of both sets, under any order, two linked sets share one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Document ids and token sets, about a megabyte of text at a time."""
    for batch in sliced(batches, "text"):
        ids = batch.column("doc_id").to_pylist()
        for first, places, words in batch_words(batch.column("text"), lower=True):
            sets = [token_set(words[a:b]) for a, b in zip(places, places[1:])]
            yield ids[first:first + len(sets)], sets


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size and key; at times a row with tokens seen repeatedly in this task."""
    pool: list[np.ndarray] = []

    def frequent():
        tokens, counts = np.unique(np.concatenate(pool), return_counts=True) if pool else (np.empty(0, np.uint64),) * 2
        often = counts >= 3
        pool.clear()
        return list(zip(tokens[often].view(np.int64).tolist(), counts[often].tolist()))

    def rows(ids, sizes, keys, heavy):
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
             pa.array([k[1] for k in keys], pa.int64()),
             pa.array(heavy, pa.list_(pa.struct([("token", pa.int64()), ("count", pa.int64())])))],
            names=["doc_id", "n", "key1", "key2", "heavy"])

    for ids, sets in _sets(batches):
        keys = [_signed(sequence_hash(s), sequence_hash(mix(s ^ _SECOND))) for s in sets]
        # Common tokens may stand behind the prefix once others are moved back, so twice the prefix is counted.
        pool.extend(s[:2 * prefix_size(len(s))] for s in sets)
        heavy = None
        if sum(map(len, pool)) > BUCKET_TOKENS:
            heavy = [{"token": t, "count": c} for t, c in frequent()]
        yield rows(ids, [len(s) for s in sets], keys, [None] * len(ids))
        if heavy:
            yield rows([None], [None], [(None, None)], [heavy])
    if pool and (heavy := [{"token": t, "count": c} for t, c in frequent()]):
        yield rows([None], [None], [(None, None)], [heavy])


def _signed(*values: int) -> tuple[int, ...]:
    return tuple(v - (1 << 64) if v >> 63 else v for v in values)


def _ordered(tokens: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix under the first order, and which of it is common."""
    p = prefix_size(len(tokens))
    if not len(heavy):
        return tokens[:p], np.zeros(p, bool)
    place = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
    common = heavy[place] == tokens
    order = np.argsort(common, kind="stable")[:p]
    return tokens[order], common[order]


def _dealt(heavy: np.ndarray, buckets: int):
    """Prefix tokens by bucket: a row holds those of about a megabyte of text for one bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets that this task has dealt already
        for ids, sets in _sets(batches):
            tokens, owners, common = [], [], []
            for doc, s in zip(ids, sets):
                if not len(s) or doc is None:
                    continue
                key = sequence_hash(s)
                if key in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(key)
                t, c = _ordered(s, heavy)
                tokens.append(t), common.append(c), owners.append(np.full(len(t), doc, np.int64))
            if not tokens:
                continue
            t, o, c = map(np.concatenate, (tokens, owners, common))
            # Common tokens are spread by document too.
            bucket = (mix(t ^ np.where(c, mix(o.view(np.uint64)), np.uint64(0))) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            parts = [order[a:b] for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([t[p].tobytes() for p in parts], pa.binary()),
                 pa.array([o[p].tobytes() for p in parts], pa.binary()), pa.array([np.packbits(c[p]).tobytes() for p in parts], pa.binary())],
                names=["bucket", "tokens", "docs", "common"])
    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets, one after the other, to documents that meet on a token.

    Rows (token, doc, pivot); token is null where the pair settles the matter, else the token's documents go on.
    """
    waiting: list[tuple] = []
    current = None

    def out(token, doc, pivot, goes_on):
        return pa.RecordBatch.from_arrays(
            [pa.array(token, pa.int64(), mask=~goes_on), pa.array(doc, pa.int64()), pa.array(pivot, pa.int64())],
            names=["token", "doc", "pivot"])

    def bucket():
        t = np.concatenate([np.frombuffer(r[0], np.uint64) for r in waiting])
        d = np.concatenate([np.frombuffer(r[1], np.int64) for r in waiting])
        c = np.concatenate([np.unpackbits(np.frombuffer(r[2], np.uint8), count=len(r[1]) // 8).astype(bool) for r in waiting])
        waiting.clear()
        order = np.lexsort((d, t))
        t, d, c = t[order], d[order], c[order]
        fresh = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])
        t, d, c = t[fresh], d[fresh], c[fresh]
        start = np.concatenate([[True], t[1:] != t[:-1]])
        group = np.cumsum(start) - 1
        size = np.bincount(group)
        first = np.flatnonzero(start)
        pivot = d[first][group]
        many = (size > SMALL_GROUP)[group] | c
        star = (size > 1)[group] & ~start | c
        pairs = [np.stack([d[star & ~many], pivot[star & ~many]])]
        # The other pairs of small groups.
        for step in range(1, SMALL_GROUP):
            same = np.flatnonzero((group[step:] == group[:-step]) & ~many[step:] & ~start[:-step])
            pairs.append(np.stack([d[same + step], d[same]]))
        doc, low = np.unique(np.concatenate(pairs, axis=1), axis=1)
        rest = np.flatnonzero(many & (star | start))
        none = np.zeros(len(doc) + len(rest), np.int64)
        none[len(doc):] = t[rest].view(np.int64)
        return out(none, np.concatenate([doc, d[rest]]), np.concatenate([low, pivot[rest]]),
                   np.arange(len(none)) >= len(doc))

    for batch in batches:
        for b, t, d, c in zip(*(batch.column(n).to_pylist() for n in ("bucket", "tokens", "docs", "common"))):
            if b != current and waiting:
                yield bucket()
            current = b
            waiting.append((t, d, c))
    if waiting:
        yield bucket()


def _listed(ids: list, sizes: list[int], arrays: list[np.ndarray], dtype) -> pa.RecordBatch:
    flat = np.concatenate(arrays).view(dtype) if arrays else np.empty(0, dtype)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                                       pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc", "n", "tokens"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens in the first quarter of the second order, two bytes each.

    Different tokens with equal bytes only make two sets more alike, which lets more through: shortened sets never differ in more
    tokens than the whole ones.
    """
    for ids, sets in _sets(batches):
        second = [mix(s ^ _SECOND) for s in sets]
        yield _listed(ids, [len(s) for s in sets], [np.unique(h[h < _QUARTER].astype(np.uint16)) for h in second], np.int16)


def _sketches(batches: Iterator[pa.RecordBatch], times: int = 1) -> Iterator[pa.RecordBatch]:
    """Parities of whole sets in 64-bit words: a token flips the bit that the end of its second hash names.

    A set of n tokens has n to 2 n bits, a power of two and 64 at least, ``times`` as many (a power of two) for longer sketches, so that
    halves laid over each other are the sketch of half the length. Two sketches of one length never differ in more bits than their sets
    in tokens.
    """
    for ids, sets in _sets(batches):
        sketches = []
        for s in sets:
            bits = times * (max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64)
            flips = np.bincount((mix(s ^ _SECOND) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
            sketches.append(np.packbits(flips.astype(np.uint8) & 1, bitorder="little").view(np.int64))
        yield _listed(ids, [len(s) for s in sets], sketches, np.int64)


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Longer sketches."""
    return _sketches(batches, LONGER)


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets under the third order."""
    for ids, sets in _sets(batches):
        yield _listed(ids, [len(s) for s in sets], [s[np.argsort(mix(s ^ _THIRD))] for s in sets], np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def facts(docs: DataFrame) -> DataFrame:
    """Written table of one row per document (doc_id, n, key1, key2), and rows with common tokens."""
    return written(_texts(docs).mapInArrow(
        _facts, "doc_id bigint, n bigint, key1 bigint, key2 bigint, heavy array<struct<token: bigint, count: bigint>>"), "facts")


def _heavy_tokens(known: DataFrame) -> np.ndarray:
    """The common tokens, sorted: all whose count reaches a limit that at most HEAVY_TOKENS of them reach."""
    counts = (known.filter("heavy is not null").select(F.explode("heavy").alias("h")).groupBy("h.token")
              .agg(F.sum("h.count").alias("c")).filter(F.col("c") >= HEAVY_COUNT)
              .withColumn("level", F.floor(F.log2("c") * 4)))
    total, least = 0, None
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > HEAVY_TOKENS:
            break
        least = r["level"]
    if least is None:
        return np.empty(0, np.uint64)
    tokens = [r["token"] for r in counts.filter(F.col("level") >= least).select("token").collect()]
    return np.sort(np.array(tokens, np.int64).view(np.uint64))


def _lists(docs: DataFrame, ids: DataFrame, make, kind: str) -> DataFrame:
    """Token lists (doc, n, tokens) of the documents named in ``ids`` (id), n the size of the whole set: written."""
    ids = written(ids.distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    lists = written(_texts(docs).join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
                    .mapInArrow(make, f"doc bigint, n bigint, tokens array<{kind}>"), "lists")
    forget(ids)
    return lists


def _of(docs: DataFrame, pairs: DataFrame, make, kind: str) -> tuple[DataFrame, DataFrame]:
    """Token lists of the documents in pairs: of all (doc, n, tokens), and of the pivots (pivot, low)."""
    lists = _lists(docs, pairs.select(F.explode(F.array("doc", "pivot")).alias("id")), make, kind)
    lows = pairs.select(F.col("pivot").alias("doc")).distinct()
    return lists, lists.join(lows, "doc", "left_semi").select(F.col("doc").alias("pivot"), F.col("tokens").alias("low"))


def _distances(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of candidates (doc, pivot, n, m) those that pass the filters of the other orders, with their distance: written.

    Linked sets differ in at most (n + m) / 7 tokens. The second order's first quarter alone must keep to that, and it is an
    eighth of the bytes of the sets, which only the pairs that are left have to move.
    """
    heads, low_heads = _of(docs, pairs, _heads, "smallint")
    differ = F.size("tokens") + F.size("low") - 2 * F.size(F.array_intersect("tokens", "low"))
    near = written(pairs.join(heads.drop("n").hint("merge"), "doc").join(low_heads.hint("merge"), "pivot")
                   .filter((100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("n") + F.col("m")))
                   .select("doc", "pivot").distinct(), "near")
    forget(heads, pairs)
    sets, low_sets = _of(docs, near, _full, "bigint")
    n, m = F.size("tokens"), F.size("low")
    front = lambda c, size: F.slice(c, F.lit(1), _prefix(size))
    shared = F.size(F.array_intersect("tokens", "low"))
    found = written(near.join(sets.drop("n").hint("merge"), "doc").join(low_sets.hint("merge"), "pivot")
                   .filter(F.arrays_overlap(front("tokens", n), front("low", m)))
                   .select("doc", "pivot", shared.alias("shared"), (n + m - shared).alias("all"))
                   .groupBy("doc", "pivot").agg(F.max(F.struct((F.col("shared") / F.col("all")).alias("share"), "shared", "all")).alias("s"))
                   .select("doc", "pivot", (1 - F.col("s.share")).alias("distance"),
                           (100 * F.col("s.shared") >= PERCENT * F.col("s.all")).alias("linked")), "distances")
    forget(sets, near)
    return found


def _links(distances: DataFrame) -> DataFrame:
    return distances.filter("linked").select(F.col("doc").alias("a"), F.col("pivot").alias("b"))


def _prefix(n):
    return (n - F.ceil(n * PERCENT / F.lit(100)) + 1).cast("int")


def _labels(copies: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of every document with a copy or a link."""
    return written(components(copies.union(links)), "labels")


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    known = facts(docs)
    heavy = _heavy_tokens(known)
    rows = known.filter("heavy is null")
    total = rows.agg(F.coalesce(F.sum(F.col("n") / 4 + 1), F.lit(0))).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // BUCKET_TOKENS)

    met = written(_texts(docs).mapInArrow(_dealt(heavy, buckets), "bucket int, tokens binary, docs binary, common binary")
                  .repartition("bucket").sortWithinPartitions("bucket")
                  .mapInArrow(_met, "token bigint, doc bigint, pivot bigint"), "met")
    # Equal sets are one node: the smallest doc_id stands for all.
    named = rows.filter("n > 0 and doc_id is not null")
    first = named.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"))
    reps = written(named.join(first, ["key1", "key2"]).select("doc_id", "rep", "n").distinct(), "reps")
    copies = reps.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    def settled(pairs: DataFrame) -> DataFrame:
        """Pairs of representatives with their sizes: distinct, not equal, of sizes that a link allows."""
        a = reps.select(F.col("doc_id").alias("doc"), F.col("rep").alias("x"), "n")
        b = reps.select(F.col("doc_id").alias("pivot"), F.col("rep").alias("y"), F.col("n").alias("m"))
        return written(pairs.distinct().join(a, "doc").join(b, "pivot")
                       .filter((F.col("x") != F.col("y")) & (100 * F.col("n") >= PERCENT * F.col("m"))
                               & (100 * F.col("m") >= PERCENT * F.col("n")))
                       .select(F.greatest("x", "y").alias("doc"), F.least("x", "y").alias("pivot"),
                               F.when(F.col("x") > F.col("y"), F.col("n")).otherwise(F.col("m")).alias("n"),
                               F.when(F.col("x") > F.col("y"), F.col("m")).otherwise(F.col("n")).alias("m")).distinct(), "pairs")

    tried = _distances(docs, settled(met.filter("doc <> pivot").select("doc", "pivot")))
    labels = _labels(copies, _links(tried))
    still = _open_rows(met.filter("token is not null"), reps, labels)
    forget(met)
    found, best = _differences(docs, still)
    forget(still, labels)
    apart = found.join(best, "g")
    links = written(_links(tried).union(_star(apart)), "links")
    labels = _labels(copies, links)
    # Of two members the core is what both hold, so no part of their differences is shared.
    rest = _tile_links(_named(apart.filter("size > 2").drop("component"), labels, "x", "component"))
    forget(tried, found, best, labels)
    labels = _labels(copies, links.union(rest))
    forget(reps, links, rest)
    return rows.join(labels, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _open_rows(met: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens whose documents have not all been compared, by representative: (token, x, component); written, rows may repeat."""
    known = _named(reps.select(F.col("doc_id").alias("doc"), F.col("rep").alias("x")), labels, "x", "component")
    return written(met.select("token", "doc").join(known, "doc").select("token", "x", "component"), "open")


def _named(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of a column's documents."""
    known = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return (rows.join(known, F.col(node) == F.col("_node"), "left")
            .withColumn(name, F.coalesce("_component", node)).drop("_node", "_component"))


def _members(rows: DataFrame) -> DataFrame:
    """Members (g, x, component) of groups: the documents of all tokens whose smallest document is ``g``; written."""
    # Tokens within one component are done.
    tokens = (rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("x").alias("g"))
              .filter("low <> high").select("token", "g"))
    return written(rows.join(tokens, "token").select("g", "x", "component").distinct(), "members")


def _possible(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The members that sketches do not tell apart from all members of other components: written.

    Sketches are a thirty-second to a sixty-fourth of the sets' bytes, and sets of a share below about 60 % end here: those that only have a
    passage in common, whose number grows with the groups, are never fetched.
    """
    found = _sketched(docs, members, _sketches)
    tiles, blocks = _tiles(found, "n")
    left = tiles.applyInArrow(_tile_members, "g bigint, x bigint").distinct()
    possible = written(members.join(left, ["g", "x"], "left_semi"), "possible")
    forget(found, blocks, members)
    return possible


def _sketched(docs: DataFrame, members: DataFrame, make) -> DataFrame:
    """Members with their sketches (d) and the sizes of their sets (n): written."""
    sketches = _lists(docs, members.select(F.col("x").alias("id")), make, "bigint")
    found = written(members.join(sketches.select(F.col("doc").alias("x"), "n", F.col("tokens").alias("d")).hint("merge"), "x"), "sketches")
    forget(sketches)
    return found


def _regrouped(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Members (g, x, component) in new groups, joined by the pairs that longer sketches let through: written.

    A document that shares tokens with several others is a member of several groups, whose number grows with the table. Here
    it is in one, with all it may be linked to and without unrelated texts that only came with the group's tokens; ``g`` is the smallest.
    """
    found = _sketched(docs, members, _longer)
    tiles, blocks = _tiles(found, "n")
    stars = written(tiles.applyInArrow(_tile_stars, "a bigint, b bigint"), "stars")
    groups = components(stars).select(F.col("component").alias("g"), F.col("node").alias("x"))
    regrouped = written(members.select("x", "component").distinct().join(groups, "x").select("g", "x", "component"), "regrouped")
    forget(found, blocks, stars, members)
    return regrouped


def _differences(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that still share a token but no component, each as its difference to its group's core: written.

    Rows (g, x, n, component, d, slack), and (g, most, size). Any two documents that may be linked share a group, and each is in one only.
    The core is what more than half of the members hold, at most twice their mean size; ``d`` is the symmetric difference to it. Two members differ in size(d) + size(e) - 2k tokens if they share k of these, so they are linked
    exactly if slack + slack + 14 k >= 0 with slack = n - 7 size(d). ``most`` is the greatest (slack, -x) of the group, ``size``
    its number of members.
    """
    members = _regrouped(docs, _possible(docs, _members(rows)))
    sets = _lists(docs, members.select(F.col("x").alias("id")), _full, "bigint").withColumnRenamed("doc", "x")
    held = written(members.join(sets.hint("merge"), "x").distinct(), "held")
    forget(sets, members)
    core = _core(held)
    core_of = F.coalesce("core", F.array().cast("array<bigint>"))
    found = written(held.join(core, "g", "left").select(
        "g", "x", "n", "component", F.sort_array(F.concat(F.array_except("tokens", core_of), F.array_except(core_of, "tokens"))).alias("d"))
        .withColumn("slack", F.col("n") - 7 * F.size("d")), "differences")
    forget(held, core)
    # One row per group, written: Catalyst broadcasts it while it is small, and the differences need not move.
    best = written(found.groupBy("g").agg(F.max(F.struct("slack", (-F.col("x")).alias("minus"))).alias("most"),
                                            F.count(F.lit(1)).alias("size")), "best")
    return found, best


def _core(held: DataFrame) -> DataFrame:
    """Core (g, core) of each group with one: written.

    A group's members are dealt into parts, which count their tokens where they lie; only tokens that more than half of a part
    holds go on. A token of more than half of the group is such a token in some part. One that falls short in others may miss
    the core, which then is a little smaller: the differences are to one set all the same, so no link depends on it.
    """
    sizes = written(held.groupBy("g").agg(F.count(F.lit(1)).alias("size"),
                                          F.ceil(F.sum(F.size("tokens")) / BUCKET_TOKENS).alias("parts")), "sizes")
    dealt = (held.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")))
             .select("g", "part", "tokens").repartition("g", "part"))
    # A null token stands for a member: its count is the size of the part.
    counted = (dealt.select("g", "part", F.explode(F.concat("tokens", F.array(F.lit(None).cast("bigint")))).alias("token"))
               .groupBy("g", "part", "token").count())
    part = Window.partitionBy("g", "part")
    often = (counted.withColumn("members", F.max(F.when(F.col("token").isNull(), F.col("count"))).over(part))
             .filter("token is not null and 2 * count > members"))
    core = written(often.groupBy("g", "token").agg(F.sum("count").alias("count")).join(sizes, "g")
                   .filter(2 * F.col("count") > F.col("size")).groupBy("g").agg(F.collect_list("token").alias("core")), "core")
    forget(sizes)
    return core


def _star(found: DataFrame) -> DataFrame:
    """Links (a, b) to the member with the greatest slack.

    If any two members are linked without sharing a part of their differences, both are linked to this one.
    """
    return (found.select(F.col("x").alias("a"), (-F.col("most.minus")).alias("b"), (F.col("slack") + F.col("most.slack")).alias("both"))
            .filter("a <> b and both >= 0").select("a", "b").distinct())


def _sharing(found: DataFrame) -> DataFrame:
    """Keys (member) of the members that may be linked by what they share of their differences: written.

    A partner shares at least ``need`` tokens of ``d``, so one of the first ``size(d) - need + 1`` under every order. Under the order
    of the hashes such a token must be shared with another component, and among the members left also under the opposite order.
    Members and tokens of a group go by a hash: equal hashes of different ones only let more through.
    """
    size = F.size("d").cast("bigint")
    need = F.greatest(F.lit(1), F.ceil(-(F.col("slack") + F.col("most.slack")) / 14), size - F.floor(F.col("n") / 3))
    front = F.greatest(F.lit(0), size - need + 1).cast("int")
    shared = None
    for tokens in (F.slice("d", F.lit(1), front), F.slice("d", (size - front + 1).cast("int"), front)):
        left = found if shared is None else found.join(shared, "member", "left_semi")
        spread = (left.filter(front > 0).select("member", "component", "g", F.explode(tokens).alias("token"))
                  .select("member", "component", F.xxhash64("g", "token").alias("key")))
        common = (spread.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                  .filter("low <> high").select("key"))
        before, shared = shared, written(
            spread.select("member", "key").join(common, "key", "left_semi").select("member").distinct(), "sharing")
        if before is not None:
            forget(before)
    return shared


def _tile_links(found: DataFrame) -> DataFrame:
    """Links (a, b) between members that share parts of their differences: written."""
    found = found.withColumn("member", F.xxhash64("g", "x"))
    sharing = _sharing(found)
    left = written(found.join(sharing, "member", "left_semi").select("g", "x", "component", "d", "slack"), "left")
    tiles, blocks = _tiles(left, "slack")
    links = written(tiles.applyInArrow(_tile_forest, "a bigint, b bigint"), "tiles")
    forget(sharing, left, blocks)
    return links


def _tiles(found: DataFrame, size: str):
    """Rows (g, x, component, d, ``size``) by tile: every two blocks of a group, and every block with itself.

    A group is dealt into blocks of about ``TILE`` tokens by a hash. Also the written table of the groups' numbers of blocks.
    """
    blocks = written(found.groupBy("g").agg(F.ceil(F.sum(F.size("d") + ROW_WEIGHT) / TILE).cast("int").alias("blocks")), "blocks")
    tiles = (found.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                    (F.col("block") > F.col("other")).alias("right"), "x", "component", "d", size).groupBy("g", "i", "j"))
    return tiles, blocks


def _near(table: pa.Table, x: np.ndarray, component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of a tile in different components that may be linked by ``slack`` and ``d``, some rows at a time."""
    slack, right = (table.column(c).to_numpy() for c in ("slack", "right"))
    d = table.column("d").combine_chunks()
    tokens, sizes = d.flatten().to_numpy(), np.diff(d.offsets.to_numpy())
    owner = np.repeat(np.arange(len(x)), sizes)
    if right.any():
        low, high = np.flatnonzero(~right), np.flatnonzero(right)
    else:  # a block with itself, or with one that is empty
        low = high = np.arange(len(x))
    place = np.zeros(len(x), np.int64)
    place[low] = np.arange(len(low))
    in_low = ~right[owner]
    of_low, t_low = place[owner[in_low]], tokens[in_low]
    place[high] = np.arange(len(high))
    in_high = right[owner] if right.any() else in_low
    of_high, t_high = place[owner[in_high]], tokens[in_high]
    order = np.argsort(t_high, kind="stable")
    t_high, of_high = t_high[order], of_high[order]
    first = np.searchsorted(t_high, t_low)
    counts = np.searchsorted(t_high, t_low, side="right") - first
    step = max(1, PAIRS // max(1, len(high)))
    for a in range(0, len(low), step):
        rows = low[a:a + step]
        begin, end = np.searchsorted(of_low, [a, a + step])
        mine = begin + np.flatnonzero(counts[begin:end])
        shared = np.zeros(len(rows) * len(high), np.int64)
        part = np.cumsum(counts[mine]) // MEETINGS
        for k in np.unique(part):
            now = mine[part == k]
            ends = np.cumsum(counts[now])
            at = np.arange(ends[-1]) + np.repeat(first[now] - (ends - counts[now]), counts[now])
            shared += np.bincount(np.repeat((of_low[now] - a) * len(high), counts[now]) + of_high[at], minlength=len(shared))
        shared = shared.reshape(len(rows), len(high))
        u, v = np.nonzero((slack[rows][:, None] + slack[high] + 14 * shared >= 0) & (component[rows][:, None] != component[high]))
        yield rows[u], high[v]


def _alike(n: np.ndarray, component: np.ndarray, sketches: dict[int, tuple[np.ndarray, np.ndarray]],
           others: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows in different components that may be linked by their sizes and sketches, some rows at a time.

    Sketches (rows by size, a column for each) by their number of words. Sizes of a link allow lengths of which one is twice the other
    at most. Among ``sketches`` themselves a row meets those that are not smaller.
    """
    alone = others is sketches
    for words, (u, a) in sketches.items():
        for length in (words, 2 * words) if alone else (words // 2, words, 2 * words):
            if length not in others:
                continue
            v, b = others[length]
            p, q = ((a, b[:words] ^ b[words:]) if length > words else (a[:length] ^ a[length:], b) if length < words else (a, b))
            first = np.searchsorted(n[v], n[u] if alone else -(-PERCENT * n[u] // 100))
            last = np.searchsorted(n[v], 100 * n[u] // PERCENT, side="right")
            at = 0
            while at < len(u):
                # As many rows as make about PAIRS pairs with the sizes that any of them allows.
                end = at + int(np.searchsorted((np.arange(1, len(u) - at + 1) * (last[at:] - first[at])), PAIRS, side="right"))
                end = max(at + 1, end)
                left, right = slice(at, end), slice(first[at], last[end - 1])
                differ = np.zeros((end - at, max(0, right.stop - right.start)), np.int32)
                for i, j in zip(p, q):
                    differ += np.bitwise_count(i[left, None] ^ j[None, right])
                i, j = np.nonzero(((100 + PERCENT) * differ <= (100 - PERCENT) * (n[u[left], None] + n[v[right]]))
                                  & (component[u[left], None] != component[v[right]]))
                yield u[at + i], v[right.start + j]
                at = end


def _tile_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Such pairs of rows of a tile."""
    component, n, right = (table.column(c).to_numpy() for c in ("component", "n", "right"))
    d = table.column("d").combine_chunks()
    words, sizes = d.flatten().to_numpy().view(np.uint64), np.diff(d.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes

    def by_length(rows: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        rows = rows[np.argsort(n[rows], kind="stable")]
        return {int(k): (of, words[starts[of] + np.arange(k)[:, None]]) for k in np.unique(sizes[rows]) for of in [rows[sizes[rows] == k]]}

    low = by_length(np.flatnonzero(~right))
    high = by_length(np.flatnonzero(right)) if right.any() else low  # a block with itself, or with one that is empty
    return _alike(n, component, low, high)


def _tile_members(table: pa.Table) -> pa.Table:
    """Rows (g, x) of a tile that have such a pair."""
    x = table.column("x").to_numpy()
    paired = np.zeros(len(x), bool)
    for u, v in _tile_pairs(table):
        paired[u] = paired[v] = True
    left = np.unique(x[paired])
    return pa.table({"g": pa.array(np.full(len(left), table.column("g")[0].as_py()), pa.int64()), "x": pa.array(left, pa.int64())})


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The lowest row that each is joined with, once every u is joined with its v."""
    while (apart := root[u] != root[v]).any():
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while ((up := root[root]) != root).any():
            root = up
    return root


def _tile_stars(table: pa.Table) -> pa.Table:
    """Rows (a, b) that tie the members of a tile, as such pairs join them, to one of them."""
    x = table.column("x").to_numpy()
    root = np.arange(len(x))
    for u, v in _tile_pairs(table):
        root = _joined(root, u, v)
    tied = np.flatnonzero(root != np.arange(len(x)))
    return pa.table({"a": pa.array(x[tied], pa.int64()), "b": pa.array(x[root[tied]], pa.int64())})


def _tile_forest(table: pa.Table) -> pa.Table:
    """Links (a, b) of a tile, as few as connect the components they join."""
    x, component = (table.column(c).to_numpy() for c in ("x", "component"))
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    kept = []
    for u, v in _near(table, x, component):
        # One link for each pair of components, then as many as make a forest.
        _, one = np.unique(np.stack([component[u], component[v]]), axis=1, return_index=True)
        for k in one:
            p, q = top(int(component[u[k]])), top(int(component[v[k]]))
            if p != q:
                root[q] = p
                kept.append((int(x[u[k]]), int(x[v[k]])))
    return pa.table({"a": pa.array([k[0] for k in kept], pa.int64()), "b": pa.array([k[1] for k in kept], pa.int64())})


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component (smallest doc_id), all columns; rows without doc_id stay."""
    name = free_name(docs, "_dropped")
    found = written(classes(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "dropped")
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    return docs.join(found, F.col("doc_id") == F.col(name), "left_anti")
