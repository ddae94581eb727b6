"""Ranked lexical search by pipelined term partitioning (operator 12).

One scan of the documents counts terms and writes an inverted index of the terms that the items hold: rows (shard, term,
postings), a shard being up to ``SHARD_DOCS`` documents that one task saw one after the other. The terms are dealt to owners by
their weight, rare terms first. Items are gathered in bundles. A bundle visits each shard as one row with a sparse
accumulator of (item, document, score); each owner is a stage, a cogroup of bundles and the owner's postings on (shard,
bundle), which adds integer contributions and passes the bundle on. After each stage an accumulator goes that cannot
reach the shard's k-th score any more with all that the later owners can add, which loses nothing. The last stage leaves the k
best of a shard per item, and a window over these selects the result.

Every group of a cogroup is one bundle and the postings of one shard, however frequent a term is. Items are worked off
in blocks of at most about ``TERM_BYTES`` of terms, each block with its own scan, so that the set of terms that the tasks get
is bounded.

Null texts have no terms. Long texts are counted in slices. Rows that repeat a doc_id are documents of their own; rows without doc_id
count in the statistics and are never returned. Rows that share an item_id are one item with the terms of all of them;
items without item_id or terms return nothing. Without documents or items the result is empty. Other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from skylag.llm.tables import shared_path, written
from skylag.llm.words import text_bytes

K = 10
OWNERS = 4
BUNDLE_ITEMS = 128
SHARD_DOCS = 8192
TERM_BYTES = 32 << 20
#: Bytes of a text that are split into terms at once.
SLICE = 1 << 20
#: More than any term adds per unit of its weight.
MOST = 1_000_000

_FOLD = bytes(ord(chr(c).lower()) if c >= 128 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))

INDEX = "shard bigint, term string, docs binary, counts binary, held bigint, words bigint"
BUNDLE = ("shard bigint, bundle bigint, docs binary, words binary, items array<bigint>, rest array<array<bigint>>, "
          "places binary, scores binary")
OWNED = "shard bigint, docs binary, counts binary, bundle bigint, wanted array<struct<place:int,weight:bigint>>, owner int"
BEST = "item_id bigint, doc_id bigint, score bigint"


def count_terms(data: bytes) -> Counter:
    """Terms of one text with their numbers of occurrences."""
    folded, counts, at = data.translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(i, t.decode()) for i, data in zip(batch.column("item_id").to_pylist(), text_bytes(batch.column("text")))
                 for t in count_terms(data.tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.string())],
                                         names=["item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    rows = items.filter("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return rows.mapInArrow(_item_terms, "item_id bigint, term string").distinct()


def _index_shards(known):
    """Scan for the broadcast set of terms. A shard's first row, without a term, holds the doc_ids and numbers of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, shard = known.value, TaskContext.get().partitionId() << 32
        ids, words, held, postings = array("q"), array("q"), 0, defaultdict(lambda: array("i"))

        def flush():
            terms = list(postings)
            pairs = [np.frombuffer(postings[t], np.int32).reshape(-1, 2) for t in terms]
            docs = [ids.tobytes(), *[p[:, 0].tobytes() for p in pairs]]
            counts = [words.tobytes(), *[p[:, 1].tobytes() for p in pairs]]
            return pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(docs), pa.int64()), pa.array([None, *[t.decode() for t in terms]], pa.string()),
                 pa.array(docs, pa.binary()), pa.array(counts, pa.binary()),
                 pa.array([held, *[len(p) for p in pairs]], pa.int64()),
                 pa.array([sum(abs(w) for w in words), *[0] * len(pairs)], pa.int64())],
                names=["shard", "term", "docs", "counts", "held", "words"])

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                counts, place = count_terms(data.tobytes()), len(ids)
                n = sum(counts.values())
                held += n > 0
                ids.append(doc_id or 0)
                words.append(n if doc_id is not None else -n)  # negative: never returned
                for term in counts.keys() & wanted:
                    postings[term].extend((place, counts[term]))
                if len(ids) == SHARD_DOCS:
                    yield flush()
                    ids, words, held, postings = array("q"), array("q"), 0, defaultdict(lambda: array("i"))
                    shard += 1
        if ids:
            yield flush()
    return run


def _contributions(postings: pa.Table, words: np.ndarray, n_docs: int, n_words: int) -> Iterator[tuple]:
    """(documents, factors, items, weights) per term of an owner."""
    m8 = 8 * (100 - 90 + 90 * np.abs(words) * n_docs // n_words)
    for row in postings.to_pylist():
        docs, tf = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["counts"], np.int32).astype(np.int64)
        yield docs, np.where(words[docs] > 0, 1_000_000_000 * tf // (1000 * tf + m8[docs]), 0), row["wanted"]


def _owner_stage(owner: int, n_docs: int, n_words: int, k: int, last: bool):
    """A bundle at one owner of one shard: scores added, hopeless accumulators dropped; at the last one, the k best."""

    def run(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        (row,) = bundles.to_pylist()
        ids, words = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["words"], np.int64)
        scores = np.zeros((len(row["items"]), len(ids)), np.int64)
        scores.reshape(-1)[np.frombuffer(row["places"], np.int64)] = np.frombuffer(row["scores"], np.int64)
        for docs, factors, wanted in _contributions(postings, words, n_docs, n_words):
            for w in wanted:
                scores[w["place"], docs] += w["weight"] * factors
        if last:
            out = []
            for item, own in zip(row["items"], scores):
                some = np.flatnonzero(own >= (np.partition(own, -k)[-k] if len(own) > k else 1))
                best = some[np.lexsort((ids[some], -own[some]))][:k]
                out += [(item, int(ids[d]), int(own[d])) for d in best if own[d] > 0]
            return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])
        floor = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.zeros(len(scores), np.int64)
        rest = np.array([r[owner + 1] for r in row["rest"]], np.int64)
        places = np.flatnonzero(((scores > 0) & (scores + rest[:, None] >= floor[:, None])).reshape(-1))
        row |= {"places": places.tobytes(), "scores": scores.reshape(-1)[places].tobytes()}
        return pa.Table.from_pylist([row], schema=bundles.schema)
    return run


def _search(docs: DataFrame, terms: DataFrame, k: int, owners: int) -> DataFrame:
    """(item_id, doc_id, score) of each shard's k best for one block of items."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frozenset(r["term"].encode() for r in terms.select("term").distinct().collect()))
    index = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_index_shards(known), INDEX), "index")
    shards, postings = index.filter("term is null"), index.filter("term is not null")
    n_docs, n_words = shards.agg(F.sum("held"), F.sum("words")).first()
    if not n_words:
        return spark.createDataFrame([], BEST)

    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    top = 1000 * F.log((2 * F.lit(n_docs) + 2) / F.lit(3))
    owner = F.greatest(F.lit(0), F.least(F.lit(owners - 1), F.floor(owners * (1 - F.col("weight") / top)))).cast("int")
    df = postings.groupBy("term").agg(F.sum("held").alias("df"))
    bundles = max(1, -(-terms.select("item_id").distinct().count() // BUNDLE_ITEMS))
    weighted = (terms.join(df, "term").withColumn("weight", weight).filter("weight > 0").withColumn("owner", owner)
                .withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles))))
    # What later owners can add: at place o, all from owner o on.
    rest = F.array(*[F.sum(F.when(F.col("owner") >= o, F.col("weight")).otherwise(0) * MOST) for o in range(owners + 1)])
    items = weighted.groupBy("bundle", "item_id").agg(rest.alias("rest"))
    place = F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1
    items = written(items.withColumn("place", place), "items")
    wanted = (weighted.join(items.select("bundle", "item_id", "place"), ["bundle", "item_id"]).groupBy("term", "owner", "bundle")
              .agg(F.collect_list(F.struct("place", "weight")).alias("wanted")))
    path = shared_path(spark, "owned")
    postings.select("shard", "term", "docs", "counts").join(wanted, "term").drop("term").write.partitionBy("owner").parquet(path)
    owned = spark.read.schema(OWNED).parquet(path)

    members = F.sort_array(F.collect_list(F.struct("place", "item_id", "rest")))
    gathered = items.groupBy("bundle").agg(members.alias("m")).select("bundle", F.col("m.item_id").alias("items"), F.col("m.rest").alias("rest"))
    empty = F.lit(b"")
    at = (owned.select("shard", "bundle").distinct().join(shards.select("shard", "docs", F.col("counts").alias("words")), "shard")
          .join(gathered, "bundle").withColumns({"places": empty, "scores": empty})
          .select("shard", "bundle", "docs", "words", "items", "rest", "places", "scores"))
    for o in range(owners):
        mine = owned.filter(F.col("owner") == o).select(F.col("shard").alias("of_shard"), F.col("bundle").alias("of_bundle"),
                                                        "docs", "counts", "wanted")
        last = o == owners - 1
        at = (at.groupBy("shard", "bundle").cogroup(mine.groupBy("of_shard", "of_bundle"))
              .applyInArrow(_owner_stage(o, n_docs, n_words, k, last), BEST if last else BUNDLE))
    return at


def rank(docs: DataFrame, items: DataFrame, k: int = K, owners: int = OWNERS, term_bytes: int = TERM_BYTES) -> DataFrame:
    """The ``k`` documents of the highest score above 0 per item: item_id, rank, doc_id, score; ties by doc_id."""
    terms = written(item_terms(items), "terms")
    total = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0]
    blocks = max(1, -(-(total or 0) // term_bytes))
    found = None
    for b in range(blocks):
        part = _search(docs, terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k, owners)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
