"""Benchmark decontamination by BM25 with block-max WAND (operator 3).

Test items are the indexed side: each is one unit, or several of at most ``UNIT_WORDS`` words, with postings of BM25
impacts divided by the unit's score against itself. Units of one length class (lengths up to the same power of two) have
an index of their own. Every training passage, two neighbouring spans of a document of the class's length, overlapping by
one span, is a query; so a unit copied in one piece lies whole in some passage, and which passages a unit meets depends
on its own length only.
Units lie in blocks of ``BLOCK`` with an index of (term, block) maxima. The search is block-max WAND with a fixed threshold, for
all passages of about a megabyte of text at once: a passage's terms are ordered by their greatest impact, and the pivot is the
first at which the sum of these reaches the threshold. Passages without pivot are skipped whole, blocks without a term from the
pivot on are never opened. An opened block goes on if its maxima of these terms and the greatest impacts of the earlier ones
reach the threshold; then the earlier terms' own maxima are put in step by step, and only a block that stays above it is
scored exactly, with the distinct terms of the passage. All units at or above ``SCORE`` are retrieved and then verified: of the
word triples of the unit's question (its first half) and of its answer (the rest) at least ``OVERLAP`` each must occur in the
passage. A unit of fewer than six words must occur whole.

Statistics are taken over all items. The index goes to the tasks in shards of bounded size, one after the other.

Words end at ASCII punctuation and are lower-cased. Null and empty texts match nothing, items without words are ignored;
repeated items and documents give repeated findings; an empty table on either side gives no finding. Other columns are
ignored by ``find`` and carried along by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skylag.llm.tables import written
from skylag.llm.words import batch_words, grams, sliced

UNIT_WORDS, BLOCK = 256, 4
SCORE, OVERLAP = 0.5, 0.5
K1, B = 1.2, 0.75
#: Words of all units in one broadcast shard, at most about (some 40 bytes each in the index).
SHARD_WORDS = 500_000
#: Postings of blocks that are open at once; what rounding may take from a bound.
CELLS, SLACK = 1 << 20, 1e-6
_UNIT = "item_id bigint, words array<bigint>"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items to units: the hashes of their words in order."""
    for batch in sliced(batches, "text"):
        ids, out = batch.column("item_id").to_pylist(), []
        for first, places, words in batch_words(batch.column("text"), lower=True, loose=True):
            for item, a, b in zip(ids[first:], places, places[1:]):
                parts = -(-(b - a) // UNIT_WORDS)
                edges = np.linspace(a, b, parts + 1).astype(int) if parts else []
                out += [(item, words[s:e].view(np.int64).tolist()) for s, e in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                          pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["item_id", "words"])


@dataclass
class Index:
    """One shard: postings by term and, over them, maxima by term and block."""
    items: list[int | None]
    terms: np.ndarray  # sorted hashes
    at: np.ndarray  # first posting of each term, and the end
    unit: np.ndarray  # postings: unit, impact
    impact: np.ndarray
    block_at: np.ndarray  # the same for (block, maximum)
    block: np.ndarray
    block_most: np.ndarray
    block_key: np.ndarray  # term * blocks + block of each, ascending
    blocks: int
    term_most: np.ndarray  # greatest impact of each term
    question: list[np.ndarray]
    answer: list[np.ndarray]
    size: list[int]  # words per triple, 3 or the whole of a short unit
    least: list[float]  # share of triples that must occur
    span: int
    sieve: np.ndarray

    def find(self, words: np.ndarray, spans: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """Verified (span, unit, score, question overlap, answer overlap); ``spans`` are the starts, of one document, and the end."""
        near = np.flatnonzero(self.sieve[(words & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(near):
            return
        place = np.minimum(np.searchsorted(self.terms, words[near]), len(self.terms) - 1)
        hit = self.terms[place] == words[near]
        near, place = near[hit], place[hit]
        owner = np.searchsorted(spans, near, side="right") - 1
        owner, term = np.divmod(np.unique(owner * len(self.terms) + place), len(self.terms))
        n_passages = max(1, len(spans) - 2)
        # Passages whose terms cannot reach the threshold together have no pivot and end here.
        most = np.bincount(owner, self.term_most[term], n_passages + 1)
        live = most[:-1] + most[1:] >= SCORE - SLACK
        low, high = np.maximum(owner - 1, 0), np.minimum(owner, n_passages - 1)
        passage, term = np.divmod(np.unique(np.concatenate(
            [low[live[low]] * len(self.terms) + term[live[low]], high[live[high]] * len(self.terms) + term[live[high]]])), len(self.terms))
        edges = np.searchsorted(passage, np.arange(n_passages + 1))
        for k, b in self._candidates(passage, term, n_passages):
            yield from self._verified(words[spans[k]:spans[min(k + 2, len(spans) - 1)]], term[edges[k]:edges[k + 1]], k, b)

    def _candidates(self, passage: np.ndarray, term: np.ndarray, n_passages: int) -> Iterator[tuple[int, int]]:
        """(passage, block) whose block maxima reach the threshold; ``passage`` ascends, its terms are distinct."""
        top = self.term_most[term]
        order = np.lexsort((top, passage))
        passage, term, top = passage[order], term[order], top[order]
        start = np.searchsorted(passage, np.arange(n_passages + 1))
        total = np.concatenate([[0.0], np.cumsum(top)])
        # From its pivot on, a passage's terms open blocks; a unit with earlier terms only stays below the threshold.
        opens = total[1:] - total[start[passage]] >= SCORE - SLACK
        pivot = start[1:] - np.bincount(passage[opens], minlength=n_passages)
        before = total[pivot] - total[start[:-1]]
        sizes = np.where(opens, self.block_at[term + 1] - self.block_at[term], 0)
        part = np.bincount(passage, sizes, n_passages).cumsum().astype(np.int64) // CELLS
        for k in np.unique(part[passage[opens]]):
            mine = np.flatnonzero(opens & (part[passage] == k))
            entries = _ranges(self.block_at[term[mine]], sizes[mine])
            cells, of = np.unique(np.repeat(passage[mine], sizes[mine]) * self.blocks + self.block[entries], return_inverse=True)
            bound = np.bincount(of, self.block_most[entries])
            # Blocks that even the greatest impacts of the earlier terms do not lift are skipped without a look at these.
            open_ = bound + before[cells // self.blocks] >= SCORE - SLACK
            cells, bound = cells[open_], bound[open_]
            step = max(1, CELLS // max(1, int((pivot - start[:-1]).max())))
            for at in range(0, len(cells), step):
                p, b = np.divmod(cells[at:at + step], self.blocks)
                reached, last, width = bound[at:at + step], pivot[p], 1
                while len(p) and (last > start[p]).any():
                    first = np.maximum(start[p], last - width)
                    keys = term[_ranges(first, last - first)] * self.blocks + np.repeat(b, last - first)
                    place = np.minimum(np.searchsorted(self.block_key, keys), len(self.block_key) - 1)
                    there = np.where(self.block_key[place] == keys, self.block_most[place], 0)
                    reached = reached + np.bincount(np.repeat(np.arange(len(p)), last - first), there, len(p))
                    stay = reached + total[first] - total[start[p]] >= SCORE - SLACK
                    p, b, reached, last, width = p[stay], b[stay], reached[stay], first[stay], 2 * width
                yield from zip(p.tolist(), b.tolist())

    def _verified(self, passage, seen, k, b):
        postings = _ranges(self.at[seen], self.at[seen + 1] - self.at[seen])
        unit = self.unit[postings]
        inside = unit // BLOCK == b
        score = np.bincount(unit[inside] - b * BLOCK, self.impact[postings[inside]], BLOCK)
        for u in np.flatnonzero(score >= SCORE):
            at = b * BLOCK + int(u)
            there = grams(passage, self.size[at])
            q, a = (float(np.isin(g, there).mean()) for g in (self.question[at], self.answer[at]))
            if min(q, a) >= self.least[at]:
                yield k, at, float(min(1.0, score[u])), q, a


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def length_class(n: int) -> int:
    """The least power of two that is not below a number of words."""
    return 1 << (n - 1).bit_length()


def build_index(units: list[tuple[int | None, np.ndarray]], df: dict[int, int], n_units: int, mean_words: float) -> Index:
    """Index of some units of one shard from the statistics of all. Passages are as long as the largest length class needs."""
    terms = np.unique(np.concatenate([w for _, w in units]))
    rare = np.array([df[int(t)] for t in terms.view(np.int64)])
    idf = np.log1p((n_units - rare + 0.5) / (rare + 0.5))
    t_of, u_of, w_of, question, answer, size, least = [], [], [], [], [], [], []
    # Units that share words lie together, so that a block's maxima stay close to its members.
    units = sorted(units, key=lambda u: (int(u[1].min()), -1 if u[0] is None else u[0]))
    for u, (_, words) in enumerate(units):
        own, tf = np.unique(words, return_counts=True)
        place = np.searchsorted(terms, own)
        impact = idf[place] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
        t_of.append(place), u_of.append(np.full(len(own), u)), w_of.append(impact / impact.sum())
        long = len(words) >= 6
        n, half = (3, len(words) // 2) if long else (len(words), 0)
        question.append(np.unique(grams(words[:half] if long else words, n)))
        answer.append(np.unique(grams(words[half:], n)))
        size.append(n), least.append(OVERLAP if long else 1.0)
    t, u, w = map(np.concatenate, (t_of, u_of, w_of))
    order = np.lexsort((u, t))
    t, u, w = t[order], u[order], w[order]
    blocks = len(units) // BLOCK + 1
    key = t * blocks + u // BLOCK
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    edges = np.arange(len(terms) + 1)
    at = np.searchsorted(t, edges)
    sieve = np.zeros(1 << 20, bool)
    sieve[(terms & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return Index([i for i, _ in units], terms, at, u, w, np.searchsorted(t[first], edges), u[first] // BLOCK,
                 np.maximum.reduceat(w, first), key[first], blocks, np.maximum.reduceat(w, at[:-1]), question, answer, size, least, max(length_class(len(w)) for _, w in units), sieve)


def indexes(items: DataFrame, shard_words: int = SHARD_WORDS) -> list[list[Index]]:
    """Shards over ``items`` (item_id, text), each an index per length class. Statistics come from all items; a shard's rows are bounded."""
    units = written(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(_units, _UNIT)
                    .withColumn("key", F.xxhash64("item_id", "words")), "units")
    n, words = units.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    if not n:
        return []
    df = units.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").count()
    shards = -(-words // shard_words)
    out = []
    for k in range(shards):
        mine = units.filter(F.pmod(F.col("key"), F.lit(shards)) == k)
        rows = mine.select("item_id", "words").collect()
        if rows:
            theirs = df.join(mine.select(F.explode("words").alias("term")).distinct(), "term", "left_semi").collect()
            counts = {r["term"]: r["count"] for r in theirs}
            classes: dict[int, list] = {}
            for r in rows:
                classes.setdefault(length_class(len(r["words"])), []).append((r["item_id"], np.array(r["words"], np.int64).view(np.uint64)))
            out.append([build_index(units_of, counts, n, words / n) for _, units_of in sorted(classes.items())])
    return out


def _found(shard: list[Index], batch: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    """Row of the batch and its findings by item: (score, question, answer), the best passage each."""
    for first, places, words in batch_words(batch.column("text"), lower=True, loose=True):
        found: dict[int, dict] = {}
        for index in shard:
            _found_by(index, places, words, found)
        for row in sorted(found):
            yield first + row, found[row]


def _found_by(index: Index, places, words: np.ndarray, found: dict[int, dict]) -> None:
    starts, owners = [], []
    for row, (a, b) in enumerate(zip(places, places[1:])):
        n = -(-(b - a) // index.span)
        starts.append(a + np.arange(n) * index.span), owners.append(np.full(n, row))
    owner = np.concatenate(owners) if owners else np.empty(0, int)
    if not len(owner):
        return
    spans = np.append(np.concatenate(starts), len(words))
    # A passage may reach into the next document of the group; each document is looked at again by itself.
    rows = {int(owner[j]) for k, *_ in index.find(words, spans) for j in (k, min(k + 1, len(owner) - 1))}
    for row in rows:
        mine = words[places[row]:places[row + 1]]
        own = np.append(np.arange(-(-len(mine) // index.span)) * index.span, len(mine))
        for _, unit, *values in index.find(mine, own):
            best, item = found.setdefault(row, {}), index.items[unit]
            best[item] = max(best.get(item, (0.0,)), tuple(values))


def find(docs: DataFrame, shards: list[list[Index]]) -> DataFrame:
    """Documents that hold test items: doc_id, item_id, score, question_overlap, answer_overlap."""
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    # Equal rows have equal findings; what tells other rows with the same doc_id apart is needed between shards only.
    key = F.sha2("text", 256) if len(shards) > 1 else F.lit("")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", key.alias("key"))

    def search(shard: list[Index]):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                ids, keys = batch.column("doc_id"), batch.column("key")
                rows = [(ids[row].as_py(), item, *values, keys[row].as_py()) for row, found in _found(shared.value, batch)
                        for item, values in sorted(found.items(), key=lambda x: (x[0] is None, x[0]))]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)],
                                                 names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "key"])
        return texts.mapInArrow(run, schema + ", key string")

    found = [search(shard) for shard in shards]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    if len(found) == 1:
        return found[0].drop("key")
    both = found[0].withColumn("shard", F.lit(0))
    for k, more in enumerate(found[1:], 1):
        both = both.union(more.withColumn("shard", F.lit(k)))
    # An item cut into units may lie in several shards: its best passage, once for each of the equal rows.
    best = both.groupBy("doc_id", "key", "item_id").agg(
        F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best"),
        (F.count(F.lit(1)) / F.size(F.collect_set("shard"))).cast("int").alias("copies"))
    return (best.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
            .select("doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap"))


def remove(docs: DataFrame, shards: list[list[Index]]) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns; one pass over the texts for each shard."""
    for shard in shards:
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in _found(shared.value, batch)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
