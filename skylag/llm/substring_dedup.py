"""Removal of repeated word windows with sharded Aho-Corasick automata (operator 5).

A window is ``WINDOW`` consecutive words of one document. Every word covered by a window whose words also start
earlier (smaller doc_id, or earlier in the same document) is removed; windows are judged on the input.

1. Anchors. The anchor of a window is the smallest hash among its runs of ``ANCHOR`` words, so equal windows have
   equal anchors. Neighbouring windows mostly share one; such a run of windows is dealt by its anchor, and only runs whose
   anchor occurs again can hold repeated windows.
2. Confirmation. The words of these runs are dealt into shards by anchor. Anchors of more than ``HOT_RUNS`` runs are
   salted: their windows are dealt one by one by a hash of all their words, as a window needs to meet equal ones only. A
   shard counts the windows of its runs; those that occur again are the recurring passages.
3. Location. Each shard compiles an Aho-Corasick automaton of its recurring passages over words and streams all its
   runs through it. Every occurrence but the first is marked.
4. Marked windows are gathered by document and their words cut out of the whole text.

Before every shuffle a task settles what it can by itself: of runs with equal words only the earliest is sent on, the
others are marked at once. A passage that a third of all documents share is thus one row per task, not one task's burden.
Hashes only route; equality is that of the words.

Null and empty texts have no words. Rows without doc_id keep all words. Rows that share a doc_id stand at the same place in
the order, so a row does not repeat its own copy, but a window at an earlier place of one counts for the other; each loses
only words of its own: a mark carries a digest of the words it is for and passes over rows that have others there, and
runs are taken from a row only if its words have their anchor. An empty table gives an empty result. Extra columns are
ignored by ``marked`` and carried along by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skylag.llm.tables import free_name, written
from skylag.llm.words import batch_words, grams, mix, sliced, text_bytes, text_words

WINDOW, ANCHOR = 20, 8
#: More than the windows of one run (WINDOW - ANCHOR + 1 at most); runs that a shard and a bucket hold, which bound a
#: task's memory.
RUN, SHARD_RUNS, BUCKET_RUNS = 32, 8_000, 1 << 19
#: Runs of one anchor above which its windows are dealt one by one; such anchors are broadcast up to this number.
HOT_RUNS, HOT_ANCHORS = 4_000, 1 << 17
#: Distinct words of a shard that have a character of their own, those above the surrogates.
LETTERS = 0x110000 - 0xE000
#: What a task pools before it settles and sends: runs, bytes of words.
POOL_RUNS, POOL_BYTES = 1 << 20, 24 << 20
#: Bytes of marks up to which they are broadcast to the scan of the texts; above, the texts are shuffled to them.
BROADCAST_BYTES = 16 << 20


def window_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each run in a document."""
    parts = grams(words, ANCHOR)
    low, wide, span = parts, 1, WINDOW - ANCHOR + 1
    if len(low) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    while 2 * wide <= span:
        low, wide = np.minimum(low[:-wide], low[wide:]), 2 * wide
    if wide < span:
        low = np.minimum(low[:-(span - wide)], low[span - wide:])
    # A run also ends where its anchor leaves the window and an equal one stays, so that the anchor counts twice.
    fresh = (low[1:] != low[:-1]) | (parts[:len(low) - 1] == low[:-1])
    start = np.flatnonzero(np.concatenate([[True], fresh]))
    return low[start], start, np.diff(np.append(start, len(low)))


def _anchors(buckets: int):
    """Texts to runs by bucket: (bucket, anchors, docs, at, known); anchors is null for runs that are known to recur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[tuple] = []

        def flush():
            a, d, p = map(np.concatenate, zip(*pool))
            pool.clear()
            order = np.lexsort((p, d, a))
            a, d, p = a[order], d[order], p[order]
            first = np.concatenate([[True], a[1:] != a[:-1]])
            group = np.cumsum(first) - 1
            again = (np.bincount(group) > 1)[group]
            # One run per anchor goes on, to tell the others; what recurs here is known already.
            bucket = (mix(a[first]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            places = np.flatnonzero(first)[order]
            parts = [places[s:e] for s, e in zip(edges, edges[1:])]
            numbers = [int(bucket[order[s]]) for s in edges[:-1]]
            rows = [(n, a[x].tobytes(), d[x].tobytes(), p[x].tobytes(), again[x].tobytes()) for n, x in zip(numbers, parts)]
            there = np.flatnonzero(again)
            for at in range(0, len(there), 4096):
                x = there[at:at + 4096]
                rows.append((int((a[x[0]] ^ np.uint64(at)) % np.uint64(buckets)), a[x].tobytes(), d[x].tobytes(), p[x].tobytes(), None))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))],
                                              names=["bucket", "anchors", "docs", "at", "known"])

        waiting = 0
        for batch in sliced(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            for first, places, words in batch_words(batch.column("text")):
                for doc, s, e in zip(ids[first:], places, places[1:]):
                    if doc is None or e - s < WINDOW:
                        continue
                    anchors, starts, sizes = window_runs(words[s:e])
                    pool.append((anchors, np.full(len(anchors), doc, np.int64), starts * RUN + sizes - 1))
                    waiting += len(anchors)
                if waiting >= POOL_RUNS:
                    yield flush()
                    waiting = 0
        if pool:
            yield flush()
    return run


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets to runs (doc, at, anchor) whose anchor occurs again."""
    waiting: list[tuple] = []
    current = None

    def out(a, d, p):
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int64()), pa.array(a.view(np.int64), pa.int64())],
                                          names=["doc", "at", "anchor"])

    def bucket():
        a, d, p = (np.concatenate([np.frombuffer(r[k], t) for r in waiting]) for k, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
        known = np.concatenate([np.frombuffer(r[3], bool) for r in waiting])
        waiting.clear()
        order = np.argsort(a, kind="stable")
        a, d, p, known = a[order], d[order], p[order], known[order]
        group = np.cumsum(np.concatenate([[True], a[1:] != a[:-1]])) - 1
        recurs = ((np.bincount(group) > 1) | (np.bincount(group, known) > 0))[group] & ~known
        return out(a[recurs], d[recurs], p[recurs])

    for batch in batches:
        for b, *row in zip(*(batch.column(n).to_pylist() for n in ("bucket", "anchors", "docs", "at", "known"))):
            if row[3] is None:
                yield out(*(np.frombuffer(row[k], t) for k, t in ((0, np.uint64), (1, np.int64), (2, np.int64))))
                continue
            if b != current and waiting:
                yield bucket()
            current = b
            waiting.append(tuple(row))
    if waiting:
        yield bucket()


def _mark(words: bytes) -> int:
    """What tells the words of a mark from those that another row with this doc_id has there."""
    return int.from_bytes(hashlib.blake2b(words, digest_size=8, person=b"mark").digest(), "little", signed=True)


def _has_anchor(words: bytes, anchor: int) -> bool:
    """Whether the first window of a run's words has the anchor it was dealt by."""
    parts = grams(text_words(np.frombuffer(words, np.uint8)), ANCHOR)[:WINDOW - ANCHOR + 1]
    return len(parts) > 0 and int(parts.min().view(np.int64)) == anchor


def _deal(window: bytes, level: int = 0) -> int:
    """A number from all words of a window; another one at each level."""
    return int.from_bytes(hashlib.blake2b(window, digest_size=8, salt=level.to_bytes(2, "little")).digest(), "little")


def _segments(shards: int):
    """Documents with their recurring runs to shards: (shard, words, docs, starts, sizes, digests).

    ``words`` holds the runs' words, a line each; it is null in rows of marks (runs whose words this task saw earlier), which
    alone have digests.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple] = {}
        marks: list[tuple] = []
        held = 0

        def flush():
            by_shard: dict[int, list] = {}
            windows: dict[bytes, tuple] = {}
            for text, (doc, start, size, shard) in first.items():
                if shard is not None:
                    by_shard.setdefault(shard, []).append((text, doc, start, size))
                    continue
                words = text.split(b" ")
                for j in range(size):
                    window = b" ".join(words[j:j + WINDOW])
                    seen = windows.get(window)
                    if seen is None or (doc, start + j) < seen:
                        windows[window] = (doc, start + j)
                    if seen is not None and (doc, start + j) != seen:
                        marks.append((*max(seen, (doc, start + j)), 1, _mark(window)))
            for window, (doc, start) in windows.items():
                by_shard.setdefault(_deal(window) % shards, []).append((window, doc, start, 1))
            windows.clear()
            rows = [(shard, b"\n".join(x[0] for x in runs), *(np.array([x[k] for x in runs], np.int64).tobytes() for k in (1, 2, 3)), None)
                    for shard, runs in by_shard.items()]
            for at in range(0, len(marks), 4096):
                part = np.array(marks[at:at + 4096], np.int64)
                rows.append((int(part[0, :3].sum() + at) % shards, None, *(np.ascontiguousarray(part[:, k]).tobytes() for k in range(4))))
            first.clear(), marks.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))],
                                              names=["shard", "words", "docs", "starts", "sizes", "digests"])

        for batch in sliced(batches, "text"):
            runs = batch.column("runs")
            for row, (doc, data) in enumerate(zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")))):
                words = data.tobytes().split()
                for r in runs[row].as_py():
                    start, size = divmod(r["at"], RUN)
                    size += 1
                    if start + size + WINDOW - 1 > len(words):  # of another row with this doc_id
                        continue
                    text = b" ".join(words[start:start + size + WINDOW - 1])
                    if r.get("again") and not _has_anchor(text, r["anchor"]):
                        continue
                    seen = first.get(text)
                    if seen is None:
                        first[text] = (doc, start, size, None if r["hot"] else r["anchor"] % shards)
                        held += (len(text) + 200) * (1 + size if r["hot"] else 1)
                    elif (doc, start) < seen[:2]:
                        marks.append((*seen[:3], _mark(text)))
                        first[text] = (doc, start, size, seen[3])
                    elif (doc, start) != seen[:2]:
                        marks.append((doc, start, size, _mark(text)))
            if held + 100 * len(marks) > POOL_BYTES:
                yield flush()
                held = 0
        if first or marks:
            yield flush()
    return run


def automaton(passages) -> ahocorasick.Automaton:
    """Aho-Corasick automaton over words, each written as one character."""
    trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, passage in enumerate(passages):
        trie.add_word(passage, k)
    trie.make_automaton()
    return trie


def repeated_windows(runs: list[tuple[bytes, int, int]], level: int = 1) -> Iterator[tuple[int, int, int]]:
    """Of runs (words, doc, start) in one shard: marks (doc, start, windows) of windows that also start earlier."""
    for doc, start, size, _ in _repeats(runs, level):
        yield doc, start, size


def _repeats(runs: list[tuple[bytes, int, int]], level: int = 1) -> Iterator[tuple[int, int, int, bytes]]:
    """The marks of a shard's runs with the words that each covers.

    If the runs have more distinct words than there are characters, their windows are dealt to two halves.
    """
    letters: dict[bytes, str] = {}
    coded = []
    for text, doc, start in runs:
        word_codes = []
        for w in text.split(b" "):
            if (c := letters.get(w)) is None:
                if len(letters) == LETTERS:
                    del coded, letters
                    halves: tuple[list, list] = [], []
                    for other, d, at in runs:
                        words = other.split(b" ")
                        for j in range(len(words) - WINDOW + 1):
                            window = b" ".join(words[j:j + WINDOW])
                            halves[_deal(window, level) & 1].append((window, d, at + j))
                    for half in halves:
                        yield from _repeats(half, level + 1)
                    return
                c = letters[w] = chr(0xE000 + len(letters))
            word_codes.append(c)
        coded.append(("".join(word_codes), doc, start))
    counts = Counter(s[j:j + WINDOW] for s, _, _ in coded for j in range(len(s) - WINDOW + 1))
    passages = [w for w, n in counts.items() if n > 1]
    del counts
    if not passages:
        return
    trie = automaton(passages)
    first: list[tuple] = [(1 << 63, 0)] * len(passages)
    places = []
    for s, doc, start in coded:
        found = [(end + 1 - WINDOW, k) for end, k in trie.iter(s)]
        places.append(found)
        for j, k in found:
            if (doc, start + j) < first[k]:
                first[k] = (doc, start + j)
    for (text, _, _), (_, doc, start), found in zip(runs, coded, places):
        words = text.split(b" ") if found else []
        open_at = size = 0
        for j, k in found:
            if first[k] == (doc, start + j):
                continue
            if size and j == open_at + size:
                size += 1
                continue
            if size:
                yield doc, start + open_at, size, b" ".join(words[open_at:open_at + size + WINDOW - 1])
            open_at, size = j, 1
        if size:
            yield doc, start + open_at, size, b" ".join(words[open_at:open_at + size + WINDOW - 1])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards to marks (doc, start, windows, digest)."""
    waiting: dict[tuple, None] = {}  # in order of arrival
    current = None

    def out(*columns):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc", "start", "windows", "digest"])

    def shard():
        rows = [(doc, start, size, _mark(words)) for doc, start, size, words in _repeats(list(waiting))]
        waiting.clear()
        return out(*zip(*rows)) if rows else None

    for batch in batches:
        for b, words, *numbers in zip(*(batch.column(n).to_pylist() for n in ("shard", "words", "docs", "starts", "sizes", "digests"))):
            docs, starts, sizes, *digests = (np.frombuffer(x, np.int64) for x in numbers if x is not None)
            if words is None:
                yield out(docs, starts, sizes, *digests)
                continue
            if b != current and waiting and (rows := shard()) is not None:
                yield rows
            current = b
            waiting.update(dict.fromkeys(zip(words.split(b"\n"), docs.tolist(), starts.tolist())))
    if waiting and (rows := shard()) is not None:
        yield rows


def marked(docs: DataFrame) -> DataFrame:
    """Written table of marks (doc, marks array of (start, windows, digest)): windows that also start earlier, by document."""
    conf = docs.sparkSession.conf
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    partitions = int(conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # A run per seven words of six bytes, about.
    buckets = max(4 * partitions, size // 42 // BUCKET_RUNS)
    runs = written(texts.mapInArrow(_anchors(buckets), "bucket int, anchors binary, docs binary, at binary, known binary")
                   .repartition("bucket").sortWithinPartitions("bucket")
                   .mapInArrow(_recurring, "doc bigint, at bigint, anchor bigint"), "runs")
    hot = written(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("at") % RUN + 1).alias("n_windows"))
                  .filter(F.col("n") > HOT_RUNS), "hot")
    n_hot, hot_runs, hot_windows = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_windows"), F.lit(0))).first()
    shards = max(4 * partitions, (runs.count() - hot_runs + hot_windows) // SHARD_RUNS)
    named = hot.select("anchor", F.lit(True).alias("hot"))
    # Ids of several rows; these have to be told apart by their words.
    repeated = written(texts.groupBy(F.col("doc_id").alias("doc")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
                       .select("doc", F.lit(True).alias("again")), "repeated")
    told = (runs.join(F.broadcast(named) if n_hot <= HOT_ANCHORS else named, "anchor", "left").join(repeated, "doc", "left")
            .groupBy("doc").agg(F.collect_set(F.struct("at", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"),
                                                       F.coalesce("again", F.lit(False)).alias("again"))).alias("runs")))
    with_runs = texts.join(told.hint("shuffle_hash"), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "runs")
    return written(with_runs.mapInArrow(_segments(shards), "shard int, words binary, docs binary, starts binary, sizes binary, digests binary")
                   .repartition("shard").sortWithinPartitions("shard")
                   .mapInArrow(_marks, "doc bigint, start bigint, windows bigint, digest bigint")
                   .groupBy("doc").agg(F.collect_set(F.struct("start", "windows", "digest")).alias("marks")), "marks")


def covered(n_words: int, marks) -> np.ndarray:
    """Which words the marked windows cover."""
    change = np.zeros(n_words + 1, np.int64)
    for m in marks or ():
        start, end = m["start"], m["start"] + m["windows"] + WINDOW - 1
        if end <= n_words:
            change[start] += 1
            change[end] -= 1
    return np.cumsum(change[:-1]) > 0


def _own(words: list[bytes], marks) -> list:
    """The marks whose words this row has at their place."""
    return [m for m in marks or () if m["start"] + m["windows"] + WINDOW - 1 <= len(words)
            and _mark(b" ".join(words[m["start"]:m["start"] + m["windows"] + WINDOW - 1])) == m["digest"]]


def _with_marks(docs: DataFrame) -> DataFrame:
    """``docs`` with their marks as one more column, the last."""
    marks = marked(docs)
    size = marks.agg(F.coalesce(F.sum(F.size("marks") * 24 + 40), F.lit(0))).first()[0]
    doc, more = free_name(docs, "_marked_doc"), free_name(docs, "_marks")
    named = marks.select(F.col("doc").alias(doc), F.col("marks").alias(more))
    named = F.broadcast(named) if size <= BROADCAST_BYTES else named
    return docs.join(named, F.col("doc_id").cast("bigint") == F.col(doc), "left").drop(doc)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its words, those removed, and the text of the others."""
    for batch in sliced(batches, "text"):
        marks = batch.columns[-1]
        total, removed, digest = [], [], []
        for row, data in enumerate(text_bytes(batch.column("text"))):
            words = data.tobytes().split()
            gone = covered(len(words), _own(words, marks[row].as_py()))
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
            total.append(len(words)), removed.append(int(gone.sum()))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def summary(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _with_marks(texts).mapInArrow(_kept, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words cut out; texts that lose nothing stay as they are, null included."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            marks, texts = batch.columns[-1], batch.column("text").to_pylist()
            for row, text in enumerate(texts):
                if text and (found := marks[row].as_py()):
                    words = text.encode().split()
                    gone = covered(len(words), _own(words, found))
                    if gone.any():
                        texts[row] = b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode()
            new = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([new if n == "text" else batch.column(k) for k, n in enumerate(names)], names=names)

    return _with_marks(docs).mapInArrow(run, docs.schema)
