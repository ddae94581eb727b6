"""SentencePiece encoding and decoding with a max-plus scan over giant documents (operator 1).

The model is a SentencePiece BPE vocabulary with byte fallback. Its encoding of a string is the one path through the lattice
of vocabulary pieces on which every two neighbouring pieces stay apart when they are encoded together, so an encoding
can be written as a max-plus product: a step has weight 0 if the two pieces may stand together and minus
infinity if not. No piece reaches over the beginning of a run of spaces or a line end; there the text falls into words that
are encoded by themselves, each distinct word once.

Documents of more than ``CHUNK`` characters are split into chunks that are spread over all tasks. The states at a
border are the pieces that may cover the last character before it; a chunk gives the matrix of weights from its
entry states to its exit states. Matrices are combined associatively, first in blocks of ``BLOCK`` chunks, then over the
blocks of a document; the vectors that come back name the one state at every border, and each chunk finds its own
pieces by tracing back between its two states. Chunks are spread for their matrices, which is the long part; their borders, two
numbers each, then go back to the document, whose row takes all ids anyway. A giant's text is written once and moved twice.

The vocabulary is read on the driver from ``path`` and broadcast (32,000 pieces). Null texts have null ids, empty texts
none; repeated rows repeat their ids; an empty table gives an empty result; the new column ``ids`` replaces one of that name,
other columns are carried along. In decoded text the character U+2581 is a space, as in SentencePiece itself.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skylag.llm.tables import free_name, written
from skylag.llm.words import sliced

PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CHUNK, BLOCK = 16_384, 64
#: Distinct words whose ids a worker remembers; it starts afresh beyond.
REMEMBERED = 400_000
#: Words that are joined step by step together, and the mark of a place without a symbol.
TOGETHER, ABSENT = 8_000, -(1 << 30)
_WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|[^{SPACE}\n]+")
_FREE = re.compile(f"(?<=[^{SPACE}])(?={SPACE})|(?=\n)")  # where one word ends and the next begins


@dataclass
class Vocabulary:
    """Pieces of a model and what follows from them."""
    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray  # pieces that text can be made of
    byte_ids: np.ndarray  # id of each byte's piece
    number: dict[str, int] = field(default_factory=dict)
    longest: int = 1

    def __post_init__(self):
        self.number = {p: k for k, (p, ok) in enumerate(zip(self.pieces, self.normal)) if ok}
        self.longest = max(map(len, self.number))
        # Every way to join two pieces to one, as sorted keys.
        joins = sorted((a * len(self.pieces) + b, k) for p, k in self.number.items() for cut in range(1, len(p))
                       if (a := self.number.get(p[:cut])) is not None and (b := self.number.get(p[cut:])) is not None)
        self.join_keys = np.array([k for k, _ in joins] or [-1], np.int64)
        self.join_ids = np.array([i for _, i in joins] or [-1], np.int64)
        self.memory: dict[str, bytes] = {}  # words after one space, or from a line end on
        self.other: dict[str, bytes] = {}  # words with any other beginning
        self.apart: dict[tuple[str, str], bool] = {}
        # A character is its piece, or minus its code point less one.
        self.symbols = -1 - np.arange(sys.maxunicode + 1, dtype=np.int32)
        for p, k in self.number.items():
            if len(p) == 1:
                self.symbols[ord(p)] = k
        self.texts = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for byte, k in enumerate(self.byte_ids):
            self.texts[k] = bytes([byte])

    def __reduce__(self):  # derived tables are built where they are used
        return Vocabulary, (self.pieces, self.scores, self.normal, self.byte_ids)

    # Byte-pair encoding --------------------------------------------------------------

    def _bytes(self, symbols) -> bytes:
        out = []
        for s in symbols:
            out += [s] if s >= 0 else self.byte_ids[list(chr(-s - 1).encode())].tolist()
        return np.array(out, np.int32).tobytes()

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = left.astype(np.int64) * len(self.pieces) + right
        place = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        return np.where((self.join_keys[place] == key) & (left >= 0) & (right >= 0), self.join_ids[place], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of normalised words, as int32 bytes. Short words of like length are joined step by step together."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        for low, high in ((1, 6), (7, 10), (11, 16), (17, 32)):
            rows = np.flatnonzero((lengths >= low) & (lengths <= high))
            for at in range(0, len(rows), TOGETHER):
                some = rows[at:at + TOGETHER]
                for k, ids in zip(some.tolist(), self._together([words[k] for k in some.tolist()], lengths[some], high)):
                    out[k] = ids
        for k in np.flatnonzero(lengths > 32):
            out[k] = self._bytes([self.number.get(p, -ord(p[0]) - 1) for p in self.split(words[k])])
        return out

    def _together(self, words: list[str], lengths: np.ndarray, width: int) -> list[bytes]:
        """One join per word and step, the first of the best. Joined symbols leave a gap that the places of the next ones pass over.

        Each word has one place more than it can fill, so that places before its first and after its last are empty.
        """
        shape = (len(words), width + 1)
        symbols = np.full(shape, ABSENT, np.int32)
        symbols[np.arange(width + 1) < lengths[:, None]] = self.symbols[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        symbols = symbols.ravel()
        joined = np.append(self._joined(symbols[:-1], symbols[1:]), -1)
        score = np.where(joined >= 0, self.scores[joined], -np.inf)
        after = np.minimum(np.arange(1, len(symbols) + 1), len(symbols) - 1)
        before = np.arange(-1, len(symbols) - 1)
        rows = np.arange(len(words))
        while len(rows):
            open_ = score.reshape(shape)[rows]
            best = open_.argmax(axis=1)
            ok = open_[np.arange(len(rows)), best] > -np.inf
            rows = rows[ok]
            place = rows * (width + 1) + best[ok]
            gap = after[place]
            symbols[place], symbols[gap], score[gap] = joined[place], ABSENT, -np.inf
            after[place] = after[gap]
            before[after[place]] = place
            for left in (place, before[place]):
                joined[left] = found = self._joined(symbols[left], symbols[after[left]])
                score[left] = np.where(found >= 0, self.scores[found], -np.inf)
        symbols = symbols.reshape(shape)
        used = symbols != ABSENT
        flat, ends = symbols[used], used.sum(axis=1).cumsum()
        data, unknown = flat.tobytes(), ((symbols < 0) & used).any(axis=1)
        places = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        return [self._bytes(flat[a:b].tolist()) if odd else data[4 * a:4 * b] for (a, b), odd in zip(places, unknown.tolist())]

    def split(self, text: str) -> list[str]:
        """Pieces of one string of any length, by a queue of joins: best score first, then leftmost."""
        pieces = list(text)
        after, before = list(range(1, len(pieces) + 1)), list(range(-1, len(pieces) - 1))
        queue: list[tuple] = []

        def offer(a, b):
            if a >= 0 and b < len(pieces) and (k := self.number.get(pieces[a] + pieces[b])) is not None:
                # Both must be pieces themselves: an unknown character is in no piece.
                heapq.heappush(queue, (-self.scores[k], a, len(pieces[a]), len(pieces[b]), b))

        for k in range(len(pieces) - 1):
            offer(k, k + 1)
        while queue:
            _, a, size_a, size_b, b = heapq.heappop(queue)
            if len(pieces[a]) != size_a or len(pieces[b]) != size_b or after[a] != b:
                continue
            pieces[a], pieces[b] = pieces[a] + pieces[b], ""
            after[a] = after[b]
            if after[b] < len(pieces):
                before[after[b]] = a
            offer(before[a], a), offer(a, after[a])
        return [p for p in pieces if p]

    def ids_of(self, pieces: list[str]) -> bytes:
        return self._bytes([self.number.get(p, -ord(p[0]) - 1) for p in pieces])

    # Texts ----------------------------------------------------------------------------

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        if len(self.memory) + len(self.other) > REMEMBERED:
            self.memory.clear(), self.other.clear()
        split: list[tuple[dict, list[str]]] = []
        for text in texts:
            t = " " + text.replace(SPACE, " ") if text else ""
            if "  " in t or " \n" in t or t.endswith(" "):
                split.append((self.other, _WORD.findall(t.replace(" ", SPACE))))
            else:
                split.append((self.memory, t.replace("\n", " \n").split(" ")[1:]))
        found = [list(map(memory.get, words)) for memory, words in split]
        new: dict[int, set[str]] = {id(self.memory): set(), id(self.other): set()}
        late = [k for k, ids in enumerate(found) if None in ids]
        for k in late:
            memory, words = split[k]
            new[id(memory)].update(w for w, ids in zip(words, found[k]) if ids is None)
        self._learn(new[id(self.memory)], new[id(self.other)])
        for k in late:
            memory, words = split[k]
            found[k] = map(memory.__getitem__, words)
        return [np.frombuffer(b"".join(ids), np.int32) for ids in found]

    def _learn(self, plain: set[str], odd: set[str]) -> None:
        new = [w for w in plain if w not in self.memory]
        self.memory.update(zip(new, self.encode_words([w if w[:1] == "\n" else SPACE + w for w in new])))
        new = [w for w in odd if w not in self.other]
        self.other.update(zip(new, self.encode_words(new)))

    def decode(self, ids: np.ndarray, first: bool = True) -> str:
        """Text of ids; the space that was put before the text is taken off again."""
        data = b"".join(map(self.texts.__getitem__, ids.tolist()))
        return (data[1:] if first and data[:1] == b" " else data).decode("utf-8", "replace")

    # Lattice --------------------------------------------------------------------------

    def may_meet(self, a: str, b: str) -> bool:
        """Whether two neighbouring pieces stay as they are when encoded together."""
        if (known := self.apart.get((a, b))) is None:
            if len(self.apart) > REMEMBERED:
                self.apart.clear()
            known = self.apart[a, b] = self.split(a + b) == [a, b]
        return known

    def states(self, before: str, after: str) -> list[tuple[int, int]]:
        """Pieces that may cover the last character of ``before``: places relative to the border, in fixed order."""
        if not before:
            return [(0, 0)]
        text, border = before + after, len(before)
        return sorted((s - border, e - border) for s in range(max(0, border - self.longest), border)
                      for e in range(border, min(len(text), s + self.longest) + 1)
                      if e - s == 1 or text[s:e] in self.number)

    def reach(self, text: str, entries: list[tuple[int, int]], stop: int) -> dict[int, dict[int, int]]:
        """From entry pieces, all pieces on paths to those that cover the character before ``stop``.

        By end and start, with the entries (as bits) from which a path leads there. An empty entry is a fresh start.
        """
        found: dict[int, dict[int, int]] = defaultdict(dict)
        for k, (s, e) in enumerate(entries):
            found[e][s] = found[e].get(s, 0) | 1 << k
        for at in range(min(e for _, e in entries), stop):
            if at not in found:
                continue
            for end in range(at + 1, min(len(text), at + self.longest) + 1):
                piece = text[at:end]
                if end - at > 1 and piece not in self.number:
                    continue
                bits = 0
                for s, b in found[at].items():
                    if s == at or self.may_meet(text[s:at], piece):
                        bits |= b
                if bits:
                    found[end][at] = found[end].get(at, 0) | bits
        return found

    def trace(self, text: str, entry: tuple[int, int], leave: tuple[int, int]) -> list[tuple[int, int]]:
        """The pieces after ``entry`` up to ``leave``, both places in ``text``."""
        if entry == leave:
            return []
        found = self.reach(text, [entry], leave[0] + 1)
        path, (s, e) = [leave], leave
        while s != entry[1]:
            s, e = next((p, s) for p in found[s] if p == s or self.may_meet(text[p:s], text[s:e]))
            path.append((s, e))
        return path[::-1]


def load(path: str = PATH) -> Vocabulary:
    """Read a model file; only BPE models that leave text as it is and put one space before it are supported."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    data = Path(path).read_bytes()
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(data)
    rules = spec.normalizer_spec
    if not (spec.trainer_spec.model_type == 2 and spec.trainer_spec.byte_fallback and rules.add_dummy_prefix
            and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap):
        raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    every = range(model.get_piece_size())
    pieces = [model.id_to_piece(k) for k in every]
    normal = np.array([not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k)) for k in every])
    if any("\n" in p or SPACE in p.lstrip(SPACE) for p, ok in zip(pieces, normal) if ok):
        raise ValueError("pieces must not reach over spaces or line ends")
    return Vocabulary(pieces, np.array([model.get_score(k) for k in every]), normal,
                      np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]))


# Chunks ------------------------------------------------------------------------------

def split_text(text: str, margin: int, chunk: int = CHUNK) -> Iterator[tuple[str, str, str]]:
    """Chunks of the normalised text, each with what stands just before and after it."""
    text = SPACE + text.replace(" ", SPACE)
    for at in range(0, len(text), chunk):
        end = min(len(text), at + chunk)
        yield text[max(0, at - margin):at], text[at:end], text[end:end + margin]


def transfer(v: Vocabulary, before: str, core: str, after: str) -> np.ndarray:
    """Weights from entry to exit states of a chunk: 0 where a path leads, minus infinity elsewhere."""
    text, begin, stop = before + core + after, len(before), len(before) + len(core)
    entries = [(begin + s, begin + e) for s, e in v.states(before, core + after)]
    leaves = {(stop + s, stop + e): k for k, (s, e) in enumerate(v.states(before + core, after))}
    weights = np.full((len(entries), len(leaves)), -np.inf, np.float32)
    free = _first_and_last_free(text, begin, stop)
    if free is None:
        for e, starts in v.reach(text, entries, stop).items():
            for s, bits in starts.items():
                if (k := leaves.get((s, e))) is not None:
                    weights[[i for i in range(len(entries)) if bits >> i & 1], k] = 0
        return weights
    first, last = free
    at_first = v.reach(text, entries, first)[first]
    into = np.full(len(entries), -np.inf, np.float32)
    for bits in at_first.values():
        into[[i for i in range(len(entries)) if bits >> i & 1]] = 0
    out = np.full(len(leaves), -np.inf, np.float32)
    for e, starts in v.reach(text, [(last, last)], stop).items():
        for s in starts:
            if (k := leaves.get((s, e))) is not None:
                out[k] = 0
    return into[:, None] + out[None, :]


def _first_and_last_free(text: str, begin: int, stop: int) -> tuple[int, int] | None:
    """The first and last place between words strictly inside a chunk, so far inside that no entry piece passes it."""
    places = [m.start() for m in _FREE.finditer(text, begin, stop) if begin < m.start() < stop]
    return (places[0], places[-1]) if places else None


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def chunk_ids(v: Vocabulary, before: str, core: str, after: str, entry: int, leave: int) -> bytes:
    """Ids of the pieces that begin in a chunk, between its two border states."""
    text, begin, stop = before + core + after, len(before), len(before) + len(core)
    s, e = v.states(before, core + after)[entry]
    entering = (begin + s, begin + e)
    s, e = v.states(before + core, after)[leave]
    leaving = (stop + s, stop + e)
    free = _first_and_last_free(text, begin, stop)
    if free is None:
        return v.ids_of([text[s:e] for s, e in v.trace(text, entering, leaving)])
    first, last = free
    ends = v.reach(text, [entering], first)[first]
    head = v.trace(text, entering, (next(iter(ends)), first))
    tail = v.trace(text, (last, last), leaving)
    words = _WORD.findall(text[first:last])
    v._learn(set(), set(words))
    return (v.ids_of([text[s:e] for s, e in head]) + b"".join(map(v.other.__getitem__, words))
            + v.ids_of([text[s:e] for s, e in tail]))


def learn_chunks(v: Vocabulary, parts: Iterable[tuple[str, str, str]]) -> None:
    """Encode the words of many chunks together, for ``chunk_ids``."""
    if len(v.other) > REMEMBERED:
        v.other.clear()
    words: set[str] = set()
    for before, core, after in parts:
        text, begin = before + core + after, len(before)
        if free := _first_and_last_free(text, begin, begin + len(core)):
            words.update(_WORD.findall(text[free[0]:free[1]]))
    v._learn(set(), words)


# Spark -------------------------------------------------------------------------------

def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([0 if a is None else len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([a for a in arrays if a is not None and len(a)] or [np.empty(0, np.int32)])
    missing = np.array([a is None for a in arrays], bool)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array(missing) if len(arrays) else None)


def _as_array(matrix: np.ndarray) -> tuple[int, bytes]:
    return len(matrix), np.ascontiguousarray(matrix, np.float32).tobytes()


def _as_matrix(rows: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(rows, -1)


def encode(docs: DataFrame, path: str = PATH, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """``docs`` with ``ids``, the SentencePiece ids of the whole text."""
    docs = docs.drop("ids")

    def with_ids(_, batch: pa.RecordBatch, ids: list[np.ndarray | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], names=[*batch.schema.names, "ids"])

    return _encoded(docs, with_ids, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]),
                    path, chunk, block)


def _encoded(docs: DataFrame, finish: Callable[[Vocabulary, pa.RecordBatch, list], pa.RecordBatch], schema,
             path: str, chunk: int, block: int) -> DataFrame:
    """What ``finish`` makes of rows and their ids (null for null), in the task that finds the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    names = docs.columns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):  # the lists of words take several times the text
            texts = batch.column("text").to_pylist()
            found = iter(shared.value.encode_texts([t for t in texts if t is not None]))
            yield finish(shared.value, batch, [None if t is None else next(found) for t in texts])

    small = docs.filter(F.col("text").isNull() | (F.length("text") <= chunk)).mapInArrow(whole, schema)
    large = docs.filter(F.length("text") > chunk)
    # Chunks of giant documents, each a row of its own; the row number holds because the table is written.
    numbered = written(large.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
                       .withColumn("row", F.monotonically_increasing_id()), "giants")
    margin = shared.value.longest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                parts = list(split_text(text, margin, chunk))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()),
                     *(pa.array([p[k] for p in parts], pa.string()) for k in range(3))],
                    names=["row", "chunk", "before", "core", "after"])

    chunks = (numbered.select("row", F.col("doc")["text"].alias("text")).mapInArrow(
        cut, "row bigint, chunk int, before string, core string, after string")
        .repartition("row", "chunk").withColumn("block", F.floor(F.col("chunk") / block).cast("int")))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "core"):
            made = [_as_array(transfer(shared.value, *x)) for x in
                    zip(*(batch.column(n).to_pylist() for n in ("before", "core", "after")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("block"), batch.column("chunk"), pa.array([m[0] for m in made], pa.int32()),
                 pa.array([m[1] for m in made], pa.binary())], names=["row", "block", "chunk", "entries", "weights"])

    kind = "row bigint, block int, chunk int, entries int, weights binary"
    steps = written(chunks.select("row", "block", "chunk", "before", "core", "after").mapInArrow(matrices, kind), "matrices")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Matrix of each block of chunks."""
        key, product = None, None
        for batch in batches:
            done = []
            for row, b, n, w in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "entries", "weights"))):
                if (row, b) != key:
                    if key:
                        done.append((*key, *_as_array(product)))
                    key, product = (row, b), _as_matrix(n, w)
                else:
                    product = combine(product, _as_matrix(n, w))
            yield _rows(done, "row", "block", "entries", "weights")
        if key:
            yield _rows([(*key, *_as_array(product))], "row", "block", "entries", "weights")

    blocks = (steps.repartition("row", "block").sortWithinPartitions("row", "block", "chunk")
              .mapInArrow(products, "row bigint, block int, entries int, weights binary"))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """State before and after each block of a document."""
        held: list = []
        for batch in batches:
            done = []
            for item in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "entries", "weights"))):
                if held and held[0][0] != item[0]:
                    done += _settle(held)
                    held = []
                held.append(item)
            yield _rows(done, "row", "block", "entry", "leave")
        if held:
            yield _rows(_settle(held), "row", "block", "entry", "leave")

    ends = (blocks.repartition("row").sortWithinPartitions("row", "block")
            .mapInArrow(borders, "row bigint, block int, entry int, leave int"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """State before and after each chunk of a block, from those of the block."""
        held: list = []

        def settle():
            first, last = held[0][4], held[0][5]
            states = _settle([(r, c, n, w) for r, c, n, w, _, _ in held], first, last)
            held.clear()
            return states

        for batch in batches:
            done = []
            for row, b, c, n, w, entry, leave in zip(*(batch.column(x).to_pylist() for x in
                                                        ("row", "block", "chunk", "entries", "weights", "entry", "leave"))):
                if held and (held[0][0], held[0][1] // block) != (row, b):
                    done += settle()
                held.append((row, c, n, w, entry, leave))
            yield _rows(done, "row", "chunk", "entry", "leave")
        if held:
            yield _rows(settle(), "row", "chunk", "entry", "leave")

    states = (steps.join(ends, ["row", "block"]).repartition("row", "block").sortWithinPartitions("row", "block", "chunk")
              .mapInArrow(inside, "row bigint, chunk int, entry int, leave int"))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            *columns, borders_of = batch.columns
            ids = []
            texts = batch.column("text").to_pylist()
            learn_chunks(shared.value, (part for text in texts for part in split_text(text, margin, chunk)))
            for text, own in zip(texts, borders_of.to_pylist()):
                parts = zip(split_text(text, margin, chunk), sorted(own, key=lambda b: b["chunk"]))
                ids.append(np.frombuffer(b"".join(chunk_ids(shared.value, *part, b["entry"], b["leave"]) for part, b in parts), np.int32))
            yield finish(shared.value, pa.RecordBatch.from_arrays(columns, names=names), ids)

    more = free_name(docs, "borders")
    found = states.groupBy("row").agg(F.collect_list(F.struct("chunk", "entry", "leave")).alias(more))
    giants = numbered.join(found, "row").select("doc.*", more).mapInArrow(traced, schema)
    return small.unionByName(giants)


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    kinds = {"row": pa.int64(), "weights": pa.binary()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int32())) for c, n in zip(columns, names)], names=list(names))


def _settle(steps: list[tuple], entry: int = 0, leave: int | None = None) -> list[tuple[int, int, int, int]]:
    """States at the borders of a row of steps (row, number, entries, weights): forward vectors, then one way back."""
    weights = [_as_matrix(n, w) for _, _, n, w in steps]
    vector = np.full(len(weights[0]), -np.inf, np.float32)
    vector[entry] = 0
    forward = [vector]
    for w in weights:
        forward.append((forward[-1][:, None] + w).max(axis=0))
    at = int(forward[-1].argmax()) if leave is None else leave
    out = []
    for k in range(len(steps) - 1, -1, -1):
        before = int((forward[k] + weights[k][:, at]).argmax())
        out.append((steps[k][0], steps[k][1], before, at))
        at = before
    return out[::-1]


def decode(encoded: DataFrame, path: str = PATH) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids`` (null for null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))
    encoded = encoded.drop("decoded")
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            texts = [shared.value.decode(ids[k].values.to_numpy(zero_copy_only=False)) if ids[k].is_valid else None
                     for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def summary(docs: DataFrame, path: str = PATH) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (little-endian int32), round_trip: whether decoding gives the text back.

    Ids are digested and decoded in the task that found them, so that neither they nor the texts move again.
    """
    def digests(v: Vocabulary, batch: pa.RecordBatch, ids: list[np.ndarray | None]) -> pa.RecordBatch:
        rows = [(None, None, None) if own is None else
                (len(own), hashlib.sha256(own.astype("<i4").tobytes()).hexdigest(), v.decode(own) == text.replace(SPACE, " "))
                for own, text in zip(ids, batch.column("text").to_pylist())]
        kinds = [pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))],
                                          names=["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _encoded(texts, digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, round_trip boolean", path, CHUNK, BLOCK)
