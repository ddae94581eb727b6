"""Personal data: candidate spans, boosted trees, calibrated thresholds (operator 6).

Base spans come from four strict patterns with their checks and are always kept. High-recall generators propose further,
overlapping spans: runs of digit groups inside longer chains, telephone numbers cut at every group, dotted quads, spelt
out e-mail addresses, national telephone numbers. Boosted trees on format and context features score them, the scores are
calibrated on held-out candidates, and per kind the lowest threshold decides that has the wanted precision on the
held-out ones; a kind without negatives there adds nothing. Selected spans never overlap each other or a base span.

The trees are trained here, on the candidates of all documents: cuts, trees, calibration and thresholds are aggregations over
their table. Labels come from the checks: base spans are
positive; candidates inside a base span but shorter, those that cut into a base span of another kind, and those that fail
the check of their kind are negative. The looser forms get theirs from rewritten texts: a base address is spelt out, a base
telephone number written in a national form, where they stand (positive); words of the same text joined by "at" and "dot",
and the same digits after a word that announces an order, a version or a part take their places (negative).

A null text is empty and has no span, like a text without digits, ``@`` and the word "at". Repeated rows give repeated results, equal
probabilities are resolved by length, then by start; an empty table gives an empty result; other columns are ignored by
``find`` and carried along by ``redact``. Patterns are linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skylag.llm import boosting
from skylag.llm.tables import written
from skylag.llm.words import sliced

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
Span = tuple[str, int, int]

# The strict patterns, written so that no place of a text is tried twice: an address is found at its @ and grown to the
# left, a run of digits is entered at its first digit only.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}) ?[\[({]? ?\bat\b ?[\])}]? ?([A-Za-z0-9-]{1,63})((?: ?[\[({]? ?\bdot\b ?[\])}]? ?[A-Za-z0-9-]{2,24})+)", re.I)
_PLAIN_PHONE = re.compile(r"(?<![0-9+])\([0-9]{2,4}\) ?[0-9]{3,4}[ -][0-9]{3,4}(?![0-9])"
                          r"|(?<![0-9+.-])[0-9]{3}([-. ])[0-9]{3}\1[0-9]{4}(?![0-9]|[.-][0-9])")
# Last labels of addresses that are likely when spelt out, and words that announce other numbers.
_LABELS = frozenset("com org net edu gov mil int info io ai dev app me us uk de fr es it nl eu ca au ch at se no pl pt br mx jp in example test".split())
_NOT_PHONES = ("order", "invoice", "ref", "isbn", "version", "part no.", "section", "serial", "ticket", "build")
# What every pattern above implies.
_ANY = re.compile(r"[0-9@]|\bat\b", re.I)
_CONTEXT = (re.compile(r"mail|contact|@", re.I), re.compile(r"\bip\b|host|server|addr", re.I),
            re.compile(r"card|visa|credit|pay|account", re.I), re.compile(r"phone|tel|call|mobile|fax", re.I),
            re.compile(r"\b(?:order|invoice|ref|isbn|version|part|section|serial|ticket|build|no)\b\.?[ :#]*$", re.I))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _octets_fit(text: str) -> bool:
    return all(len(p) < 4 and int(p) <= 255 if len(p) < 4 else int(p.lstrip("0")[:4] or 0) <= 255 for p in text.split("."))


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[Span]:
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield "email", start, end


def base_spans(text: str) -> list[Span]:
    """Spans of the strict patterns that pass their checks, by kind, then start."""
    spans = list(_emails(text)) if "@" in text else []
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if _octets_fit(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _only_digits(m.group())) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return spans


def candidates(text: str) -> set[Span]:
    """What the generators propose: every base pattern and its parts, and looser forms."""
    found: set[Span] = set()
    for m in _CARD.finditer(text):
        groups = [g.span() for g in _DIGITS.finditer(text, *m.span())]
        for k, (start, _) in enumerate(groups):
            digits = 0
            for a, b in groups[k:]:
                digits += b - a
                if digits > 19:
                    break
                if digits >= 12:
                    found.add(("card", start, b))
    for m in _PHONE.finditer(text):
        digits = 0
        for g in _DIGITS.finditer(text, *m.span()):
            digits += g.end() - g.start()
            if digits > 15:
                break
            if digits >= 8:
                found.add(("phone", m.start(), g.end()))
    found.update(("phone", *m.span()) for m in _PLAIN_PHONE.finditer(text))
    found.update(("ip", *m.span()) for m in _IP.finditer(text))
    found.update(_emails(text))
    found.update(("email", *m.span()) for m in _SPELT.finditer(text))
    return found


def _class(text: str, at: int) -> int:
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ".,;:!?" else 5


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    kind, start, end = span
    s = text[start:end]
    groups = _DIGITS.findall(s)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    near = text[max(0, start - 24):start]
    parts = s.split(".")
    return [KINDS.index(kind), end - start, len(digits), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes),
            len(set(digits)), float(13 <= len(digits) <= 19 and luhn(digits)),
            float(kind == "ip" and _octets_fit(s)), s.count(" "), s.count("-"), s.count("."), s.count("(") - s.count(")"),
            float("(" in s), float(s[:1] == "+"), float("@" in s), len(parts[-1]), sum(map(str.isalpha, s)) / len(s),
            float(kind == "email" and _last_label(s) in _LABELS), float("[" in s or "{" in s),
            float(bool(re.search("[._0-9-]", re.split("[ (\\[{@]", s, maxsplit=1)[0]))),
            _class(text, start - 1), _class(text, end), *(float(bool(c.search(near))) for c in _CONTEXT)]


def _last_label(address: str) -> str:
    """The last word of an address, in lower case."""
    return re.split("[^a-z0-9]+", address.lower().rstrip(")]} "))[-1]


def _checked(text: str, span: Span) -> bool:
    """Whether a candidate passes the check of its kind, wherever it stands."""
    kind, start, end = span
    s = text[start:end]
    digits = _only_digits(s)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return _octets_fit(s) if kind == "ip" else 9 <= len(digits) <= 15 if kind == "phone" else True


def _label(text: str, span: Span, base: list[Span]) -> int | None:
    if span in base:
        return 1
    if span[0] == "phone" and text[span[1]] != "+" and any(k == "phone" and start < span[2] and span[1] < end for k, start, end in base):
        return None  # a national number within a base span is one, and never added
    if any(start < span[2] and span[1] < end for _, start, end in base) or not _checked(text, span):
        return 0
    return None


@dataclass
class Detector:
    trees: boosting.Trees | None
    thresholds: dict[str, float]  # by kind; a kind that is missing adds nothing

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        if not text or not _ANY.search(text):
            return [], []
        base = base_spans(text)
        taken = sorted((start, end) for _, start, end in base)
        more = sorted(c for c in candidates(text) if c[0] in self.thresholds and _free(c, taken))
        if not more or self.trees is None:
            return base, base
        p = self.trees.probabilities(np.array([features(text, c) for c in more]))
        added: list[Span] = []
        for _, _, start, end, kind in sorted((-q, c[1] - c[2], c[1], c[2], c[0]) for q, c in zip(p, more)
                                             if q >= self.thresholds[c[0]] and _checked(text, c)):
            if _free((kind, start, end), places := sorted((a, b) for _, a, b in added)):
                added.append((kind, start, end))
        return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _free(span: Span, taken: list[tuple[int, int]]) -> bool:
    """Whether a span overlaps none of the sorted places (base spans of different kinds may overlap each other)."""
    return not any(start < span[2] and span[1] < end for start, end in taken)


#: Ways to write "at" and "dot".
_AT_FORMS, _DOT_FORMS = (" at ", " AT ", " [at] ", "(at)", " (at) ", "[at]"), (" dot ", " DOT ", " [dot] ", "(dot)", " (dot) ", "[dot]")
_PLAIN_NAME = re.compile("[A-Za-z]+")


def rewritten(text: str, base: list[Span], key: str) -> Iterator[tuple[str, Span, int]]:
    """(text, span, label): the looser forms of a text's base addresses and telephone numbers, and look-alikes in their place."""
    words = re.findall("[A-Za-z]{2,12}", text)
    for kind in ("email", "phone"):
        for start, end in [s[1:] for s in base if s[0] == kind]:
            draw = int(hashlib.sha1(f"{key}:{kind}:{start}".encode()).hexdigest()[:12], 16)
            found = text[start:end]
            if kind == "email" and words:
                form = draw % len(_AT_FORMS)
                at, dot = _AT_FORMS[form], _DOT_FORMS[form]
                local, _, domain = found.partition("@")
                a, b, c = (words[(draw >> s) % len(words)] for s in (3, 13, 23))
                forms = [(local + at + domain.replace(".", dot), "", 1)]
                # The same with a plain name and the last two labels; look-alikes with a plain word or the address's own first part.
                name = _PLAIN_NAME.match(local)
                if name:
                    forms.append((name.group() + at + dot.join(domain.split(".")[-2:]), "", 1))
                if c.lower() not in _LABELS:
                    forms.append((f"{a} at {b} dot {c}", "", 0))
                    forms.append((f"{local} at {b} dot {c}", "", 0))
            else:
                digits = _only_digits(found)[-10:]
                if len(digits) < 10:
                    continue
                a, b, c = digits[:3], digits[3:6], digits[6:]
                form = (f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")[draw % 5]
                forms = [(form, "", 1), (form, _NOT_PHONES[draw % len(_NOT_PHONES)] + " ", 0)]
            for form, announced, label in forms:
                head = text[max(0, start - 200):start] + announced
                yield head + form + text[end:end + 200], (kind, len(head), len(head) + len(form)), label


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        rows, labels, keys = [], [], []  # a key names the place that decides whether a candidate is held out
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if not text or not _ANY.search(text):
                continue
            base = base_spans(text)
            for c in sorted(candidates(text)):
                if (label := _label(text, c, base)) is not None:
                    rows.append(features(text, c))
                    labels.append(label)
                    keys.append(f"{doc}:{c[0]}:{c[1]}:{c[2]}")
            for n, (other, span, label) in enumerate(rewritten(text, base, str(doc))):
                if span in candidates(other):
                    rows.append(features(other, span))
                    labels.append(label)
                    keys.append(f"{doc}:{span[0]}:rewritten:{n}")
        held = [int(hashlib.sha1(key.encode()).hexdigest()[:4], 16) % 4 == 0 for key in keys]
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(held, pa.bool_()),
                                          pa.array(rows, pa.list_(pa.float64()))], names=["label", "held", "x"])


def fit(docs: DataFrame, precision: float = PRECISION) -> Detector:
    """Train on the labelled candidates of all documents; a quarter, by a hash of their place, is held out for thresholds."""
    rows = written(docs.select("doc_id", "text").mapInArrow(_labelled, "label int, held boolean, x array<double>"), "candidates")
    labels = {r["label"]: r["held"] for r in rows.groupBy("label").agg(F.count_if("held").alias("held")).collect()}
    if len(labels) < 2:
        return Detector(None, {})
    trees = boosting.fit_rows(rows, rows.select(F.size("x")).first()[0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(trees.scores(x)), batch.column("label")],
                                             names=["kind", "score", "label"])

    known = all(labels.values())  # else the held-out ones have one class, and all candidates calibrate
    scores = written((rows.filter("held") if known else rows).mapInArrow(scored, "kind int, score double, label int")
                     .groupBy("kind", "score").agg(F.sum("label").alias("positive"), F.count(F.lit(1)).alias("n")), "scores")
    boosting.calibrate(trees, boosting.blocks_of(scores))
    return Detector(trees, _thresholds(scores, trees, precision) if known else {})


def _thresholds(scores: DataFrame, trees: boosting.Trees, precision: float) -> dict[str, float]:
    """Per kind with both labels the lowest probability, a half at least, from which on the share of positives is ``precision``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.interp(batch.column("score").to_numpy(zero_copy_only=False), trees.at, trees.share)
            yield pa.RecordBatch.from_arrays([pa.array(p), *(batch.column(c) for c in ("kind", "positive", "n"))],
                                             names=["p", "kind", "positive", "n"])

    sums = [F.sum(c).alias(c) for c in ("positive", "n")]
    both = scores.groupBy("kind").agg(*sums).filter("positive > 0 AND positive < n").select("kind")
    ranked = written(
        scores.mapInArrow(run, "p double, kind int, positive bigint, n bigint").filter("p >= 0.5").join(both, "kind")
        .groupBy("kind", "p").agg(*sums).repartitionByRange("kind", "p").withColumn("part", F.spark_partition_id()), "ranked")
    # Running sums inside the parts, and what the later parts of a kind hold.
    parts = ranked.groupBy("kind", "part").agg(*sums)
    later = Window.partitionBy("kind").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("kind", "part", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("positive", "n")])
    inside = Window.partitionBy("kind", "part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    from_here = ranked.join(before, ["kind", "part"]).select(
        "kind", "p", *[(F.sum(c).over(inside) + F.col(f"{c}_later")).alias(c) for c in ("positive", "n")])
    lowest = from_here.filter(F.col("positive") / F.col("n") >= precision).groupBy("kind").agg(F.min("p").alias("p")).collect()
    return {KINDS[r["kind"]]: r["p"] for r in lowest}


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(docs: DataFrame, detector: Detector) -> DataFrame:
    """Per document: doc_id, ``base`` and ``spans`` as text, ``kind:start:end`` in code points, by kind and start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            both = [detector.spans(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([_joined(b) for b, _ in both], pa.string()),
                 pa.array([_joined(s) for _, s in both], pa.string())], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, base string, spans string")


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets."""
    names = docs.columns
    place = names.index("text")

    def cleaned(text: str | None) -> str | None:
        at, out = 0, []
        for kind, start, end in sorted(detector.spans(text)[1], key=lambda x: x[1:]):
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = pa.array([cleaned(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == place else c for k, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)
