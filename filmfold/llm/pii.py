"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmfold.llm.common import texts

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider than the rules: e-mail addresses written out, telephone numbers without a plus, grouped card numbers.
_SPOKEN = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?[(\[{] ?(?:at|@) ?[)\]}] ?([A-Za-z0-9-]{1,63})"
                     r"((?: ?[(\[{] ?(?:dot|\.) ?[)\]}] ?|\.)[A-Za-z0-9-]{1,63})+", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./-][0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9])")
_GROUPED = re.compile(r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])")
#: Where the rules' greedy runs swallow two neighbours at once, each by itself.
_ONE_PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])")
_ONE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")

#: Gazetteer: top-level names of mail hosts, first digits of card issuers.
_TOP_LEVEL = frozenset("com org net edu gov io co info biz de fr es uk eu us ch at it nl".split())
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
#: Context: words that stand before personal data of a kind.
_CONTEXT = {
    "email": frozenset("mail email e-mail contact write reach courriel correo kontakt".split()),
    "ip": frozenset("ip host server address client from addr login".split()),
    "card": frozenset("card visa mastercard credit payment carte tarjeta karte".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell numéro teléfono telefon".split()),
}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
#: Characters of context read on each side.
WINDOW = 24
LEAST = 0.5
#: Candidates that a table counts as when the labelers are weighed and the classifier is fitted, whatever its size: the
#: priors and the ridge term weigh the same in any table.
TOTAL = 10_000.0


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their @: the local part can only reach back to the last match or @."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL_CHARS))
        found = _LOCAL.match(text, start) if start < at else None
        if found:
            yield Span("email", start, found.end())
        free = found.end() if found else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[Span]:
    """Four numbers joined by dots; a longer chain gives one match for each whole four."""
    for chain in _DOTTED.finditer(text):
        parts = chain.group().split(".")
        place = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = place + sum(map(len, four)) + 3
            if all(int(p) <= 255 for p in (x.lstrip("0")[:4] or "0" for x in four)):
                yield Span("ip", place, end)
            place = end + 1


def _cards(text: str) -> Iterator[Span]:
    for found in _NUMBER.finditer(text):
        digits = found.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield Span("card", found.start(), found.end())


def _phones(text: str) -> Iterator[Span]:
    for found in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in found.group()) <= 15:
            yield Span("phone", found.start(), found.end())


def base_spans(text: str) -> list[Span]:
    """Matches of the four rules, by kind and start."""
    return [*_emails(text), *_ips(text), *_cards(text), *_phones(text)]


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Places that may be personal data: the rules' matches, near misses of the rules, and wider patterns.

    Earlier patterns are narrower and win where two overlap.
    """
    found = list(base)
    if any(c in text for c in "([{"):
        found += [Span("email", m.start(), m.end()) for m in _SPOKEN.finditer(text)]
    if "+" in text:
        found += [Span("phone", m.start(), m.end()) for m in _ONE_PHONE.finditer(text)]
    found += [Span("card", m.start(), m.end()) for m in _ONE_CARD.finditer(text)]
    found += [Span("card", m.start(), m.end()) for m in _GROUPED.finditer(text)]
    for m in _NUMBER.finditer(text):
        if 13 <= sum(c.isdigit() for c in m.group()) <= 19:
            found.append(Span("card", m.start(), m.end()))
    found += [Span("phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    found += [Span("ip", m.start(), m.end()) for m in _DOTTED.finditer(text) if m.group().count(".") == 3]
    kept, starts, ends = [], [], []
    for span in dict.fromkeys(found):  # base first: nothing else may overlap it
        at = bisect_right(starts, span.start)  # those taken are apart, so only the two beside it can overlap
        if (at and ends[at - 1] > span.start) or (at < len(starts) and starts[at] < span.end):
            continue
        kept.append(span)
        starts.insert(at, span.start)
        ends.insert(at, span.end)
    return kept


LABELERS = ("rule", "checksum", "gazetteer", "context", "border", "length")


def votes(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """One vote a labeler: 1 personal data, 0 not, -1 no opinion."""
    inside = text[span.start:span.end]
    digits = "".join(c for c in inside if c.isascii() and c.isdigit())
    left, right = text[span.start - 1:span.start], text[span.end:span.end + 1]
    ahead = set(w.lower() for w in _WORD.findall(text[max(0, span.start - WINDOW):span.start]))
    checksum = gazetteer = -1
    if span.kind == "card":
        checksum = int(luhn(digits))
        gazetteer = int(digits.startswith(_ISSUERS))
        length = int(len(digits) in (15, 16, 19))
    elif span.kind == "ip":
        parts = inside.split(".")
        checksum = int(all(len(p) <= 3 and int(p) <= 255 and (p == "0" or p[0] != "0") for p in parts))
        length = int(7 <= len(inside) <= 15)
    elif span.kind == "email":
        gazetteer = int(re.split(r"[^A-Za-z0-9-]+", inside.rstrip(")]}"))[-1].lower() in _TOP_LEVEL)
        length = int(len(inside) <= 80)
    else:
        length = int(9 <= len(digits) <= 13)
        gazetteer = 1 if inside.startswith(("+", "00")) else -1
    context = 1 if ahead & _CONTEXT[span.kind] else -1
    joined = any(c and (c.isalnum() or c in "._/=-") for c in (left, right[:1] if right != "." else ""))
    return int(is_base), checksum, gazetteer, context, int(not joined), length


def traits(text: str, span: Span) -> tuple[int, ...]:
    """Yes-no features of the classifier: the span itself and the characters beside it, without the votes."""
    inside = text[span.start:span.end]
    n_digits = sum(c.isdigit() for c in inside)
    left, right = text[span.start - 1:span.start], text[span.end:span.end + 1]
    return (
        *(int(span.kind == k) for k in KINDS), int("@" in inside), int(inside.startswith("+")), int("(" in inside),
        int(" " in inside), int("-" in inside), int("." in inside), int(n_digits == len(inside)), int(n_digits >= 16),
        int(n_digits < 9), int(left.isalnum()), int(right.isalnum()), int(left in "\"'=:/_" and left != ""),
        int(right in "\"'=:/_" and right != ""),
        int(span.kind == "card" and luhn("".join(c for c in inside if c.isdigit()))),
    )


class Model(NamedTuple):
    """Reliabilities of the labelers by kind (for looking at) and the classifier's weights."""

    accuracy: dict[str, dict[str, float]]
    weights: np.ndarray


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: (labelers, 2, 2) chances of a vote given the truth, and the
    chance of each pattern to be personal data.

    Starts from the majority; a labeler without an opinion adds nothing. The
    prior counts keep a labeler that never errs from a certainty of its own.
    """
    voted = patterns >= 0
    posterior = (np.where(voted, patterns, 0).sum(1) + 0.5) / (voted.sum(1) + 1)
    for _ in range(rounds):
        share = np.clip((counts * posterior).sum() / counts.sum(), 0.01, 0.99)
        table = np.empty((patterns.shape[1], 2, 2))
        for j in range(patterns.shape[1]):
            for truth, weight in ((1, posterior), (0, 1 - posterior)):
                ones = (counts * weight * (patterns[:, j] == 1)).sum() + (2 if truth else 1)
                zeros = (counts * weight * (patterns[:, j] == 0)).sum() + (1 if truth else 2)
                table[j, truth] = zeros / (ones + zeros), ones / (ones + zeros)
        logit = np.full(len(patterns), np.log(share / (1 - share)))
        for j in range(patterns.shape[1]):
            gain = np.log(table[j, 1] / table[j, 0])
            logit += np.where(voted[:, j], gain[np.clip(patterns[:, j], 0, 1)], 0)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return table, posterior


def train(docs: DataFrame) -> Model:
    """Count every candidate's votes and traits over the whole table, weigh the labelers, fit the classifier.

    Counts are summed in each batch, then by Spark; votes and traits are a few
    yes-no values, so the patterns that reach the driver are bounded whatever
    the input's size. The full counts are scaled to a sum of TOTAL, so a table
    and the same mix at any other size give the same model. Without candidates
    the classifier accepts nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in texts(batch["text"]):
                if text:
                    base = base_spans(text)
                    known = set(base)
                    for span in candidates(text, base):
                        pattern = (KINDS.index(span.kind), *votes(text, span, span in known), *traits(text, span))
                        seen[",".join(map(str, pattern))] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    rows = docs.select("text").mapInArrow(count, "pattern string, n long").groupBy("pattern") \
        .agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    width = len(KINDS) + 14
    if not rows:
        return Model({}, np.append(np.zeros(width), -30.0))
    table = np.array([[int(x) for x in r["pattern"].split(",")] for r in rows])
    counts = np.array([r["n"] for r in rows], float)
    counts *= TOTAL / counts.sum()
    posterior, accuracy = np.zeros(len(rows)), {}
    for k, kind in enumerate(KINDS):
        here = table[:, 0] == k
        if here.any():
            chances, posterior[here] = reliabilities(table[here, 1:1 + len(LABELERS)], counts[here])
            accuracy[kind] = {name: round(float((chances[j, 1, 1] + chances[j, 0, 0]) / 2), 4)
                              for j, name in enumerate(LABELERS)}
    features = np.column_stack([table[:, 1 + len(LABELERS):], np.ones(len(rows))])
    theta = np.zeros(features.shape[1])
    for _ in range(50):  # Newton steps of a ridge logistic regression on soft labels
        chance = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        slope = features.T @ (counts * (chance - posterior)) + theta
        curve = (features * (counts * chance * (1 - chance))[:, None]).T @ features + np.eye(len(theta))
        theta -= np.linalg.solve(curve, slope)
    return Model(accuracy, theta)


def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with what the classifier adds, both by kind and start."""
    base = base_spans(text)
    known = set(base)
    more = [s for s in candidates(text, base) if s not in known
            and 1 / (1 + np.exp(-np.clip(np.dot((*traits(text, s), 1), model.weights), -30, 30))) >= LEAST]
    return base, sorted([*base, *more], key=lambda s: (KINDS.index(s.kind), s.start))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each whole text; places in code points.

    The counts and the digest are of the rules' matches, ``spans`` are all
    spans. A null text counts as empty. Repeated rows give repeated results;
    other columns are ignored; no rows give none. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for text in texts(batch["text"]):
                base, every = all_spans(text or "", model)
                for column, kind in zip(counts, KINDS):
                    column.append(sum(s.kind == kind for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
