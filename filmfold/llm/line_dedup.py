"""Near-duplicate lines across a corpus: MinHash, banding, exact Jaccard, one line kept per component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from filmfold.llm import buckets
from filmfold.llm.common import mixed, parity_bitmap, signed, texts, unused, wide_bits, written
from filmfold.llm.components import components, extended

#: Characters of a line, once normalised, from which it is an item; blank lines alone are none. A line shorter than a
#: shingle repeats only lines equal to it, which its id tells.
LEAST_CHARS = 1
#: Characters of a shingle and the similarity from which two lines are one. Eight characters are long enough that
#: unrelated lines of one language share almost none, short enough that a changed word leaves most.
SHINGLE = 8
PERCENT = 75
#: Rows and bands of the signature: a pair at 0.75 meets with probability 0.9896, at 0.8 with 0.9982, at 0.85 with
#: 0.9999. Three rows would meet unlike lines in numbers that grow with the square of the input.
ROWS, BANDS = 4, 12
#: Bits of the bitmaps that tiles compare: several to a shingle of most lines, so that pairs just below the
#: threshold, of which a group of near copies has many, do not pass.
BITS = 4096
#: Bits at least of the bitmaps that travel with a pair, which have about one to a shingle.
LEAST_BITS = 512
#: Characters hashed at once, and lines that leave a task together.
BLOCK_CHARS, BLOCK_LINES = 1 << 20, 1 << 16

_WEIGHTS = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_FACTORS = (mixed(np.arange(101, 101 + ROWS * BANDS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADDED = (mixed(np.arange(501, 501 + ROWS * BANDS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def line_id(line: str) -> tuple[int, int]:
    """Two longs, 127 bits of one hash of the normalised line: its id, and a check by which lines that share an id differ.

    The check is odd, so zero is free to stand for "as its id says".
    """
    high, low = divmod(xxhash.xxh3_128_intdigest(line.encode("utf-8")), 1 << 64)
    return high - (1 << 63), (low | 1) - (1 << 63)


def _windows(codes: np.ndarray) -> np.ndarray:
    last = len(codes) - SHINGLE + 1
    run = np.zeros(last, np.uint64)
    for k in range(SHINGLE):
        run += codes[k:k + last] * _WEIGHTS[k]
    return mixed(run)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def shingles(line: str) -> np.ndarray:
    """Sorted distinct hashes of the character shingles of a normalised line of SHINGLE characters or more."""
    return np.unique(_windows(_codes(line)))


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys: minima of the shingle hashes under ROWS * BANDS orders, hashed by band."""
    lengths = np.array([len(x) for x in lines])
    hashed = (_windows(_codes("".join(lines))) >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(lengths)
    inside = np.ones(ends[-1], bool)
    for back in range(1, SHINGLE):  # windows that would run over the end of their line
        inside[ends - back] = False
    hashed = hashed[inside[:len(hashed)]]
    starts = np.concatenate([[0], np.cumsum(lengths - SHINGLE + 1)[:-1]])
    keys = np.empty((len(lines), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), band, np.uint64)
        for row in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat(hashed * _FACTORS[row] + _ADDED[row], starts)
            key = mixed(key + least)
        keys[:, band] = key
    return keys


def _eligible(text: str | None) -> Iterator[tuple[int, str]]:
    for place, line in enumerate((text or "").split("\n")):
        line = normal(line)
        if len(line) >= LEAST_CHARS:
            yield place, line


def _members(line: pa.StringScalar) -> np.ndarray:
    return shingles(line.as_py())


class _Lines:
    """Columns of lines on their way out of a task; ``new`` are those met for the first time, at rows ``at``."""

    def __init__(self):
        self.doc, self.owner, self.place, self.id, self.check = [], [], [], [], []
        self.new: list[str] = []
        self.at: list[int] = []
        self.chars = 0

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.id) >= BLOCK_LINES

    def batch(self) -> pa.RecordBatch:
        rows = len(self.id)
        lengths = np.zeros(rows, np.int64)
        lengths[self.at] = BANDS
        flat = signed(signatures(self.new).reshape(-1)) if self.new else np.empty(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        lines: list[str | None] = [None] * rows
        for i, line in zip(self.at, self.new):
            lines[i] = line
        longs = [pa.array(x, pa.int64()) for x in (self.doc, self.owner, self.id, self.check)]
        return pa.RecordBatch.from_arrays(
            [*longs, pa.array(self.place, pa.int32()), pa.array(lines, pa.string()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=["doc_id", "owner", "id", "check", "place", "line", "bands"])


def _line_table(docs: DataFrame) -> DataFrame:
    """Each eligible line: doc_id, owner, id, check, place; where it is first met in a batch and has a shingle, also the
    normalised line and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            out = _Lines()
            for doc, owner, text in zip(texts(batch["doc_id"]), texts(batch["owner"]), texts(batch["text"])):
                for place, line in _eligible(text):
                    found = line_id(line)
                    if len(line) >= SHINGLE and found not in seen:
                        seen.add(found)
                        out.new.append(line)
                        out.at.append(len(out.id))
                        out.chars += len(line)
                    out.doc.append(doc)
                    out.owner.append(owner)
                    out.place.append(place)
                    out.id.append(found[0])
                    out.check.append(found[1])
                    if out.full():
                        yield out.batch()
                        out = _Lines()
            if out.id:
                yield out.batch()

    return docs.select("doc_id", "owner", "text").mapInArrow(
        run, "doc_id long, owner long, id long, check long, place int, line string, bands array<long>")


def _line_sets(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, check, n, bitmaps and members of the wanted lines.

    The members travel as the line itself, an eighth of its array. Should
    several lines share an id, the one with the smallest check has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bitmaps, wide = [], [], []
            for line in texts(batch["members"]):
                values = shingles(line)
                sizes.append(len(values))
                bitmaps.append(parity_bitmap(values, BITS))
                wide.append(parity_bitmap(values, wide_bits(len(values), LEAST_BITS)))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["check"], pa.array(sizes, pa.int64()), pa.array(bitmaps, pa.binary()),
                 pa.array(wide, pa.binary()), batch["members"]],
                names=["id", "check", "n", "bitmap", "wide", "members"])

    one = lines.filter("line is not null").select("id", "check", "line").join(wanted, "id", "left_semi") \
        .groupBy("id").agg(F.min(F.struct("check", "line")).alias("of"))
    return one.select("id", F.col("of.check").alias("check"), F.col("of.line").alias("members")).mapInArrow(
        run, "id long, check long, n long, bitmap binary, wide binary, members string")


def _owned(docs: DataFrame, owner: str = "owner") -> DataFrame:
    """Documents with a hash of the text, which tells rows of one doc_id apart."""
    return docs.withColumn(owner, F.xxhash64("text"))


def _drops(docs: DataFrame) -> DataFrame:
    """(doc_id, owner, place, id) of the lines to drop from documents with an owner."""
    lines = written(_line_table(docs), "lines")
    # Key and id alone are shuffled; what orders a bucket is worked out behind the shuffle.
    keys = lines.select(F.explode("bands").alias("key"), "id").repartition("key").withColumn("n", F.lit(1))
    members = written(buckets.shared(keys, few_hubs=False), "line-members")
    sets = written(_line_sets(lines, members.select("id")), "line-sets")
    sized = members.select("key", "id", "hub").join(sets.select("id", "n"), "id")

    def linked(pairs: DataFrame) -> DataFrame:
        near = buckets.bitmap_filter(pairs, sets, PERCENT)
        return written(buckets.verified(near, sets, PERCENT, _members), "line-links")

    groups = written(components(linked(buckets.hub_pairs(members, PERCENT))), "line-groups")
    # Groups only grow, so a bucket that is settled once needs no further look.
    unsettled = written(buckets.unsettled(sized, groups), "line-unsettled").drop("grp")
    for pairs in (lambda: buckets.neighbour_pairs(unsettled, groups, PERCENT),
                  lambda: buckets.cross_pairs(unsettled, groups, sets, PERCENT)):
        if unsettled.isEmpty():
            break
        groups = extended(groups, linked(pairs()))

    marks = groups.join(sets.select(F.col("id").alias("node"), F.col("check").alias("of")), "node")
    named = written(lines.select("doc_id", "owner", "place", "id", "check").join(
        marks, F.col("id") == F.col("node"), "left").select(
        "doc_id", "owner", "place", "id", F.coalesce("component", "id").alias("item"),
        F.when(F.col("of") == F.col("check"), 0).otherwise(F.col("check")).alias("mark")), "line-items")
    kept = named.groupBy("item", "mark").agg(
        F.min(F.struct("doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("c"))
    kept = written(kept.filter("c > 1").select("item", "mark", "first"), "line-kept")
    return named.join(kept, ["item", "mark"]).filter(F.struct("doc_id", "place") != F.col("first")) \
        .select("doc_id", "owner", "place", "id")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, place, id) of every line to drop: near or exact repeats of a line in an earlier place.

    The line with the smallest (doc_id, place) of a component stays. Exact
    repeats are one item by their hash. Distinct lines meet in bands; a bucket's
    hub links its copies, and buckets with unlinked lines left have those
    compared in tiles. All links are verified on whole shingle sets.

    Null and empty texts have no lines, blank lines are kept. Lines shorter than
    a shingle are compared for equality only.
    Equality is that of 127 bits of a hash. Of different lines that share the
    64 bits of an id, one is compared with others, the rest repeat only lines
    equal to them. Rows alike in doc_id and text lose the same lines; of rows that share a
    doc_id but not the text, each loses only lines of its own, by their ids. A
    null doc_id's lines count as the first. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _drops(_owned(docs)).select("doc_id", "place", "id")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` (and ``n_chars``, if there) after line removal, and a column ``lines_dropped``.

    Every document stays, also when no line of it does; its text is then empty.
    Drops meet their document by doc_id and text, so rows with a null doc_id
    are as many keys as they have texts, and a key has no more drops than its
    text has lines.
    """
    of, whose, gone, owner = unused(docs, "of", "whose", "gone", "owner")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drops = _drops(_owned(ids)).groupBy(F.col("doc_id").alias(of), F.col("owner").alias(whose)).agg(
        F.collect_set("place").alias(gone))
    out = _owned(docs, owner).join(
        written(drops, "line-drops"), F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(owner) == F.col(whose)), "left")
    whole = F.col(gone).isNull()
    left = F.filter(F.split("text", "\n", -1), lambda line, place: ~F.array_contains(gone, place))
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(left, "\n"))) \
        .withColumn("lines_dropped", F.when(whole, 0).otherwise(F.size(gone)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars"))
                             .otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.drop(of, whose, gone, owner)
