"""Token ids in ORC files, ordered by document, with statistics and Bloom filters to read single documents."""

from __future__ import annotations

import functools
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filmfold.llm.bpe import byte_letters
from filmfold.llm.common import CLEANUP, texts, written

#: Appended to each document.
END = 2
#: Parts of a kind remembered by one worker, and as many from before.
MEMO = 150_000
_SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of anything but Unicode white space, where the vocabulary's own split never joins text.
WORDS = re.compile(f"[^{_SPACE}]+")
#: Characters that normalisation only lower-cases, one by one: Latin, its punctuation, and white space.
_PLAIN = re.compile(r"[\x00-\u012f\u0132-\u0148\u014a-\u017f]*")
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The vocabulary's public split, written out for those characters.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
_LETTER_OF = {byte: letter for letter, byte in byte_letters().items()}


class WordEncoder:
    """Ids of a text by the tokenizers library, which merges each new piece once.

    Plain Latin text is lower-cased and cut here, and its pieces go to the
    library's model; other text goes to the library word by word, with its
    normalisation and split. Either way a text's ids are those of its parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.words = _Pieces(self), _Words(self)

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids, the end id included."""
        text = text or ""
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            parts = map(self.pieces.__getitem__, _PIECES.findall(text.lower()))
        else:
            parts = map(self.words.__getitem__, WORDS.findall(text))
        return b"".join(parts) + _packed([END])


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class _Memo(dict):
    """Ids of parts met lately; when full, what it holds becomes the older generation, and what is met again comes back."""

    def __init__(self, encoder: WordEncoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        found = self.older.get(part)
        if found is None:
            found = self.ids(part)
        if len(part) <= 64:
            self[part] = found
        return found


class _Pieces(_Memo):
    def ids(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(_LETTER_OF)
        return _packed([t.id for t in self.encoder.model.tokenize(letters)])


class _Words(_Memo):
    def ids(self, word: str) -> bytes:
        return _packed(self.encoder.tokenizer.encode(word, add_special_tokens=False).ids)


@functools.cache
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


def _groups(batch: pa.RecordBatch, chars: int = 1 << 20) -> Iterator[tuple[list, list[str | None]]]:
    """Documents a few megabytes at a time."""
    ids, held, size = [], [], 0
    for doc, text in zip(texts(batch["doc_id"]), texts(batch["text"])):
        ids.append(doc)
        held.append(text)
        size += len(text or "")
        if size >= chars:
            yield ids, held
            ids, held, size = [], [], 0
    if ids:
        yield ids, held


def write(docs: DataFrame, path: str, vocabulary: str, stripe_bytes: int = 16 << 20, stride: int = 1000) -> None:
    """Write doc_id, first (tokens before it in its file), n_tokens and ids, ascending by doc_id over all files.

    Texts are range partitioned by doc_id, so a file is one range, no key is
    hot, and a document's place follows from its file's total. Integers are run
    length encoded by the format; row indexes and a Bloom filter on doc_id are
    written for each ``stride`` rows, so a reader skips stripes and row groups.

    A null text is empty and gets the end id alone. Null doc_ids come first.
    Rows alike in doc_id are ordered by text. No rows give no documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = load(vocabulary), 0
        for batch in batches:
            for ids, held in _groups(batch):
                found = [encoder.encode(text) for text in held]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)])
                flat = np.frombuffer(b"".join(found), "<i4")
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(ends[:-1] + before, pa.int64()),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
                ], names=["doc_id", "first", "n_tokens", "ids"])
                before += int(ends[-1])

    spark = docs.sparkSession
    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "text") \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    held = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        ordered.mapInArrow(run, "doc_id long, first long, n_tokens long, ids array<int>").write \
            .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01") \
            .option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", stride) \
            .option("compression", "zstd").orc(path)
    finally:
        spark.conf.set(CLEANUP, held)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids; a filter on doc_id skips files, stripes and row groups.

    ``start`` counts the tokens of all documents before: those of earlier files,
    one row a file, and those before it in its own. The table of files is
    written, so that its size decides how it is joined and ids are not shuffled.
    """
    rows = spark.read.schema("doc_id long, first long, n_tokens long, ids array<int>").orc(path) \
        .withColumn("file", F.col("_metadata.file_path"))
    files = rows.groupBy("file").agg(F.min("doc_id").alias("lowest"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy(F.asc_nulls_first("lowest")).rowsBetween(Window.unboundedPreceding, -1)
    files = written(files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")), "file-starts")
    return rows.join(files, "file").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            ends = lists.offsets.to_numpy().astype(np.int64) * 4
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield batch.drop_columns(["ids"]).append_column("ids_crc32", pa.array(sums, pa.int64()))

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
