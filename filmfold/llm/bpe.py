"""Byte-level BPE as a streaming transducer, and the state machine that decodes it."""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from filmfold.llm.common import long_lists, texts

#: The public split of byte-level BPE into pieces; merges never cross a piece.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A single space between two words always starts a piece, whatever stands further on.
CUT = regex.compile(r"(?<=\S) (?=\S)")
#: Characters read at once, bytes of a piece merged as a whole, bytes fed to the transducer at once.
WINDOW, WHOLE, FEED = 1 << 16, 256, 4096
#: Pieces remembered by one worker; tokens sent on at once.
MEMO, OUT = 400_000, 1 << 20


_NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[bytes]) -> int:
    """Bytes after a place beyond which no text can change the tokens before it.

    A merge can be undone from the right only through an earlier merge of the
    list that touches its last byte, which in turn hangs on a still earlier one,
    and so on. The longest such chain, each link reaching its length less one to
    the left, is a bound for any text. ``merges``: the bytes each merge makes,
    in the order of the list.
    """
    reach = [0] * 256  # by byte: the longest chain through a merge that holds the byte
    longest = 0
    for made in merges:
        here = len(made) - 1 + reach[made[-1]]
        longest = max(longest, here)
        for byte in set(made):
            reach[byte] = max(reach[byte], here)
    return longest + 1


class Bpe:
    """A vocabulary with its merges, from the JSON file of a public byte-level tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.id_of = {self.bytes_of[i]: i for i in vocab.values()}
        self.rank_of: dict[int, int] = {}  # by both ids in one number
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank_of[vocab[left] << 20 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.longest = max(map(len, self.id_of))
        self.lookahead = sufficient_lookahead([self.bytes_of[i] for i in self.made])
        self.names = [str(i) for i in range(max(self.bytes_of) + 1)]
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def merge(self, data: bytes) -> list[int]:
        """All merges of a short piece, lowest rank first, leftmost first. ``ranks`` has one entry for each pair of
        neighbours; a merge changes two of them."""
        ids = [self.single[b] for b in data]
        rank, made = self.rank_of.get, self.made
        ranks = [rank(left << 20 | right, _NONE) for left, right in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], _NONE)
        return ids

    def follows(self, left: int, right: int) -> bool:
        """Two tokens can stand side by side if their joint bytes are merged to just these two."""
        key = (left, right)
        if key not in self.fits:
            if len(self.fits) > MEMO:
                self.fits.clear()
            self.fits[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return self.fits[key]

    def piece(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= WHOLE:
            return tuple(self.merge(data))
        machine = Transducer(self)
        parts = [machine.feed(data[i:i + FEED]) for i in range(0, len(data), FEED)]
        return tuple(chain(*parts, machine.finish()))

    def stream(self, text: str) -> Iterator[list[int]]:
        """Token ids window by window; windows end where a piece surely starts."""
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                yield [self.special[part]]
                continue
            start = 0
            while start < len(part):
                cut = CUT.search(part, start + WINDOW)
                end = cut.start() if cut else len(part)
                pieces = PIECES.findall(part, start, end) if end == len(part) else PIECES.findall(part[start:end])
                yield list(chain.from_iterable(map(self.memo.__getitem__, pieces)))
                start = end
            if len(self.memo) > MEMO:
                self.memo.clear()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.stream(text)))

    def decode(self, ids: Iterable[int]) -> str:
        machine = Decoder(self)
        return machine.feed(ids) + machine.finish()


class _Memo(dict):
    """Ids of pieces met before."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.bpe.piece(piece.encode())
        if len(piece) <= 64:
            self[piece] = found
        return found


class Transducer:
    """Reads the bytes of one piece of any length and gives out tokens once no further byte can change them.

    The state holds, for each byte not yet settled, the last token of the text
    up to there: the only token that ends there and may follow the one before
    it. Every longer text goes on from one of the last ``longest`` places, so
    where the paths back from these places have met, tokens are settled. They
    meet within the lookahead of the merge list, which bounds the state.
    """

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.before: int | None = None  # the token before the unsettled bytes
        self.data = b""
        self.ending: list[int] = [-1]  # by place: the last token of the text up to there

    def _may_start(self, place: int, token: int) -> bool:
        left = self.ending[place] if place else self.before
        if left is None:
            return self.bpe.merge(self.bpe.bytes_of[token]) == [token]
        return left != -1 and self.bpe.follows(left, token)

    def feed(self, more: bytes) -> list[int]:
        self.data += more
        for end in range(len(self.ending), len(self.data) + 1):
            for size in range(min(end, self.bpe.longest), 0, -1):
                token = self.bpe.id_of.get(self.data[end - size:end])
                if token is not None and self._may_start(end - size, token):
                    break
            self.ending.append(token)
        return self._settle(self._met())

    def finish(self) -> list[int]:
        return self._settle(len(self.data))

    def _path(self, place: int) -> Iterator[int]:
        while place > 0:
            yield place
            place -= len(self.bpe.bytes_of[self.ending[place]])
        yield 0

    def _met(self) -> int:
        """The last place that the ways back from all recent places have in common."""
        last = len(self.data)
        common = set(self._path(last))
        for place in range(max(0, last - self.bpe.longest + 1), last):
            common &= set(self._path(place))
        met = max(common)
        if last - met > self.bpe.lookahead + self.bpe.longest:
            raise RuntimeError("more bytes are open than the lookahead of the merge list allows")
        return met

    def _settle(self, place: int) -> list[int]:
        out = []
        for end in self._path(place):
            if end:
                out.append(self.ending[end])
        out.reverse()
        if out:
            self.before = out[-1]
        self.data, self.ending = self.data[place:], [-1, *self.ending[place + 1:]]
        return out


class Decoder:
    """Ids in, text out; a character whose bytes are spread over tokens waits in the state (three bytes at most)."""

    def __init__(self, bpe: Bpe):
        self.table = bpe.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@functools.cache
def load(path: str) -> Bpe:
    """One vocabulary per worker process."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, keep: Iterable[str] = ()) -> DataFrame:
    """doc_id, the columns to keep, and ``ids``, the tokens of each whole text. A null text has none."""
    keep = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            found: list[np.ndarray] = []
            first = size = 0
            for row, text in enumerate(texts(batch["text"]), 1):
                found.append(np.fromiter(chain.from_iterable(bpe.stream(text or "")), np.int32))
                size += len(found[-1])
                if size >= OUT or row == batch.num_rows:
                    ids = long_lists(found)
                    yield batch.slice(first, row - first).select(keep).append_column("ids", ids)
                    found, first, size = [], row, 0

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` of rows with ids. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            found = [bpe.decode(ids or []) for ids in texts(batch["ids"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded in one stream.

    Ids are hashed as decimals joined by commas and decoded as they come, so a
    document of any length needs the memory of one window beside its text. A
    null text counts as empty. Repeated rows give repeated results; other
    columns are ignored; no rows give none. Every row is its task's own matter:
    no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = [_digests(bpe, text or "") for text in texts(batch["text"])]
            counts, ids, decoded = (list(x) for x in zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digests(bpe: Bpe, text: str) -> tuple[int, str, str]:
    ids_hash, text_hash, machine, count = hashlib.sha256(), hashlib.sha256(), Decoder(bpe), 0
    for ids in bpe.stream(text):
        if ids:
            joined = ",".join(map(bpe.names.__getitem__, ids))
            ids_hash.update(("," + joined if count else joined).encode())
            count += len(ids)
            text_hash.update(machine.feed(ids).encode())
    text_hash.update(machine.finish().encode())
    return count, ids_hash.hexdigest(), text_hash.hexdigest()
