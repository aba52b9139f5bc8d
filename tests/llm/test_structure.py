"""Packing, repair of conversations and the manifest against plain versions of what they do, on given and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filmfold.llm import conversations, manifest, packing, queries

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ["part", "nth", "ids", "length", "digest", "grp", "pos", "n", "block", "copies", "kind", "leaf", "place", "c", "d"]
REPAIR = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def _clashing(df):
    for name in CLASH:
        df = df.withColumn(name, F.lit("other"))
    return df


def _odd_documents(spark):
    long = " ".join(f"Word{i % 977}" for i in range(40_000))
    rows = [(1, None, "en", "x"), (2, "", None, None), (3, "a b", "en", "x"), (3, "a b", "en", "x"), (3, "A b", "en", "y"),
            (None, "No id", "en", "x"), (None, None, None, None), (4, long, "de", "x"), (5, "x" * 100_000, "de", "x"),
            (6, "<|endoftext|> é🎉\r\n\x00z", "zz", "z"), (7, " \n\t" * 5000, "é", "z"), *[(k, "A" * k, "fr", "s") for k in range(10, 90)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return _clashing(df.withColumn("n_chars", F.char_length("text").cast("long")))


# --- packing ------------------------------------------------------------------------------------------------------------

def test_lengths():
    assert packing.lengths(1) == [1] and packing.lengths(1024) == [1024] and packing.lengths(0) == []
    assert packing.lengths(2048 + 13) == [1024, 1024, 8, 4, 1]
    assert all(sum(packing.lengths(n, 16)) == n for n in range(200))


def _check_pieces(pieces, docs, size):
    library = Tokenizer.from_file(BYTES)
    library.no_truncation()
    expected, got = defaultdict(int), defaultdict(int)
    for doc_id, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [packing.END], "<u4")
        at = 0
        for n in packing.lengths(len(ids), size):
            expected[doc_id, at, n, zlib.crc32(ids[at:at + n].tobytes()), len(ids)] += 1
            at += n
    for p in pieces:
        assert p.offset == 0 and p.length <= size and p.length & (p.length - 1) == 0
        got[p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens] += 1
    assert got == expected
    order = sorted((p.sequence_id, -p.length) for p in pieces)
    assert [s for s, _ in order] == list(range(len(pieces)))  # a sequence holds one piece, none is left out
    assert [n for _, n in order] == sorted(n for _, n in order)  # buckets of equal length stand together


@pytest.mark.parametrize("size", [1024, 8])
def test_packing_of_odd_rows(spark, size):
    docs = _odd_documents(spark).repartition(3)
    pieces = packing.checksums(packing.pack(docs, BYTES, size)).collect()
    _check_pieces(pieces, [(r.doc_id, r.text) for r in docs.collect()], size)


def test_packing_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    _check_pieces(queries.op11_packing(spark, SF).collect(), [(r.doc_id, r.text) for r in docs], 1024)


def test_packing_of_nothing(spark):
    assert packing.checksums(packing.pack(_odd_documents(spark).limit(0), BYTES)).count() == 0


def test_buckets_are_folders(spark):
    packed = packing.pack(_odd_documents(spark), BYTES)
    assert all(len(r.ids) == r.length for r in packed.select("length", "ids").collect())
    folders = {int(f.split("/length=")[1].split("/")[0]) for f in packed.inputFiles() if "/length=" in f}
    assert folders == {r.length for r in packed.select("length").distinct().collect()}


# --- conversations ------------------------------------------------------------------------------------------------------

WHITE = set(" \t\n\x0b\x0c\r")
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def _plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_name, turn_name, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_name}:{turn_name}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.append((conv, turn, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1)))
    return out


def _plain_repair(rows):
    """Every conversation by a search over whole edit strings, cheapest first, then in ASCII order."""
    by_conv = defaultdict(list)
    for conv, turn, role, text, copies in rows:
        by_conv[conv] += [(turn, role, text)] * copies
    found = []
    for conv, here in by_conv.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, marks = set(), []
        for _, role, text in here:
            shown = [c for c in text if c not in WHITE]
            marks.append("blank" if not shown else "duplicate" if (role, text) in seen
                         else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        initials, turns = [r[1][:1] for r in here], [r[0] for r in here if r[0] is not None]
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, state, out = heapq.heappop(heap)
            if i == len(here) and state in (0, 3):
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            for role in ("user", "assistant"):
                if role[0] in NEXT[state]:
                    heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[state][role[0]], (*out, f"{role}:")))
            if i == len(here):
                continue
            _, role, text = here[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if marks[i] in ("", "truncated"):
                more = cost + 3 * (marks[i] == "truncated")
                if role[:1] in NEXT[state]:
                    heapq.heappush(heap, (more, audit + "K", i + 1, NEXT[state][role[:1]], (*out, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    if other[0] in NEXT[state]:
                        heapq.heappush(heap, (more + 3, audit + "R", i + 1, NEXT[state][other[0]], (*out, f"{other}:{text}")))
        found.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                      *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
                      sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                      hashlib.sha256("\n".join(out).encode()).hexdigest()))
    return sorted(found, key=repr)


def _repaired(df):
    return sorted((tuple(r) for r in df.select(*REPAIR).collect()), key=repr)


def test_repair_of_given_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert _repaired(queries.op12_conversations(spark, sf)) == _plain_repair(_plain_damage(map(tuple, rows)))


def test_damage_with_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(6)]), rng.choice([None, *range(20)]), rng.choice([None, "user", "assistant", "system", ""]),
             rng.choice([None, "", "A. b! c?", "x"])) for _ in range(400)]
    df = _clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = conversations.repair(conversations.damaged(df))
    assert _repaired(got) == _plain_repair(_plain_damage(rows))


@pytest.mark.parametrize("length", [512, 7, 1])
def test_repair_in_pieces(spark, length):
    """Long conversations, ties, nulls, repeated rows and rows that are gone, whatever the length of a piece."""
    rng, rows = random.Random(5), []
    for _ in range(1500):
        rows.append((rng.choice([None, *range(9)]), rng.choice([None, *range(12)]),
                     rng.choice(["system", "user", "assistant", "tool", "", " "]),
                     rng.choice(["Yes.", "no", "  \n", "", "Go!", "Yes.  ", "wait?", " ", "a. b"]), rng.choice([0, 1, 1, 1, 1, 2, 3])))
    for conv in range(100, 150):
        rows += [(conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]),
                  rng.choice(["A.", "b", f"{turn}.", " ", f"{turn}"]), 1) for turn in range(rng.randrange(1, 9))]
    rows += [(200, turn, ("user", "assistant")[turn % 2], f"row {turn}.", 1) for turn in range(1300)]
    rows += [(201, 0, "user", "again.", 1)] * 40 + [(201, 1, "assistant", "x" * 200_000, 1), (202, 5, "user", "gone", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long").repartition(5)
    assert _repaired(conversations.repair(df, length)) == _plain_repair(rows)


def test_nothing_to_repair(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damaged(empty)).count() == 0


def test_nodes_are_shared():
    """A signature that ends like the one before adds only the nodes in front of the common end."""
    machine = conversations.Automaton(conversations.END)
    first = list(machine.solve("auas"))
    second = list(machine.solve("auau"))
    assert all(a is b for a, b in zip(first[:4], second[:4])) and first[4] is not second[4]
    assert conversations.audit(second, conversations.START) == ("KKKK", conversations.ANSWER)


# --- manifest -----------------------------------------------------------------------------------------------------------

def _sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain_leaf(row):
    return _sha("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in manifest.FIELDS)


def _plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_sha(levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def _plain_path(levels, i):
    for low in levels[:-1]:
        first = i // 8 * 8
        yield low[first:i], low[i + 1:first + 8]
        i //= 8


def _plain_manifest(rows):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row["lang"]].append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _plain_leaf(r)))
    trees = [_plain_tree([_plain_leaf(r) for r in by_lang[lang]]) for lang in langs]
    top, found = _plain_tree([t[-1][0] for t in trees]), []
    for k, lang in enumerate(langs):
        for i, row in enumerate(by_lang[lang]):
            steps = [*_plain_path(trees[k], i), *_plain_path(top, k)]
            other = dict(row)
            if None not in (row["doc_id"], row["text"]) and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                other["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])
            digest = _plain_leaf(other)
            for left, right in steps:
                digest = _sha([*left, digest, *right])
            found.append((row["doc_id"], _plain_leaf(row), trees[k][-1][0], top[-1][0],
                          _sha(x for a, b in steps for x in a + b), digest, digest == top[-1][0]))
    return sorted(found, key=repr)


def _manifest(docs):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in manifest.manifest(docs).select(*columns).collect()), key=repr)


def test_manifest_of_odd_rows(spark):
    docs = _odd_documents(spark).repartition(4)
    found = _manifest(docs)
    assert found == _plain_manifest([r.asDict() for r in docs.collect()])
    assert any(not r[-1] for r in found)


def test_manifest_over_several_tiers(spark):
    """More leaves than a superblock's square would need three tiers; here two, and many languages of a row or two."""
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 4400, F.lit("en")).otherwise(F.concat(F.lit("l"), F.col("id") % 590)).alias("lang"),
        F.lit("s").alias("source"), F.col("id").alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text"))
    assert _manifest(docs) == _plain_manifest([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("rows", [0, 1, 8, 9])
def test_small_manifests(spark, rows):
    docs = spark.createDataFrame([(i, "x", "en", 1, "T") for i in range(rows)],
                                 "doc_id long, source string, lang string, n_chars long, text string")
    assert _manifest(docs) == _plain_manifest([r.asDict() for r in docs.collect()])


def test_ids_beyond_the_exact_doubles(spark):
    docs = spark.createDataFrame([(2 ** 62 + 1, None, None, None, "a"), (None, None, None, None, "b")],
                                 "doc_id long, source string, lang string, n_chars long, text string")
    assert {r[0] for r in _manifest(docs)} == {2 ** 62 + 1, None}
