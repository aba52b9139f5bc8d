"""Fingerprints and edits against a Merkle tree in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
import regex

from filmfold.llm import merkle

ENDS = regex.compile(merkle._PIECE_END.replace(r"\z", r"\Z"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _pieces(line: str) -> list[str]:
    out, last = [], 0
    for found in ENDS.finditer(line):
        out.append(line[last:found.start()])
        last = found.end()
    return out + [line[last:]]


def _tree(text: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """Root digest and (section branch, its leaves) of a text."""
    leaves = [[hashlib.sha256(p.encode("latin-1")).hexdigest() for p in _pieces(line)]
              for line in text.encode().decode("latin-1").split("\n")]
    sections: list[list[int]] = []
    nodes = [_sha(",".join(found)) for found in leaves]
    for i, node in enumerate(nodes):
        if i == 0 or node[0] in "01":
            sections.append([])
        sections[-1].append(i)
    digests = [_sha("|".join(nodes[i] for i in section)) for section in sections]
    branches = []
    for digest, section in zip(digests, sections):
        shown = "|".join(nodes[i][:8] + "=" + ",".join(leaf[:8] for leaf in leaves[i]) for i in section)
        branches.append((f"{digest[:8]}:{shown}", [leaf[:8] for i in section for leaf in leaves[i]]))
    return _sha(";".join(digests)), branches


def _print(text: str) -> str:
    root, branches = _tree(text)
    return root + "/" + ";".join(b for b, _ in branches)


def _likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    left, right = dict(_tree(a)[1]), dict(_tree(b)[1])
    same = {leaf for branch in left if branch in right for leaf in left[branch]}
    one = {leaf for branch in left if branch not in right for leaf in left[branch]}
    two = {leaf for branch in right if branch not in left for leaf in right[branch]}
    return 2 * (len(same) + len(one & two)) / (2 * len(same) + len(one) + len(two))


def _brute(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    ids = sorted({d for d, _ in rows if d is not None})
    texts: dict[int | None, list[str]] = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t or "")
    out = []
    for d, t in rows:
        t = t or ""
        if d is None:
            after = ids[0] if ids else None
        else:
            after = ids[(ids.index(d) + 1) % len(ids)]
        most = max(len(x) // 4 for x in texts[d])
        head, follower = min((x[:most], _print(x), x) for x in texts[after])[0::2]
        k = len(t) // 4
        edited = t[:len(t) - k] + head[:k]
        out.append((d, len(t), _sha(edited), _print(t), _print(edited), _likeness(t, edited), _likeness(t, follower)))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def _text(rng: random.Random) -> str:
    words = ["one", "two.", "three,", "天地玄黄", "猫である。", "дом", "", "x" * 40, "five\nsix", "end!\n", "7"]
    return " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 300])))


@pytest.mark.parametrize("share", [100_000, 7])
@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_edits_against_plain_python(spark, share, threshold):
    rng = random.Random(share)
    rows = [(i * 3, _text(rng)) for i in range(60)] + [(30, _text(rng)) for _ in range(40)]
    rows += [(None, _text(rng)) for _ in range(30)] + [(9, None), (-5, "long " * 4000), (33, "same")] + [(33, "same")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 AS key", "2 AS salt")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = sorted((tuple(r) for r in merkle.edited_pairs(docs, share).collect()), key=lambda r: (r[0] is not None, r))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = _brute(rows)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert [r[5:] for r in got] == [pytest.approx(r[5:]) for r in expected]


def test_null_ids_alone_are_their_own_next(spark):
    docs = spark.createDataFrame([(None, "a text, in two"), (None, "a text, in two")], "doc_id long, text string")
    assert [(r.doc_id, r.near_next) for r in merkle.edited_pairs(docs).collect()] == [(None, 1.0)] * 2
