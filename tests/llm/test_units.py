"""The operators' parts that need no Spark, against plain versions."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from filmfold.llm import bpe, buckets, exact_dedup, htmltext, line_dedup, ngram_join, pii, token_files, toxicity
from filmfold.llm.common import folded, parity_bitmap, wide_bits

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "'", "'s", "'ll", "é", "ñ", "1", "22", "!", "...", "<|endoftext|>",
         "　", "漢", "🎉", "--", "\x1c", "\x85", "́", "Σ", "X" * 300]
texts = st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_bpe_equals_the_library(library, text):
    machine, ids = bpe.load(BYTES), library[0].encode(text, add_special_tokens=False).ids
    assert machine.encode(text) == ids
    assert machine.decode(ids) == library[0].decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("piece", ["a" * 9000, "ab" * 4000, "-" * 7000, "あ漢" * 1500, " " * 5000 + "x",
                                   "".join(random.Random(4).choice(["the", "ing", "re", "q"]) for _ in range(3000))])
def test_long_pieces_are_streamed(library, piece):
    machine = bpe.load(BYTES)
    assert machine.encode(piece) == library[0].encode(piece, add_special_tokens=False).ids
    state = bpe.Transducer(machine)
    for i in range(0, len(piece.encode()), 500):
        state.feed(piece.encode()[i:i + 500])
        assert len(state.data) < 500 + machine.lookahead + machine.longest
    assert len(state.data) < 2000  # what is settled is gone


def test_lookahead_of_a_small_list():
    assert bpe.sufficient_lookahead([]) == 1
    assert bpe.sufficient_lookahead([b"ab"]) == 2
    assert bpe.sufficient_lookahead([b"bc", b"ab"]) == 3  # bc first, then ab hangs on whether b is still free


def test_decoder_keeps_split_characters():
    machine = bpe.load(BYTES)
    state, ids = bpe.Decoder(machine), machine.encode("漢🎉")
    assert "".join(state.feed([i]) for i in ids) + state.finish() == "漢🎉"
    assert bpe.Decoder(machine).feed(ids[:1]) == "" and bpe.Decoder(machine).finish() == ""


@settings(max_examples=200, deadline=None)
@given(many=st.lists(texts, max_size=4))
def test_word_encoder_equals_the_library(library, many):
    found = [token_files.load(WORDS).encode(t) for t in [*many, None]]
    for text, ids in zip([*many, ""], found):
        assert np.frombuffer(ids, "<u4").tolist() == library[1].encode(text, add_special_tokens=False).ids + [2]


@settings(max_examples=100, deadline=None)
@given(left=st.binary(max_size=300), middle=st.binary(max_size=50), right=st.binary(max_size=300))
def test_fingerprints_compose(left, middle, right):
    a, b, c = map(exact_dedup.fingerprint, (left, middle, right))
    whole = exact_dedup.fingerprint(left + middle + right)
    assert exact_dedup.combine(exact_dedup.combine(a, b), c) == whole == exact_dedup.combine(a, exact_dedup.combine(b, c))


def test_fingerprint_of_many_chunks():
    data = random.Random(1).randbytes(3 * exact_dedup.CHUNK + 17)
    value = [0, 0]
    for byte in data:
        value = [(v * b + byte) % p for v, b, p in zip(value, exact_dedup.BASES, exact_dedup.PRIMES)]
    assert exact_dedup.fingerprint(data).values == tuple(value)
    other = bytearray(data)
    other[-1] ^= 1
    assert exact_dedup.same(data, bytes(data)) and not exact_dedup.same(data, bytes(other))


def test_a_collision_is_told_apart_by_comparing():
    rows = pa.RecordBatch.from_pydict({
        "print": pa.array([5, 5, 5, 6], pa.int64()), "n_bytes": pa.array([1, 1, 1, 1], pa.int64()),
        "text_sha256": ["a", "a", "b", "c"], "data": pa.array([b"x", b"x", b"y", b"x"], pa.binary())})
    assert [n for b in exact_dedup._number_texts(iter([rows.slice(0, 1), rows.slice(1)])) for n in b["number"].to_pylist()] \
        == [0, 0, 1, 0]


def _plain_spans(text):
    rules = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, rule in rules.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(pii.Span(kind, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(text=st.lists(st.sampled_from(["a", "b.", "@", "-", "x.com", ".", "1", "22", "255", "256", "0", "+", "(", ")", " ",
                                      "4111111111111111", "é", "٣", "_", "%", "4111 1111-1111 1111", "\n"])).map("".join))
def test_rules_equal_plain_patterns(text):
    assert pii.base_spans(text) == _plain_spans(text)


def test_rules_on_long_runs_are_quick():
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@" * 1000) == []


def test_neighbours_the_rules_miss_are_candidates():
    text = "call +1 (269) 555-3296 4524132264652876 now"
    assert pii.base_spans(text) == []
    found = {(s.kind, text[s.start:s.end]) for s in pii.candidates(text, [])}
    assert {("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")} <= found


def test_candidates_of_a_long_text_are_apart():
    text = " ".join(f"mail{i}@example.org +1 555 {i:07d}" for i in range(20_000))
    found = sorted(pii.candidates(text, pii.base_spans(text)), key=lambda s: s.start)
    assert len(found) >= 40_000 and all(x.end <= y.start for x, y in zip(found, found[1:]))


def test_reliabilities_find_the_careless_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    votes = np.column_stack([np.where(rng.random(4000) < right, truth, ~truth) for right in (0.95, 0.9, 0.85, 0.5)]).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    table, posterior = pii.reliabilities(patterns, counts.astype(float))
    accuracy = (table[:, 1, 1] + table[:, 0, 0]) / 2
    assert accuracy[0] > accuracy[2] > accuracy[3] and abs(accuracy[3] - 0.5) < 0.1
    by_pattern = {tuple(p): q for p, q in zip(patterns, posterior)}
    assert np.mean([(by_pattern[tuple(v)] > 0.5) == t for v, t in zip(votes, truth)]) > 0.94


def test_risk_gradient_is_a_derivative():
    rng = np.random.default_rng(1)
    scores, positive = rng.normal(size=30), np.arange(30) < 10

    def risk(s):
        unlabelled = np.logaddexp(0, s[~positive]).mean() - 0.2 * np.logaddexp(0, s[positive]).mean()
        return 0.2 * np.logaddexp(0, -s[positive]).mean() + unlabelled

    slope = toxicity.risk_gradient(scores, positive, 0.2)
    for i in (0, 5, 15, 29):
        step = np.eye(30)[i] * 1e-6
        assert slope[i] == pytest.approx((risk(scores + step) - risk(scores - step)) / 2e-6, abs=1e-6)
    low = np.where(positive, 5.0, -9.0)  # the unlabelled fit too well: the step goes back
    assert (toxicity.risk_gradient(low, positive, 0.5)[~positive] < 0).all()


def test_learning_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    toxic = rng.random(3000) < 0.15
    rows = [np.unique(np.append(rng.integers(1, 40, 6), [0] if t else [])).astype(np.int64) for t in toxic]
    known = toxic & (rng.random(3000) < 0.5)
    sample = [rows[i] for i in np.flatnonzero(known)] + rows
    positive = np.arange(len(sample)) < known.sum()
    weights, bias = toxicity.fit(sample, positive, 40, 0.15)
    scores = np.array([weights[r].sum() + bias for r in rows])
    assert ((1 / (1 + np.exp(-scores)) >= 0.3) == toxic).mean() > 0.98


def test_hierarchy_is_never_contradicted():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        parent = [-1, *(int(rng.integers(0, i)) for i in range(1, n))]
        score, size = rng.normal(size=n) * 3, rng.integers(0, 200, n).astype(float)
        keep = htmltext.decode(parent, score, size)
        assert all(keep[parent[i]] for i in range(1, n) if keep[i])
        weight = 0.05 + np.log1p(size)

        def worth(k):
            return sum(weight[i] * -np.logaddexp(0, -score[i] if k[i] else score[i]) for i in range(1, n))

        best = max((worth(k) for m in range(2 ** (n - 1)) for k in [[True, *(bool(m >> i & 1) for i in range(n - 1))]]
                    if all(k[parent[i]] for i in range(1, n) if k[i])), default=0)
        assert worth(keep) == pytest.approx(best)


def test_odd_markup_is_read():
    page = htmltext.parse("<p>a<b>b<p>c</i></div>&lt;<br>d<script>var t='</p>';</script><td title='x>y'>e<!-- f")
    assert [t for _, t in page.pieces if t.strip()] == ["a", "b", "c", "<", "d", "e"]
    for source in ("", "<", "<p", "<a href=\"x", "<!--", "</p>", "<script>", "<p/><br/>", "<" * 5000):
        assert htmltext.features(htmltext.parse(source)).shape[1] == len(htmltext.FEATURES)


def _trees(pages):
    x, y = htmltext.training_rows(pages)
    assert 0 < y.mean() < 1
    return htmltext.boost(x, y)


def _article(i: int, opener: str, closer: str) -> str:
    body = "".join(f"<p>Sentence {i} of part {k}, long enough to say that rivers, hills and towns of the region "
                   f"were visited by many people in the year {1900 + k}.</p>" for k in range(4))
    return (f"<html><body><nav class=menu><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav>"
            f"{opener}{body}{closer}<footer class=footer>All rights reserved</footer></body></html>")


def test_nothing_of_an_article_is_dropped_unasked():
    trees = _trees([r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])
                    .slice(0, 120).to_pylist()])
    cases = {
        "<html><body><article><p>Let <math><mi>x</mi></math> be 3 in this sentence, and go on.</p></article></body></html>":
            "Let x be 3 in this sentence, and go on.",
        "<p>One sentence of some length, said here.</p><svg><p>Two sentences of some length, said there.":
            "One sentence of some length, said here. Two sentences of some length, said there.",
        "Loose article text, of some length, that goes on for a while<br>and more of it, too.<div class=footer>foot</div>":
            "Loose article text, of some length, that goes on for a while and more of it, too.",
        "only text & no block": "only text & no block",
        "": "",
    }
    assert dict(zip(cases, htmltext.main_texts(list(cases), trees))) == cases
    page = htmltext.parse("<p>a<svg/>b <button>c</button> d</p>")
    assert [t for n, t in page.pieces if n == 1] == ["a", "b ", " d"]


def test_pages_that_mark_no_article():
    """Neither the sample nor the pages have the element, by which a pattern would find it."""
    plain = [_article(i, "<div>", "</div>") for i in range(40)]
    for trees in (_trees(plain), _trees([_article(i, "<article>", "</article>") for i in range(40)])):
        for source, text in zip(plain, htmltext.main_texts(plain, trees)):
            assert "All rights" not in text and "About" not in text
            assert text.count("were visited by many people") == 4


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = htmltext.boost(x[:2000], y[:2000])
    assert ((htmltext.predict(trees, x[2000:]) > 0) == (y[2000:] > 0.5)).mean() > 0.97


def test_signatures_do_not_depend_on_neighbours():
    lines = ["".join(random.Random(i).choices("abcdef ", k=30 + i)) for i in range(40)]
    together = line_dedup.signatures(lines)
    for i in (0, 7, 39):
        assert (line_dedup.signatures([lines[i]])[0] == together[i]).all()


def test_bands_meet_at_the_threshold():
    rng, met, n = random.Random(6), 0, 0
    while n < 150:
        a = "".join(rng.choices("abcdefghijkl ", k=200))
        b = list(a)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(200)] = "z"
        b = "".join(b)
        x, y = line_dedup.shingles(a), line_dedup.shingles(b)
        common = np.intersect1d(x, y).size
        if common / (len(x) + len(y) - common) >= 0.75:
            n += 1
            met += (line_dedup.signatures([a, b])[0] == line_dedup.signatures([a, b])[1]).any()
    assert met / n > 0.97


def test_isolated_pairs_just_above_the_threshold_meet():
    rng, pairs = random.Random(16), []
    while len(pairs) < 1500:
        a = "".join(rng.choices("abcdefghijkl ", k=200))
        b = list(a)
        for at in rng.sample(range(200), 4):
            b[at] = "z"
        b = "".join(b)
        x, y = line_dedup.shingles(a), line_dedup.shingles(b)
        common = np.intersect1d(x, y).size
        if 0.75 <= common / (len(x) + len(y) - common) < 0.80:
            pairs += [a, b]
    keys = line_dedup.signatures(pairs).reshape(-1, 2, line_dedup.BANDS)
    assert (keys[:, 0] == keys[:, 1]).any(1).mean() > 0.98


def test_similar_sets_share_a_prefix():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.88], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)]))
        common = np.intersect1d(a, b).size
        listed = np.sort(rng.choice(a, len(a) // 2, replace=False))
        if len(b) and 100 * common >= 75 * (len(a) + len(b) - common):
            for order in (np.empty(0, np.uint64), listed):
                assert np.intersect1d(ngram_join.prefix(a, order), ngram_join.prefix(b, order)).size
        wide = [np.frombuffer(parity_bitmap(s, bits), np.uint64) for s in (a, b) for bits in (4096,)]
        small = [folded(w, 16) for w in wide]
        assert (small[0] == np.frombuffer(parity_bitmap(a, 1024), np.uint64)).all()
        for x, y in (wide, small):  # the bound holds at any width
            assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * common


def test_tiles_give_all_pairs_that_fit():
    rng = np.random.default_rng(8)
    rows = []
    for key in range(30):
        for block, other in ((0, 0), (0, 1)):
            for _ in range(int(rng.integers(1, 12))):
                values = rng.integers(0, 2**63, int(rng.integers(1, 50))).astype(np.uint64)
                rows.append((key, block, other, int(rng.integers(block, other + 1)), int(rng.integers(1, 10**6)), len(values),
                             int(rng.integers(0, 4)), parity_bitmap(values, 64)))
    rows.sort(key=lambda r: (r[0], r[1], r[2], r[5], r[4]))
    names = ["key", "block", "other", "of", "id", "n", "grp", "bitmap"]
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    got = {(a, b) for batch in buckets._tile_pairs(75)(iter(table.to_batches(max_chunksize=7)))
           for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())}
    expected = set()
    for i, r in enumerate(rows):
        for s in rows[i + 1:]:
            if r[:3] == s[:3] and r[6] != s[6] and (r[1] == r[2] or r[3] != s[3]) and 100 * r[5] >= 75 * s[5]:
                differ = bin(int.from_bytes(r[7]) ^ int.from_bytes(s[7])).count("1")
                overlap = min((r[5] + s[5] - differ) // 2, r[5], s[5])
                if 100 * overlap >= 75 * (r[5] + s[5] - overlap):
                    expected.add((min(r[4], s[4]), max(r[4], s[4])))
    assert got == expected


def test_tiles_compare_bitmaps_of_different_widths():
    rng = np.random.default_rng(9)
    rows = []
    for key in range(12):
        core = rng.integers(0, 2**63, 300).astype(np.uint64)
        for _ in range(14):
            own = rng.integers(0, 2**63, int(rng.integers(1, 40))).astype(np.uint64)
            values = np.concatenate([core[:int(rng.integers(1, 300))], own])
            rows.append((key, 0, 0, 0, len(rows), len(values), len(rows), parity_bitmap(values, wide_bits(len(values), 64))))
    rows.sort(key=lambda r: (r[0], r[5], r[4]))
    names = ["key", "block", "other", "of", "id", "n", "grp", "bitmap"]
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    got = {(a, b) for batch in buckets._tile_pairs(75)(iter(table.to_batches(max_chunksize=31)))
           for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())}
    expected = set()
    for i, r in enumerate(rows):
        for s in rows[i + 1:]:
            if r[0] == s[0] and 100 * r[5] >= 75 * s[5]:
                x, y = (np.frombuffer(z[7], np.uint64) for z in (r, s))
                width = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
                overlap = min((r[5] + s[5] - differ) // 2, r[5], s[5])
                if 100 * overlap >= 75 * (r[5] + s[5] - overlap):
                    expected.add((min(r[4], s[4]), max(r[4], s[4])))
    assert got == expected and len({len(r[7]) for r in rows}) > 2
