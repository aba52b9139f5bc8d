"""The operators on small tables: odd rows, empty tables, clashing columns, and plain versions of what they do."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filmfold.llm import (
    bpe, exact_dedup, htmltext, line_dedup, merkle, mixing, ngram_join, pii, token_files, toxicity,
)
from filmfold.llm.components import components, extended
from filmfold.session import scratch_path

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
LINE = "a line of some length that stands in more than one text of the table"
#: Columns that the operators use inside, too.
CLASH = ["id", "n", "key", "part", "node", "component", "size", "weight", "score", "file", "ids", "gone", "of", "times", "copy"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "a b", "x"), (4, "a b", "y"), (5, LONG, "x"), (6, LONG + " end", None),
            (7, f"{LINE}\nown words here", "x"), (8, f"short\n{LINE}!", "y"), (8, f"short\n{LINE}!", "y"), (9, "\n \t\n", "x"),
            (10, "<|endoftext|> é🎉\r\n\x00z", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in CLASH:
        docs = docs.withColumn(name, F.lit("other"))
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("lang", F.lit("en")), rows


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(120)] + [(500, i) for i in range(600, 640)] + \
        [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(-5, 2**62)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(_rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_components_grow_by_new_links(spark):
    old = spark.createDataFrame([(5, 3), (9, 8), (20, 21)], "a long, b long")
    new = spark.createDataFrame([(9, 5), (40, 41), (41, 2), (21, 50)], "a long, b long")
    groups = components(old)
    grown = {r["node"]: r["component"] for r in extended(groups, new).collect()}
    assert grown == {r["node"]: r["component"] for r in components(old.union(new)).collect()}
    assert extended(groups, new.limit(0)).count() == groups.count()


def test_bpe_round_trip(spark, odd):
    docs, rows = odd
    library = Tokenizer.from_file(BYTES)
    expected = []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc, len(ids), _sha(",".join(map(str, ids))), _sha(decoded)))
    got = bpe.round_trip(docs, BYTES)
    assert _rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    back = bpe.decode(bpe.encode(docs, BYTES), BYTES)
    assert _rows(back, "doc_id", "text") == sorted(((d, t or "") for d, t, _ in rows), key=repr)
    assert bpe.round_trip(docs.limit(0), BYTES).count() == 0 and bpe.encode(docs.limit(0), BYTES).count() == 0


def test_token_files(spark, odd):
    docs, rows = odd
    path = scratch_path(spark, "tokens")
    token_files.write(docs.repartition(3), path, WORDS)
    library, start, expected = Tokenizer.from_file(WORDS), 0, []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.checksums(token_files.read(spark, path))
    assert _rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
    one = token_files.read(spark, path).filter("doc_id = 4")
    assert [r.n_tokens for r in one.collect()] == [3]
    empty = scratch_path(spark, "tokens")
    token_files.write(docs.limit(0), empty, WORDS)
    assert token_files.read(spark, empty).count() == 0


def test_exact_duplicates(spark, odd):
    docs, rows = odd
    groups = defaultdict(list)
    for doc, text, _ in rows:
        groups[text or ""].append(doc)
    expected = [(d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), _sha(t or "")) for d, t, _ in rows]
    got = exact_dedup.duplicates(docs)
    assert _rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(expected, key=repr)
    kept = exact_dedup.keep_last(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 4, 5, 6, 7, 8, 9, 10}
    assert exact_dedup.duplicates(docs.limit(0)).count() == 0


def _shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def _classes(sets, percent=75):
    """Components of the links between sets, by plain comparison of all pairs."""
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def _near_texts(n, seed):
    """Texts in groups of near copies of all sizes, with a passage that many hold."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    out = []
    while len(out) < n:
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 8, 40, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            words = [w if rng.random() > 0.02 else f"e{rng.randrange(4000)}" for w in base]
            out.append(" ".join(words) + (" " + passage if rng.random() < 0.3 else ""))
    return out[:n]


def test_near_documents(spark, odd):
    docs, rows = odd
    sets = {d: _shingle_set(t) for d, t, _ in rows}
    classes = _classes(sets)
    got = ngram_join.near_documents(docs)
    assert _rows(got, "doc_id", "n_shingles", "component_id") == sorted(
        ((d, len(sets[d]), classes[d]) for d, _, _ in rows), key=repr)
    assert ngram_join.one_per_group(docs).columns == docs.columns
    assert ngram_join.near_documents(docs.limit(0)).count() == 0


def test_near_documents_against_all_pairs(spark, monkeypatch):
    from filmfold.llm import buckets

    monkeypatch.setattr(buckets, "BLOCK", 8)  # many tiles
    monkeypatch.setattr(ngram_join, "ORDER_LEAST", 30)
    texts = _near_texts(420, 5)
    sets = {i: _shingle_set(t) for i, t in enumerate(texts)}
    classes = _classes(sets)
    assert len(set(classes.values())) < 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = ngram_join.near_documents(docs)
    assert _rows(got, "doc_id", "n_shingles", "component_id") == sorted(
        ((d, len(sets[d]), classes[d]) for d in sets), key=repr)


def test_long_texts_that_share_a_passage_are_no_candidates(spark, monkeypatch):
    """Tiles tell long sets apart, and buckets that hold the same texts are compared once."""
    from filmfold.llm import buckets

    monkeypatch.setattr(ngram_join, "ORDER_LEAST", 30)  # so that the passage is no common one
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(d, " ".join(f"w{d}-{i}" for i in range(2500 + 10 * d)) + " " + passage) for d in range(12)]
    found, held, tiles = [], [], buckets.cross_pairs

    def kept(members, *rest):
        held.append(members)
        found.append(tiles(members, *rest))
        return found[-1]

    monkeypatch.setattr(buckets, "cross_pairs", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.near_documents(docs).filter("component_id <> doc_id").count() == 0
    assert held[0].count() > 1 and found[0].count() == 0
    buckets_of = held[0].groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids")
    assert buckets_of.count() == buckets_of.distinct().count()


def test_one_of_equal_buckets_is_kept(spark):
    from filmfold.llm import buckets

    rows = [(1, 5), (1, 6), (2, 6), (2, 5), (3, 5), (3, 5), (3, 6), (4, 5), (4, 6), (4, 6), (5, 5), (5, 7)]
    kept = buckets.distinct_buckets(spark.createDataFrame(rows, "key long, id long"))
    assert sorted(tuple(r) for r in kept.collect()) == sorted(r for r in rows if r[0] != 2)


def _plain_lines(rows):
    """What line removal leaves of (doc_id, text), by plain comparison of all lines."""
    places = sorted({(d, i, line_dedup.normal(x)) for d, t in rows for i, x in enumerate((t or "").split("\n"))
                     if len(line_dedup.normal(x)) >= line_dedup.LEAST_CHARS})
    distinct = {x: i for i, x in enumerate(sorted({x for _, _, x in places}))}
    k = line_dedup.SHINGLE
    classes = _classes({i: {x[j:j + k] for j in range(len(x) - k + 1)} for x, i in distinct.items()})
    first = {}
    for d, i, x in places:
        first.setdefault(classes[distinct[x]], (d, i))
    gone = {(d, i) for d, i, x in places if first[classes[distinct[x]]] != (d, i)}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) if t is not None else None
            for d, t in rows}


def test_line_removal(spark, odd):
    docs, rows = odd
    left = _plain_lines([(d, t) for d, t, _ in rows])
    assert left[8] == "short" and left[7].startswith(LINE)
    got = line_dedup.without_repeated_lines(docs)
    assert set(docs.columns) < set(got.columns)
    assert _rows(got, "doc_id", "text", "n_chars") == sorted(
        ((d, left[d], None if left[d] is None else len(left[d])) for d, _, _ in rows), key=repr)
    assert line_dedup.without_repeated_lines(docs.limit(0)).count() == 0


def test_line_removal_against_all_pairs(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnop    "
    base = ["".join(rng.choices(letters, k=rng.randint(20, 150))).strip() for _ in range(60)]

    def near(x):
        at = rng.randrange(len(x))
        return x[:at] + "#" + x[at + 1:] if rng.random() < 0.5 else x

    rows = [(d, "\n".join(near(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for d in range(80)]
    got = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert dict(_rows(got, "doc_id", "text")) == _plain_lines(rows)


def test_short_lines_that_repeat_are_removed(spark):
    """By plain equality and all pairs of shingles, whatever the lengths that the module compares from."""
    short = ["ok", "Share", "read  More", "© 2019 Example Ltd", "这是一个句子。", "これは短い文です。", "転載を禁じます、無断での複製も禁じます", "\U0001f389"]
    rows = [(d, "\n".join([f"{zlib.crc32(bytes([d]))} own", *short[d % 3:], "", " ", f"{d}"])) for d in range(12)]
    got = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    seen, expected = set(), {}
    for d, text in rows:
        left = []
        for line in text.split("\n"):
            name = " ".join(line.lower().split())
            if not name or name not in seen:
                left.append(line)
            seen.add(name)
        expected[d] = "\n".join(left)
    assert dict(_rows(got, "doc_id", "text")) == expected
    near = [(1, "posted on 12 march 2019 at 9"), (2, "posted on 12 march 2019 at 8")]
    assert dict(_rows(line_dedup.without_repeated_lines(spark.createDataFrame(near, "doc_id long, text string")),
                      "doc_id", "text")) == {1: near[0][1], 2: ""}


def test_lines_that_share_an_id_are_told_apart(spark, monkeypatch):
    real = line_dedup.line_id
    monkeypatch.setattr(line_dedup, "line_id", lambda line: (7, real(line)[1]))
    docs = spark.createDataFrame([(1, "the first of all lines\nabc"), (2, "something else is said"), (3, "abc")],
                                 "doc_id long, text string")
    assert [(r["doc_id"], r["place"]) for r in line_dedup.repeated_lines(docs).collect()] == [(3, 0)]


def test_lines_of_rows_that_share_a_doc_id(spark):
    rows = [(1, LINE), (2, f"{LINE}\nfirst text of two"), (2, "something else altogether, which repeats nothing\nsecond")]
    got = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert _rows(got, "doc_id", "text", "lines_dropped") == [
        (1, LINE, 0), (2, "first text of two", 1), (2, rows[2][1], 0)]


def test_lines_first_met_under_a_null_doc_id(spark):
    rows = [(None, f"{LINE}\nmore"), (1, LINE), (2, f"{LINE}!")]
    got = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert _rows(got, "doc_id", "text") == sorted([(None, rows[0][1]), (1, ""), (2, "")], key=repr)


def _plain_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = total - sum(2 * sizes[s] for s in capped)
        level = free / (sum(weights[s] for s in names if s not in capped) or 1)
        target = {s: 2 * sizes[s] if s in capped else level * weights[s] for s in names}
        over = {s for s in names if s not in capped and target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark, odd):
    docs, rows = odd
    rng = random.Random(3)
    many = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["a", "a", "a", "b", "c", "d", None]))
            for i in range(900)]
    table = spark.createDataFrame(many, "doc_id long, text string, source string")
    got = mixing.plan(mixing.sized(table)).collect()
    sizes = Counter()
    for _, text, source in many:
        sizes[source] += len(text.split())
    target, taken = _plain_targets(sizes), Counter()
    assert len(got) == 900
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 15 for s in sizes)  # half the largest document
    again = mixing.plan(mixing.sized(table.repartition(7))).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.times for r in got if r.times})
    assert mixing.plan(mixing.sized(docs)).count() == len(rows) and mixing.mix(docs).columns == docs.columns
    assert mixing.plan(mixing.sized(docs.limit(0))).count() == 0
    assert mixing.plan(mixing.sized(docs.filter("doc_id <= 2"))).agg(F.sum("taken")).first()[0] == 0


def test_weights_decide_who_comes_first(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("size"),
                                    F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    picked = mixing.plan(docs).filter("times = 2").groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()
    counts = {r.odd: r["count"] for r in picked}
    assert counts[0] + counts[1] == 1500 and 1.7 < counts[0] / counts[1] < 2.7  # of half the rows, heavy ones about 2 to 1


def test_merkle_fingerprints(spark, odd):
    docs, rows = odd
    ids = sorted({d for d, _, _ in rows})
    text = {d: t or "" for d, t, _ in rows}
    got = {}
    for r in merkle.edited_pairs(docs).collect():
        mine, after = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        k = len(mine) // 4
        assert r.n_chars == len(mine) and r.edited_sha256 == _sha(mine[:len(mine) - k] + after[:k])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        got[r.doc_id] = r
    assert len(got) == len(ids) and got[3].fingerprint == got[4].fingerprint and got[3].near_next == 1
    assert len({r.fingerprint for r in got.values()}) == len(set(text.values()))
    assert got[5].near_edited > 0.5
    assert merkle.edited_pairs(docs.limit(0)).count() == 0
    alone = merkle.edited_pairs(docs.filter("doc_id = 3")).first()
    assert alone.near_next == 1 and alone.n_chars == 3


def test_merkle_locates_an_edit(spark):
    lines = [f"line {i}, with some words of its own" for i in range(80)]
    other = list(lines)
    other[40] = "another line"
    pair = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    prints = merkle.with_fingerprint(merkle.with_fingerprint(pair, "a", "fa"), "b", "fb")
    r = prints.select(merkle.likeness(F.col("fa"), F.col("fb")).alias("like"), "fa",
                      merkle.changed_sections(F.col("fa"), F.col("fb")).alias("changed")).first()
    sections = r.fa.split("/")[1].split(";")
    assert 0.9 < r.like < 1 and 1 <= len(r.changed) <= 2 < len(sections)
    leaf = _sha("line 40,")[:8]
    assert any(leaf in sections[i] for i in r.changed)


def test_merkle_leaves_without_punctuation(spark):
    texts = ["the old house on the hill was sold again last spring and nobody knew who had bought it or why",
             "apple banana melon lemon plum cherry grape onion carrot turnip leek radish",
             "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈",
             "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所で泣いていた。",
             "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอนหรือวรรณยุกต์เช่นเดียวกับภาษาจีน",
             "старый дом на холме снова продали прошлой весной и никто не знал кто его купил", "buy milk and bread soon"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = merkle.edited_pairs(docs).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: r.near_edited for r in rows if not 0 < r.near_edited < 1} == {}
    assert all(r.near_edited > 0.3 for r in rows if len(texts[r.doc_id]) > 40)


def test_toxicity(spark, odd):
    docs, rows = odd
    rng = random.Random(4)
    neutral = [f"word{i}" for i in range(300)]

    def text(toxic):
        words = rng.choices(neutral, k=60) + (rng.choices(["vilest", "vileness", "grubby"], k=2) if toxic else [])
        rng.shuffle(words)
        return " ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words)

    flags = [rng.random() < 0.2 for _ in range(1500)]
    table = spark.createDataFrame([(i, text(t)) for i, t in enumerate(flags)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(flags)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    held = toxicity.held_out(toxicity.score(table, model)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    right = [(r.predicted == 1) == flags[r.doc_id] for r in held if r.held_out]
    assert np.mean(right) > 0.97
    scored = toxicity.score(docs, model)
    assert set(docs.columns) | {"predicted"} == set(scored.columns)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.collect())
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).filter("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_personal_data(spark, odd):
    docs, rows = odd
    good = ["mail ab.c@mail1.example.com or +1 (319) 555-5132.", "at 10.2.3.4, card 4799134681044206",
            "call +1 (269) 555-3296 4524132264652876 now", "1.2.3.4.5.6.7.8 and 999.1.1.1 no"] * 6
    table = spark.createDataFrame(list(enumerate(good)), "doc_id long, text string")
    model = pii.train(table)
    got = {r.doc_id: r for r in pii.find(table, model).collect()}
    for i, text in enumerate(good):
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in pii.base_spans(text))
        assert got[i].base_sha256 == _sha(base) and set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert got[0].n_email == got[0].n_phone == 1 and got[1].n_ip == got[1].n_card == 1
    assert got[2].n_phone == got[2].n_card == 0 and got[2].spans == "card:23:39,phone:5:22"
    plain = pii.find(docs, model).collect()
    assert len(plain) == len(rows) and all(r.spans == "" and r.base_sha256 == _sha("") for r in plain)
    assert pii.find(docs.limit(0), pii.train(docs.limit(0))).count() == 0


def test_personal_data_at_a_hundred_times_the_size(spark):
    rng = random.Random(31)

    def number(n):
        return "".join(rng.choices("0123456789", k=n))

    makers = [lambda: f"mail {number(3)}ab@mail{number(1)}.example.com", lambda: f"call +1 ({number(3)}) 555-{number(4)}",
              lambda: f"tel {number(3)} {number(3)} {number(4)}", lambda: f"host 10.{number(1)}.2.{number(2)} up",
              lambda: f"card {number(16)} was", lambda: f"+1 (269) 555-{number(4)} 4524132264652876",
              lambda: f"x ab (at) host{number(1)} (dot) com", lambda: f"ids {number(4)}.{number(4)}.{number(4)}.{number(4)}",
              lambda: f"sizes {number(3)}-{number(2)}-{number(4)} or", lambda: f"at 300.2.{number(2)}.4"]
    docs = spark.createDataFrame([(i, rng.choice(makers)()) for i in range(400)], "doc_id long, text string").coalesce(2)
    one = pii.train(docs)
    many = pii.train(docs.crossJoin(spark.range(100).select()).coalesce(2))
    assert np.allclose(one.weights, many.weights, atol=1e-6) and one.accuracy == many.accuracy
    assert _rows(pii.find(docs, one), "doc_id", "spans") == _rows(pii.find(docs, many), "doc_id", "spans")


def test_html_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    trees = htmltext.train(pages)
    import html
    import re
    for r in htmltext.extract(pages, trees).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.sub(r"</?(?:p|h1|br)\b[^>]*>", "\0", re.search("<article>(.*)</article>", r.html, re.S)[1])
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in body.split("\0"))
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 2), (2, "u", "", 2), (3, "v", "<p>", 3)],
                                "page_id long, url string, html string, text int")
    assert _rows(htmltext.extract(odd, trees), "page_id", "url", "text", "n_chars") == [
        (1, None, "", 0), (2, "u", "", 0), (2, "u", "", 0), (3, "v", "", 0)]
    unmarked = htmltext.train(odd)
    assert htmltext.extract(odd.limit(0), unmarked).count() == 0
