"""The pipeline's stages on the smallest tables, each against a plain version of its own step."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from filmfold.llm.common import written
from test_operators import _classes, _plain_lines, _plain_targets, _sha, _shingle_set

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "mixing", "bpe"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    def run(name, before):
        return written(stages[name](spark, before, SF), "test-stage")

    before = docs.collect()
    clean = run("toxicity", docs)
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns
    assert sum(1 for d, t in labels.items() if t == 0 and d not in kept) <= 0.05 * len(labels)
    before = [tuple(r[c] for c in ("doc_id", "text")) for r in clean.collect()]
    lines = run("line_dedup", clean)
    assert lines.columns == columns
    left = _plain_lines(before)
    expected = {d: t for d, t in left.items() if t.split() or t == dict(before)[d]}
    after = {r.doc_id: r.text for r in lines.collect()}
    wrong = [d for d in expected.keys() | after.keys() if expected.get(d) != after.get(d)]
    assert len(wrong) <= 2  # bands may miss a pair just at the threshold
    one = run("ngram_join", lines)
    classes = _classes({d: _shingle_set(t) for d, t in after.items()})
    assert one.columns == columns and {r.doc_id for r in one.collect()} == set(classes.values())
    mixed = run("mixing", one)
    sizes = Counter()
    for r in one.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    target, taken, times = _plain_targets(sizes), Counter(), Counter()
    for r in mixed.collect():
        taken[r.source] += len((r.text or "").encode().split())
        times[r.doc_id] += 1
    longest = max(len((r.text or "").split()) for r in one.collect())
    assert mixed.columns == columns and max(times.values()) <= 2
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)
    tokens = run("bpe", mixed)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in mixed.collect()}
    assert Counter(r.doc_id for r in tokens.collect()) == times
    for r in tokens.collect():
        assert list(r.ids) == ids[r.doc_id] and r.n_tokens == len(r.ids) and r.ids_sha256 == _sha(",".join(map(str, r.ids)))


def test_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_at_the_size_of_the_check(spark):
    """Every stage leaves most of what it is given, the filtering ones take something, and clean documents stay."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, count = dict(corpus_pipeline.STAGES), {"documents": docs.count()}
    for name in ("toxicity", "line_dedup", "ngram_join", "mixing", "bpe"):
        docs = written(stages[name](spark, docs, sf), "test-stage")
        count[name] = docs.count()
        if name == "toxicity":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean, toxic = ([r.doc_id for r in labels if r.toxic == t] for t in (0, 1))
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)
    assert sum(d in kept for d in toxic) <= 0.4 * len(toxic)
    assert 0.8 * count["documents"] <= count["toxicity"] < count["documents"]
    assert 0.5 * count["toxicity"] <= count["ngram_join"] <= count["line_dedup"] <= count["toxicity"]
    assert count["ngram_join"] < count["toxicity"] and count["mixing"] > 0 and count["bpe"] == count["mixing"]
