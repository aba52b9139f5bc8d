"""The mix of rows that share a doc_id: each row is taken as often as its own plan says."""

from collections import Counter

from filmfold.llm import mixing


def test_rows_that_share_an_id(spark):
    rows = [(i % 40 if i % 9 else None, ["one two three", "a # b = c {d}", "x " * 30, ""][i % 4] + str(i // 80), ["a", "b", "c", None][i % 7 % 4])
            for i in range(240)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, source string")
    planned = Counter()
    for r in mixing.plan(mixing.sized(docs)).collect():
        planned[r.doc_id, r.source, r["size"]] += r.times
    mixed = Counter()
    for r in mixing.mix(docs).collect():
        mixed[r.doc_id, r.source, len((r.text or "").split())] += 1
    assert mixed == +planned and sum(mixed.values()) > 200
