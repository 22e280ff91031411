"""Skewed inputs: one passage in very many different surroundings."""

import hashlib

from pyspark.sql import functions as F

from skimdex.llm import substring_dedup


def test_a_license_line_in_different_surroundings(spark, monkeypatch):
    """As hot anchors, window by window, and as anchors that the sample calls frequent; the answers are the same."""
    licence = "".join(chr(97 + i * i % 23) for i in range(100))
    # 3000 documents with surroundings of their own around the passage of just one window.
    made = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit(licence), F.sha2((F.col("id") + 7777).cast("string"), 512)).alias("text"))
    seen, want = set(), {}
    for i, t in sorted((r.doc_id, r.text) for r in made.collect()):
        gone = set()
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone |= set(range(s, s + 100))
            seen.add(t[s : s + 100])
        want[i] = (len(gone), int(bool(gone)), hashlib.sha256("".join(c for j, c in enumerate(t) if j not in gone).encode()).hexdigest())
    assert sum(w[0] >= 100 for w in want.values()) == 2999
    for hot in (100, 100_000):
        got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.strip(made, hot_runs=hot).collect()}
        assert got == want
    sampled = substring_dedup.frequent_anchors
    monkeypatch.setattr(substring_dedup, "frequent_anchors", lambda docs, length, gram: sampled(docs, length, gram, 4, 50))
    assert substring_dedup.frequent_anchors(made.select(F.col("doc_id").alias("k"), F.col("text").alias("t")), 100, 32).count() > 0
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.strip(made, hot_runs=100).collect()}
    assert got == want
