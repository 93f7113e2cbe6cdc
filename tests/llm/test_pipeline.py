"""The pipeline's stages on odd rows and empty tables, and the whole run held to its stages' own rules."""

import hashlib
import random
from collections import Counter

import pytest
from frames import ODD, SCHEMA, row, words

import corpus_pipeline
from pitwise.llm import pieces


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents of three sources, near and exact copies, junk, short texts and personal data."""
    rows = [row(i, words(120 + i % 50, i), source=f"s{i % 3}") for i in range(300)]
    for i in range(300, 330):  # near copies of the first thirty
        text = words(120 + (i - 300) % 50, i - 300).split()
        text[random.Random(i).randrange(len(text))] = "changed"
        rows.append(row(i, " ".join(text), source=f"s{i % 3}"))
    rows += [row(i, words(120, 0), source="s0") for i in range(330, 340)]
    rows += [row(i, "Ha " * 80, source="s1") for i in range(340, 345)] + [row(345, "short")]
    rows += [row(i, words(100, i) + f" mail me.{i}@example.org now", source="s2") for i in range(400, 410)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{at}/documents.parquet")
    return f"file://{at}"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows_and_an_empty_table(spark, odd, none, name, stage):
    for docs in (odd, none):
        got = stage(spark, docs, "")
        assert got.count() <= 3 * max(len(ODD), 1)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert got.dtypes == docs.dtypes


def test_stages_do_their_work(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus).cache()
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = {name: Counter(d for d, _ in rows) for name, rows in kept.items()}
    clean = {*range(300), *range(400, 410)}
    assert set(ids["quality rules"]) == clean | set(range(300, 340))
    assert set(ids["SimHash near-dedup"]) == clean and max(ids["SimHash near-dedup"].values()) == 1
    texts = dict(kept["PII"])
    assert all("<email>" in texts[i] and "@" not in texts[i] for i in range(400, 410)) and set(texts) == clean
    assert set(ids["mixing sources to target weights"]) <= clean and max(ids["mixing sources to target weights"].values()) <= 3
    size = {d: len(t.split()) for d, t in kept["PII"]}
    by_source = Counter()
    for d, n in ids["mixing sources to target weights"].items():
        by_source["s2" if d >= 400 else f"s{d % 3}"] += n * size[d]
    whole = sum(size.values())
    for s, weight in (("s0", 1), ("s1", 2), ("s2", 3)):
        assert by_source[s] == pytest.approx(whole * weight / 6, rel=0.15)


def test_run_ends_in_digests_of_the_mixed_documents(spark, corpus):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, corpus).collect())) for _ in range(2))
    assert first == again and len(first) > 200
    own = pieces.encoder(None)
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id < 300")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc_id, n, ids_sha, decoded_sha, _ in first:
        if doc_id in text:
            ids = own.lib.encode(text[doc_id], add_eos=True)
            assert (n, ids_sha) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            assert decoded_sha == hashlib.sha256(text[doc_id].encode()).hexdigest()


def test_a_small_graph_is_not_shuffled_between_rounds(spark):
    from pitwise.llm import components

    edges = components.cut(spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint").repartition(4))
    plan = lambda count: components._round(edges, count)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(40)
    assert "Exchange" in plan(components.SMALL + 1)
    assert sorted(components._round(edges, 40).collect()) == sorted(components._round(edges, components.SMALL + 1).collect())
    assert {(r.node, r.root) for r in components.components(edges).collect()} == {(i, 0) for i in range(41)}
