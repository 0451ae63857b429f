"""Each stage of the pipeline against plain Python over the same rows."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tidemark.llm import ngram_join, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    """Rows before and after each stage."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"file://{top}/{k}")
        out.append(spark.read.parquet(f"file://{top}/{k}"))
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_columns_pass_through(staged):
    assert all(d.schema == staged[0].schema for d in staged[1:5])


def test_quality(spark, staged, sf_dir):
    before, after = rows(staged[0]), rows(staged[1])
    assert not after - before
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = [r for r in (before - after).elements() if quality.get(r[0]) == 1]
    assert all(len(WORD.findall(r[1])) < 50 for r in gone if r[1])


def test_near_duplicates(staged):
    docs = {r["doc_id"]: ngram_join.shingles_of(r["text"], 5) for r in staged[1].collect()}
    kept = {r["doc_id"] for r in staged[2].collect()}
    assert not rows(staged[2]) - rows(staged[1])
    link = lambda a, b: a & b and 100 * len(a & b) >= 80 * len(a | b)
    ids = sorted(docs)
    assert not any(link(docs[a], docs[b]) for a in kept for b in kept if a < b)
    reach = {i: i for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if link(docs[a], docs[b]):
                x, y = sorted((reach[a], reach[b]))
                reach = {k: x if v == y else v for k, v in reach.items()}
    assert kept == set(reach.values())


def test_secrets(staged):
    for a, b in zip(staged[2].orderBy("doc_id").collect(), staged[3].orderBy("doc_id").collect(), strict=True):
        spans = secret_scan.base_spans(a["text"])
        assert (a["doc_id"], a["lang"], a["source"]) == (b["doc_id"], b["lang"], b["source"]) and b["n_chars"] == len(b["text"])
        assert not secret_scan.base_spans(b["text"]) and (spans or a["text"] == b["text"] or "[random]" in b["text"])
        assert secret_scan.redacted(a["text"], spans) == b["text"] or "[random]" in b["text"]


def test_mixture(staged):
    before, after = rows(staged[3]), rows(staged[4])
    assert set(after) <= set(before) and max(after.values()) <= 3
    size = lambda c: sum(n * len(WORD.findall(r[1])) for r, n in c.items())
    assert size(after) == pytest.approx(size(before), rel=0.05)


def test_packing(staged):
    places = defaultdict(list)
    for r in staged[5].collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 4096
    assert Counter(r["doc_id"] for r in staged[5].where("piece = 0").collect()) == Counter(r["doc_id"] for r in staged[4].collect())


def test_run_and_odd_documents(spark, sf_dir, odd_docs, no_docs, staged):
    assert corpus_pipeline.run(spark, sf_dir).count() == staged[5].count()
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns or "sequence_id" in out.columns
            assert out.count() >= 0
