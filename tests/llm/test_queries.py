"""Registered queries against DuckDB, and the pipeline against its parts."""

import re
from collections import Counter, defaultdict

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_llm import grams, plain_mix

import __spark_entry__ as driver
import corpus_pipeline
from gridrel.llm import mixing, toxicity
from gridrel.llm.common import crc_mod, stash
from gridrel.llm.queries import ORACLES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, "/root/testdata/sf0.01")
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def plain_pipeline(spark, sf):
    """The pipeline's stages by loops over the documents: what each leaves, and the mix of the last."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), crc_mod("doc_id", 4) != 2)
    rows = [r for r in rows if model.score(r[1]) < 0.3]
    yield rows
    held, largest = defaultdict(set), {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\f\r").encode().lower()
            if len(key.decode()) >= 40:
                held[key].add(i)
                largest[key] = max(largest.get(key, i), i)

    def stays(i, line):
        key = line.strip(" \t\n\x0b\f\r").encode().lower()
        return len(held.get(key, ())) < 5 or largest[key] == i

    rows = [(i, t and "\n".join(x for x in t.split("\n") if stays(i, x)), s) for i, t, s in rows]
    yield rows
    sets = {i: grams(t) for i, t, _ in rows}
    root = {i: i for i, *_ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    rows = [r for r in rows if root[r[0]] == r[0]]
    yield rows
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    passages = {tuple(w[k : k + 13]) for w in items for k in range(max(0, len(w) - 12))}
    rows = [r for r in rows if not any(tuple(w[k : k + 13]) in passages for w in [words(r[1])] for k in range(len(w) - 12))]
    yield rows
    yield plain_mix(rows, mixing.SHARD, (3, 1, 2), 1.5, 2.0)[0]


def test_pipeline_against_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    at, want = docs, list(plain_pipeline(spark, SMALL))
    assert len({len(w) for w in want[:4]}) == 3, "every stage but the second drops documents"
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want, strict=False):
        at = stash(stage(spark, at, SMALL), "test")
        assert at.columns == docs.columns and Counter((r.doc_id, r.text, r.source) for r in at.collect()) == Counter(rows), name
    slots = defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        slots[r.shard, r.slot].append((r["at"], [(r.doc_id, w) for w in r.words.split()]))
    assert {k: [w for _, p in sorted(v) for w in p] for k, v in slots.items()} == {(h, slot): words for h, slot, words in want[4]}


def test_stages_on_odd_rows(spark):
    """Nulls in every column, repeated rows, a clashing column; and empty tables."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "a", 0), (None, "some words here", None, None, 15), (None, "some words here", None, None, 15), (3, "", "en", "a", 0), (3, "x " * 40_000, "en", None, 80_000)], docs.schema)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        out = stage(spark, odd.withColumn("size", F.lit(7)), SMALL)
        left[name] = out.count()
        assert name == "mixing" or out.columns == [*docs.columns, "size"]
    assert left["line_dedup"] == left["decontamination"] == 6 and left["jaccard_join"] == 5 and left["mixing"] > 1_000
