"""Corpus operators on small fixtures: nulls, empties, ties, repeats, clashing columns, brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridrel.llm import common, components, decontam, hmm, jaccard_join, line_dedup, mixing, pii, token_counts, topk, toxicity, warc
from gridrel.llm.common import crc_mod

DOCS = "doc_id long, text string, source string, size int, rank string, key string, label string"


def docs_of(spark, rows):
    """(doc_id, text[, source]) with extra columns whose names operators use inside."""
    rows = [(*r, "s") if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([(*r, 7, "r", "k", "l") for r in rows], DOCS)


LONG = "this line is long enough to be a key of the line dedup operator"
WORDS = [f"w{i}" for i in range(400)]
ODD = [(None, "no id"), (1, None), (2, ""), (3, "a"), (3, "a"), (4, " \t\n "), (5, "x " * 30_000)]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_is_a_join(spark, monkeypatch, how):
    """With hot keys and without, on one column and on two, for null keys and keys that the table lacks."""
    rng = np.random.default_rng(20)
    keys = [None if k == 9 else int(k) for k in np.minimum(rng.exponential(1.5, 600).astype(int), 9)]
    rows = spark.createDataFrame([(k, k, i) for i, k in enumerate(keys)], "k long, j long, i long")
    table = spark.createDataFrame([(k, k, f"v{k}", keys.count(k)) for k in set(keys) - {None, 2}] + [(77, 77, "none", 1)], "k long, j long, v string, n long")
    for on in ("k", ["k", "j"]):
        want = sorted((i, k, None if k in (None, 2) else f"v{k}") for i, k in enumerate(keys) if how == "left" or k not in (None, 2))
        for hot, least in ((4_096, 1_000), (20, 5), (4, 1)):
            monkeypatch.setattr(common, "HOT", hot)
            monkeypatch.setattr(common, "LEAST_HOT", least)
            got = common.spread_join(rows, table, on, "n", how)
            assert got.columns[:3] == rows.columns
            assert sorted((r.i, r.k, r.v) for r in got.collect()) == want
    assert common.spread_join(rows, table.limit(0), "k", "n", how).count() == (600 if how == "left" else 0)


def test_running_sums(spark):
    rows = spark.createDataFrame([(i * 37 % 101, f"s{i}") for i in range(101)], "x long, s string")
    got = {r.x: (r.place, r.before) for r in common.running(rows, [F.col("x")], {"before": F.col("x")}, "t").collect()}
    assert got == {x: (x, x * (x - 1) // 2) for x in range(101)}
    assert common.running(rows.limit(0), [F.col("x")], {"before": F.col("x")}, "t").count() == 0


def test_warc_round_trip(spark, tmp_path):
    magic = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "a\r\nb", ""), (5, "u", magic * 3), (6, "u", "é" * 5000), (None, "u", "same"), (7, "u", "x" * 200_000), (7, "u", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int")
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)

    def digest(h):
        import base64

        return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()

    best = defaultdict(lambda: -1)
    for i, _, h in rows:
        best[h or ""] = max(best[h or ""], i or -1)
    want = sorted(((i or -1, len((h or "").encode()), digest(h), "response" if best[h or ""] == (i or -1) else "revisit", None if best[h or ""] == (i or -1) else best[h or ""]) for i, _, h in rows), key=str)
    assert got == want
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages.repartition(1), path)
    assert sorted(r.offset for r in warc.read_warc(spark, path, 100).collect()) == sorted(r.offset for r in warc.read_warc(spark, path).collect())
    assert warc.read_warc(spark, path, 1000).count() == len(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("held", [200_000, 3])
def test_line_dedup_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(line_dedup, "RUN_ROWS", held)
    rng = np.random.default_rng(0)
    pool = [LONG + str(i) for i in range(6)] + ["short", "", "  " + LONG + "0\t", LONG.upper() + "1"]
    rows = [(i, "\n".join(pool[j] for j in rng.integers(0, len(pool), 6))) for i in range(40)] + ODD
    docs = docs_of(spark, rows)
    where, largest = defaultdict(set), {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\x0b\f\r").encode().lower().decode()
            if len(k) >= 40:
                where[k].add(i)
                largest[k] = max(largest.get(k, -1), i)

    def kept(i, t):
        out = []
        for line in (t or "").split("\n"):
            k = line.strip(" \t\n\x0b\f\r").encode().lower().decode()
            if len(where.get(k, ())) < 5 or largest[k] == i:
                out.append(line)
        return out

    want = Counter((i, (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept(i, t)), hashlib.sha256("\n".join(kept(i, t)).encode()).hexdigest()) for i, t in rows)
    maps = line_dedup.keep_bitmaps(docs)
    got = Counter(tuple(r) for r in line_dedup.summary(docs, maps).collect())
    assert got == want and sum(k[2] for k in got) > 0
    out = line_dedup.drop_lines(docs, maps)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert {r.doc_id: r.text for r in out.collect() if r.doc_id == 0}[0] == "\n".join(kept(0, rows[0][1]))
    assert line_dedup.summary(docs.limit(0), line_dedup.keep_bitmaps(docs.limit(0))).count() == 0


def plain_base(text):
    """The base patterns as the contract writes them."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for n, (k, p) in enumerate(kinds.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_pii_base_spans():
    rng = np.random.default_rng(1)
    letters = list("ab1@._%+- ()0123456789.\n") + ["é", "x@y.z", "1.2.3.4", "+1 (555) 555-0199", "4111 1111 1111 1111"]
    texts = ["".join(letters[i] for i in rng.integers(0, len(letters), 60)) for _ in range(3000)]
    texts += ["a@b.c_d@e.f", "a@b.c-d@e.f", "1.2.3.4.5.6.7.8", "00001.2.3.255", "1.2.3.256", "4111111111111111", None, "", "😀 a@b.co"]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_pii_query_and_model(spark):
    rng = np.random.default_rng(2)
    base = [(1000 + i, " ".join(WORDS[j] if j % 3 else "abcdefg"[: j % 7 + 1] for j in rng.integers(0, 400, 80)) + f" mail ann.{i}@mail.example.com or 10.0.{i}.1 ok") for i in range(60)]
    docs = docs_of(spark, base + ODD)
    model = pii.fit(docs)
    got = pii.find(docs, model).collect()
    assert len(got) == len(base) + len(ODD)
    for r in got:
        texts = [t for i, t in base + ODD if i == r.doc_id]
        spans = plain_base(texts[0])
        assert (r.n_email, r.n_ip) == (sum(k == 0 for _, k, _ in spans), sum(k == 1 for _, k, _ in spans))
        assert r.base_sha256 == hashlib.sha256(pii.written(spans).encode()).hexdigest()
        assert {s for s in pii.written(spans).split(",") if s} <= set(r.spans.split(","))
    dec = pii.Decoder(model)
    assert all(r.spans == pii.written(plain_base(next(t for i, t in base + ODD if i == r.doc_id))) and not r.n_added for r in pii.find(docs, None).collect())
    # windows are reconciled over the whole text: a span across a window's middle comes out whole
    text = "x" * (pii.STRIDE - 8) + " ann.12@mail.example.com then"
    assert any(a <= text.index("ann") + 1 and b >= text.index("com") + 2 for a, k, b in dec.tag([text])[0] if k == 0)
    assert pii.find(docs.limit(0), model).count() == 0


def test_pii_viterbi_against_enumeration():
    rng = np.random.default_rng(3)
    dec = pii.Decoder(pii.fresh(3))
    dec.moves = rng.normal(size=(5, 5)).astype(np.float32)
    e = rng.normal(size=(4, 5, 3)).astype(np.float32)
    import itertools

    for b in range(3):
        best = max(itertools.product(range(5), repeat=4), key=lambda p: sum(e[t, p[t], b] for t in range(4)) + sum(dec.moves[p[t], p[t + 1]] for t in range(3)))
        assert tuple(dec._viterbi(e)[b]) == best


def test_pii_added_spans_are_right(spark):
    """On made-up spans that the patterns miss, in documents that training did not see; long texts alone train as well."""
    rng = np.random.default_rng(30)
    prose = lambda n: " ".join(WORDS[j] if j % 3 else "abcdefg"[: j % 7 + 1] for j in rng.integers(0, 400, n))
    docs = docs_of(spark, [(i, f"{prose(2500)} mail ann.{i}@mail.example.com {prose(2500)}") for i in range(12)])
    model = pii.fit(docs)
    assert model is not None
    precision, recall = pii.held_out_quality(model, [p for _ in range(40) for p in pii.pieces_of(prose(300))])
    assert precision >= 0.9 and recall >= 0.6
    # numbers that fail the checksum are never added
    text = "pay 4111 1111 1111 1112 or 4111.1111.1111.1112 now"
    assert pii.reconcile(text, [], [(4, 2, 23), (27, 2, 46)]) == [] and pii.reconcile("4111.1111.1111.1111", [], [(0, 2, 19)]) == [(0, 2, 19)]
    for none in (docs.limit(0), docs_of(spark, [(1, None), (2, "")])):
        assert pii.sample(none) == [] and pii.fit(none) is None
    few = pii.sample(docs_of(spark, [(None, "same")] * 50 + [(i, f"text {i}") for i in range(300)]), n=10)
    assert len({p for p, _ in few}) == 10 and len(few) == 10 * pii.TRAIN_PIECES


def test_pii_gradient():
    rng = np.random.default_rng(4)
    x, y, m = rng.integers(0, 130, (2, 6)), rng.integers(0, 5, (2, 6)), pii.fresh(1, 3)
    loss, grads = pii.loss_and_gradient(m, x, y)
    for a, g in zip(m.arrays(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        a[at] += 1e-6
        assert (pii.loss_and_gradient(m, x, y)[0] - loss) / 1e-6 == pytest.approx(g[at], rel=1e-3)
        a[at] -= 1e-6


def grams(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").replace("\n", " ").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, n = list(ODD), 10
    for g in range(12):
        words = [WORDS[i] for i in rng.integers(0, 400, 60 + 20 * g)]
        for _ in range(int(rng.integers(1, 7))):
            w = list(words)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = "edit" + str(rng.integers(0, 10**6))
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, rows[-1][1]), (n + 1, "one two three"), (n + 2, "One  two three")]
    docs = docs_of(spark, rows)
    sets = {t: grams(t) for _, t in rows}
    texts = list(sets)
    link = {t: [u for u in texts if u != t and sets[t] and sets[u] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])] for t in texts}
    got = jaccard_join.classes(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        r = by_id[i]
        assert r.n_links == len(link[t]), (i, r, len(link[t]))
        seen, todo = {t}, [t]
        while todo:
            for u in link[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        ids = [j for j, u in rows if u in seen and j is not None]
        assert r.class_id == (min(ids) if ids and sets[t] else i)
    assert sum(r.n_links for r in got) > 10
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.class_id == r.doc_id}
    assert jaccard_join.classes(docs.limit(0)).count() == 0 and jaccard_join.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1_000, 1])
def test_one_of_each_judges_rows(spark, monkeypatch, hot):
    """Repeated and missing ids: rows go by their own texts, and no text is lost."""
    monkeypatch.setattr(common, "LEAST_HOT", hot)
    monkeypatch.setattr(common, "HOT", 3 if hot == 1 else 4_096)
    a, b, c = "a text that is held more than once", "another text altogether of its own", "the third of the texts in here"
    near = " ".join(WORDS[:60])
    for rows, want in (
        ([(3, a), (3, a), (4, b), (4, a)], [(3, a), (4, b)]),
        ([(None, a), (None, b), (5, a)], [(None, b), (5, a)]),
        ([(None, a), (None, a), (None, c)], [(None, a), (None, c)]),
        ([(7, a), (7, near), (9, near + " end"), (8, b), (8, b), (6, "")] * 2, [(6, ""), (6, ""), (7, a), (7, near), (8, b)]),
        ([(1, None), (1, None), (None, " ")], [(1, None), (1, None), (None, " ")]),
    ):
        docs = docs_of(spark, rows)
        got = jaccard_join.one_of_each(docs)
        assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    # rows alike in id and text, with other columns: the first as JSON stays
    docs = spark.createDataFrame([(1, a, "z"), (1, a, "y"), (2, a, "x")], "doc_id long, text string, source string")
    assert [tuple(r) for r in jaccard_join.one_of_each(docs).collect()] == [(1, a, "y")]


def test_jaccard_blocks_and_parts(spark, monkeypatch):
    """Classes larger than a block and buckets larger than a part lose no link."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join.near_edges, "__defaults__", (8,))
    rows = [(i, " ".join([*WORDS[:150], f"end{i}"])) for i in range(40)]
    got = jaccard_join.classes(docs_of(spark, rows)).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {39}


def test_jaccard_ties_of_long_texts(spark):
    """Sets of thousands of shingles at exactly 0.8 are linked, those one shingle short of it are not."""
    verify = jaccard_join._verify(0.8)
    for both in (1_148, 4_000, 40_000, 120_000):
        union = both * 5 // 4
        for short in (0, 1):
            tokens = np.arange(union + short, dtype=np.uint64)
            x, y = tokens[: both + (union - both) // 2], np.r_[tokens[:both], tokens[both + (union - both) // 2 :]]
            for met, n in (([[5, 6], [6]], 0 if short else 3), ([[5], [6]], 0)):  # in a bucket together, and in none
                group = pa.table({"id": [b"x", b"y"], "tokens": [x.tobytes(), y.tobytes()], "met": met, "block": [0, 0], "i": [0, 0], "j": [0, 0]})
                assert len(verify(group)) == n, (both, short)
    # 4,000 of 5,000 shingles are shared: 4,004 words, then 500 more each
    words = [f"v{i}" for i in range(5_004)]
    rows = [(1, " ".join(words[:4_504])), (2, " ".join([*words[:4_004], *words[4_504:]])), (3, " ".join([*words[:4_004], *words[4_504:], "more"]))]
    sets = [grams(t) for _, t in rows]
    assert 5 * len(sets[0] & sets[1]) == 4 * len(sets[0] | sets[1])
    got = {r.doc_id: r.n_links for r in jaccard_join.classes(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_paths_survive_as_promised():
    rng = np.random.default_rng(6)
    met, runs = 0, jaccard_join.runs_for(0.8, jaccard_join.DEPTH, 0.999)
    for _ in range(200):
        both = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, 10, dtype=np.uint64)]) for _ in range(2))
        pa, pb = (jaccard_join.chosen_paths(np.sort(x), runs, jaccard_join.DEPTH, 0.8)[:, -1] for x in (a, b))
        met += bool(np.intersect1d(pa[pa > 0], pb[pb > 0]).size)
    assert met >= 190


def test_long_sets_in_turns(monkeypatch):
    """Paths, shingles and sketches do not depend on how much is held at once."""
    rng = np.random.default_rng(16)
    tokens = np.unique(rng.integers(0, 2**64, 5_000, dtype=np.uint64))
    text = " ".join(f"w{i}" for i in rng.integers(0, 500, 3_000)) + "\n\nEnd é"
    whole, paths = jaccard_join.shingles(text), {tuple(r) for r in jaccard_join.chosen_paths(tokens, 15, 3, 0.8)}
    monkeypatch.setattr(jaccard_join, "CELLS", 700)
    monkeypatch.setattr(jaccard_join, "TURN", 100)
    assert {tuple(r) for r in jaccard_join.chosen_paths(tokens, 15, 3, 0.8)} == paths
    assert (jaccard_join.shingles(text) == whole).all()


def test_sketches_find_similar_sets():
    """Pairs at the threshold agree in MAYBE, of any size, subsets among them; unlike ones do not."""
    rng = np.random.default_rng(17)
    new = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    low, high = 1.0, 0.0
    for size in (5, 20, 60, 200, 2_000):
        for _ in range(200):
            both = new(8 * size)
            for x, y in ((np.r_[both, new(size)], np.r_[both, new(size)]), (np.r_[both, new(2 * size)], both)):
                low = min(low, jaccard_join._agree(*[jaccard_join.sketch(np.unique(v))[None] for v in (x, y)])[0, 0])
            high = max(high, jaccard_join._agree(*[jaccard_join.sketch(np.unique(np.r_[both[: 2 * size], new(8 * size)]))[None] for _ in (0, 1)])[0, 0])
    assert low >= jaccard_join.MAYBE > high


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == got[103] == 100


def test_mixing(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 400))), [None, "a", "b", "c"][int(min(3, rng.exponential(1)))]) for i in range(400)]
    rows += [(1, None, "a"), (2, "", "zero"), (3, "w " * 20_000, "a"), (3, "w " * 20_000, "a"), (None, "w w", "b")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    size, weight = Counter(), {}
    for _, t, s in rows:
        size[s] += len((t or "").split())
    for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or ""))):
        weight[s] = (3, 1, 2)[k % 3]
    left, open_, target = 1.5 * sum(size.values()), set(size), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[u] for u in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * size[s]]
        for s in full or list(open_):
            target[s] = 2.0 * size[s] if full else share[s]
            left -= target[s]
            open_.discard(s)
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of Python values: ("i", n) for int, ints for long, texts; nulls are skipped."""
    import struct

    import xxhash

    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def plain_mix(rows, shard, weights, budget, most, seed=0):
    """The mix by loops over documents and slots: rows of (shard, slot, block's words with their documents)."""
    block, sizes = mixing.BLOCK, Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = budget * sum(sizes.values()), set(sizes), {}
    while open_:
        part = {s: left * weight[s] / sum(weight[u] for u in open_) for s in open_}
        full = [s for s in open_ if part[s] > most * sizes[s]] or list(open_)
        capped = any(part[s] > most * sizes[s] for s in open_)
        for s in full:
            target[s] = most * sizes[s] if capped else part[s]
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    blocks = {}
    for s in names:
        of = sorted((r for r in rows if r[2] == s and (r[1] or "").split()), key=lambda r: (spark_hash(("i", seed), r[0], len(r[1].split())), r[0] is not None, r[0], spark_hash(r[1])))
        words = [(r[0], w) for r in of for w in r[1].split()]
        blocks[s] = [words[i : i + block] for i in range(0, len(words), block)]
    share = {s: target[s] * len(blocks[s]) / sizes[s] if blocks[s] else 0.0 for s in names}
    lo = {s: sum(share[u] for u in names[:k]) for k, s in enumerate(names)}
    even = lambda x: math.floor(x + 0.5)
    places = {s: even(lo[s] + share[s]) - even(lo[s]) for s in names}
    n, total = sum(places.values()), lo[names[-1]] + share[names[-1]]
    drawn = []
    for i in range(n):
        u = spark_hash(("i", seed), "u", i) % 2**mixing.BITS / 2**mixing.BITS * total
        drawn.append(next(s for s in reversed(names) if share[s] and lo[s] <= u))
    seen, out, late = Counter(), [], []
    for h in range(0, n, shard):
        part = drawn[h : h + shard]
        ordered = [s for s in names for u in part if u == s]
        for k, s in enumerate(ordered):
            slot = (k * mixing.STRIDE + spark_hash(("i", seed), "slot", h // shard) % len(part)) % len(part)
            out.append([h // shard, slot, s, seen[s]])
            seen[s] += 1
    late = sorted((r for r in out if r[3] >= places[r[2]]), key=lambda r: (names.index(r[2]), r[3]))
    short = [(s, k) for s in names for k in range(seen[s], places[s])]
    assert len(late) == len(short)
    for r, (s, k) in zip(late, short, strict=True):
        r[2:] = [s, k]
    result = []
    for h, slot, s, k in out:
        m = len(blocks[s])
        x, key = k % m, spark_hash(("i", seed), names.index(s), k // m)
        for r in range(1, mixing.ROUNDS + 1):
            other = ((spark_hash(key, ("i", r)) >> 1) - x) % m
            x = other if spark_hash(key, ("i", -r), max(x, other)) & 1 else x
        result.append((h, slot, blocks[s][x]))
    return result, Counter(drawn[:shard])


def test_mixture_equals_the_plain_mix(spark):
    """Slot by slot and word by word against loops in Python, for other weights than the default too."""
    rng = np.random.default_rng(18)
    rows = [(i, " ".join(f"{i}x{j}" for j in range(int(rng.integers(0, 90)))) + "\n", ["a", "b", "c", None][int(min(3, rng.exponential(1)))]) for i in range(250)]
    rows += [(None, "w w", "b"), (7, None, "a"), (8, " ", "none"), (300, "v " * 4_000, "c")]
    docs = docs_of(spark, rows)
    for options in ({"weights": (3, 1, 2), "budget": 1.5, "most": 2.0}, {"weights": (1.0, 4.0), "budget": 0.7, "most": 1.5}):
        want, first = plain_mix(rows, 64, **options)
        slots = defaultdict(list)
        for r in mixing.mixture(docs, shard=64, **options).collect():
            part = r.words.split()
            assert len(part) == r.n
            slots[r.shard, r.slot].append((r["at"], [(r.doc_id, w) for w in part]))
        got = {k: [w for at, p in sorted(v, key=lambda x: x[0]) for w in p] for k, v in slots.items()}
        assert got == {(h, slot): words for h, slot, words in want}
        taken = Counter(d for *_, words in want for d, _ in words)
        digest = mixing.mix(docs, shard=64, **options).collect()
        assert len(digest) == len(rows) and all(r.taken == (taken[r.doc_id] if r.size else 0) for r in digest if r.doc_id != 7 or r.size)


def test_mixture_counts_vary_as_multinomial_ones_do(spark):
    """Over many shards a source's counts have the spread of independent draws."""
    docs = docs_of(spark, [(i, "w " * 320, "abc"[i % 3]) for i in range(600)])
    p = mixing.plan(docs, shard=50)
    counts = p.slots.groupBy("shard", "rank").count().collect()
    n_shards = max(r.shard for r in counts)  # the last one is short
    for rank in range(3):
        x = np.array([next((r["count"] for r in counts if r.shard == k and r["rank"] == rank), 0) for k in range(n_shards)])
        share = x.mean() / 50
        assert 0.6 < x.var() / (50 * share * (1 - share)) < 1.5


def test_mixture_keeps_texts(spark):
    """Slices of a document join to its text; blocks take their turns evenly."""
    rows = [(i, f"{i}a\t" + " ".join(f"{i}x{j}" for j in range(i % 70)) + "\n\n", "ab"[i % 2]) for i in range(300)]
    p = mixing.plan(docs_of(spark, rows), shard=64)
    parts = defaultdict(list)
    for r in p.blocks.collect():
        parts[r.doc_id].append((r["first"], r.words))
    assert {i: "".join(w for _, w in sorted(v)) for i, v in parts.items()} == {i: t for i, t, _ in rows}
    uses = Counter((r["rank"], r.block) for r in p.slots.collect())
    for rank in (0, 1):
        n = [c for (k, _), c in uses.items() if k == rank]
        assert max(n) - min(n) <= 1


def test_permutation_is_one(spark):
    for n in (1, 2, 97, 1000):
        rows = spark.range(n).select("id", F.col("id").alias("x"), F.lit(n).cast("long").alias("n"), F.lit(5).cast("long").alias("key"))
        p = [r.x for r in mixing.permute(rows, "x", "n", "key").collect()]
        assert sorted(p) == list(range(n)) and (n < 50 or p != list(range(n)))


def test_lm_scores(spark):
    rng = np.random.default_rng(8)
    a, b = WORDS[:40], WORDS[200:240]
    rows = [(1000 + i, " ".join((a if i % 2 else b)[j] for j in rng.integers(0, 40, 30))) for i in range(120)] + ODD
    docs = docs_of(spark, rows)
    got = hmm.score(docs, crc_mod("doc_id", 7) == 2, states=3, rounds=6, head=50).collect()
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False
    c = Counter(w for i, t in rows if not held(i) for w in [*hmm.tokens(t), "<end>"])
    total, distinct = sum(c.values()), len(c)
    assert len(got) == len(rows)
    better = 0
    for r in got:
        t = next(t for i, t in rows if i == r.doc_id)
        ws = [*hmm.tokens(t), "<end>"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws))
        better += r.score > r.base_score
    assert better > 100
    assert hmm.score(docs.limit(0), crc_mod("doc_id", 7) == 2).count() == 0
    none = hmm.score(docs, F.lit(True), head=50).collect()
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in none)


@pytest.mark.parametrize("head", [20, 1])
def test_lm_scores_against_plain_recursion(spark, head):
    """The score of every text by loops over its words under the trained model; the end has its symbol even outside a tiny head."""
    rng = np.random.default_rng(19)
    rows = [(100 + i, " ".join(WORDS[j] for j in rng.zipf(1.5, 25) % 300)) for i in range(60)] + ODD[:6] + [(900, "Straße É " * 3)]
    docs = docs_of(spark, rows).withColumn("held_out", F.lit(None))
    held = crc_mod("doc_id", 7) == 2
    v, _, m = hmm.trained(docs.select("doc_id", "text", held.alias("held_out")), states=3, rounds=3, head=head)
    counts = {bytes(r.word): r.c for r in v.counts.collect()}
    assert len(v.head) <= head and v.ends == counts[hmm.END] and hmm.END not in v.head

    def symbol(w):
        if w == hmm.END:
            return len(v.head) + hmm.CLASSES, 1.0
        if w in v.head:
            return v.head[w], 1.0
        k = min(len(w) >> 2, 7) << 3 | (not w.isascii()) << 2 | (w[-1] >> 1 & 3)
        return len(v.head) + k, (counts.get(w, 0) + 1) / (v.class_tokens[k] + v.class_words[k] + 1)

    for r in hmm.score(docs, held, states=3, rounds=3, head=head).collect():
        words = [*hmm.tokens(next(t for i, t in rows if i == r.doc_id)), hmm.END]
        now, total = None, 0.0
        for w in words:
            s, share = symbol(w)
            now = (m.start if now is None else now @ m.move) * m.emit[:, s]
            total += math.log10(now.sum()) + math.log10(share)
            now = now / now.sum()
        assert r.score == pytest.approx(total, rel=1e-9)
        assert r.n_known == sum(w in counts for w in words)


def test_forward_is_exact_and_em_climbs():
    rng = np.random.default_rng(9)
    m = hmm.first_guess(rng.random(6), 2, 1)
    seq = np.array([0, 3, 5, 1])
    import itertools

    p = sum(m.start[s[0]] * m.emit[s[0], seq[0]] * np.prod([m.move[s[t - 1], s[t]] * m.emit[s[t], seq[t]] for t in range(1, 4)]) for s in itertools.product(range(2), repeat=4))
    long = rng.integers(0, 6, 300)
    got = hmm.log_likelihoods(m, [seq, long, seq[:1]])
    assert got[0] == pytest.approx(np.log10(p)) and got[2] == pytest.approx(np.log10(m.start @ m.emit[:, 0]))
    obs = np.array([[0, 1] * 10, [4, 5] * 10])
    last = -np.inf
    for _ in range(5):
        s, mv, em, ll = hmm.forward_backward(m, obs, np.ones(obs.shape, bool), np.array([True, True]))
        assert ll >= last - 1e-3
        last = ll
        m = hmm.Hmm((s + 1e-9) / (s + 1e-9).sum(), (mv + 1e-9) / (mv + 1e-9).sum(1, keepdims=True), ((em + 1e-9) / (em + 1e-9).sum(0)).T)


@pytest.mark.parametrize("limit", [200_000, 1])
def test_decontamination(spark, monkeypatch, limit):
    """Prefixes sent to all tasks, and met in a shuffle."""
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
    w = WORDS
    items = [(1, " ".join(w[:20])), (2, "Alpha beta"), (3, None), (4, " ".join(w[:20])), (5, "ÀB c"), (6, "...")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, key string")
    rows = [(10, "x " + " ".join(w[:20]).upper() + " y"), (11, " ".join(w[:12])), (12, "ALPHA, beta; " * 3), (13, "àb c"), (14, "Àb C"), (15, "alpha"), (16, " ".join(w[5:19]) + " z" * 2000), *ODD, (10, "another text of this id")]
    docs = docs_of(spark, rows)
    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    want = Counter()
    for i, t in rows:
        d, hit, found = lower(t), set(), set()
        for k, it in items:
            q = lower(it)
            n = min(13, len(q))
            wins = {tuple(q[s : s + n]) for s in range(len(q) - n + 1)} if q else set()
            for s in range(len(d) - n + 1) if n else ():
                if tuple(d[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found.add(str(k))
        want[(i, len(d), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(d))] += 1
    assert Counter(map(tuple, decontam.contamination(docs, bench).collect())) == want
    # whole windows count however long the document is, short items by their share
    bad = {10, 12, 14, 16}
    rows = [r for r in rows if r[1] != "another text of this id"] + [(17, "another text of this id")]
    docs = docs_of(spark, rows)
    assert {k[0] for k in want if k[5]} == bad - {16}
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in rows if i not in bad)
    assert decontam.contamination(docs.limit(0), bench).count() == 0 and decontam.clean(docs.limit(0), bench).count() == 0
    assert not decontam.contamination(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() and decontam.clean(docs, bench.limit(0)).count() == len(rows)


def test_toxicity(spark):
    rng = np.random.default_rng(10)
    rows, marks = [], []
    for i in range(300):
        bad = i % 6 == 0
        ws = [WORDS[j] for j in rng.integers(0, 400, 60)]
        if bad:
            for _ in range(3):
                ws[int(rng.integers(0, 60))] = ["horrid", "nasty", "vile"][int(rng.integers(0, 3))]
        rows.append((i, " ".join(ws)))
        marks.append((i, 1, int(bad), "t"))
    docs = docs_of(spark, rows + ODD)
    labels = spark.createDataFrame(marks + [(5000, 1, None, "t"), (None, 1, 1, "t")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.fit(docs, labels, crc_mod("doc_id", 4) != 2)
    got = toxicity.score(docs, model).select("doc_id", "score", (crc_mod("doc_id", 4) == 2).alias("held")).collect()
    held = [(r.score >= 0.3, r.doc_id % 6 == 0) for r in got if r.held and r.doc_id is not None and r.doc_id > 5]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and any(b for _, b in held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows) + len(ODD)
    for few in (labels.limit(0), labels.where("toxic = 0")):
        m = toxicity.fit(docs, few, crc_mod("doc_id", 4) != 2)
        assert 0 < m.score("text") < 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_scores_and_fit_against_plain_loops(spark):
    """Scores by loops over n-grams of characters; the intercept is where the likelihood has no slope."""
    rng = np.random.default_rng(21)
    texts = ["".join("abcdeéß 😀"[j] for j in rng.integers(0, 9, 40)) + (" horrid" if i % 5 == 0 else " fine") for i in range(150)] + ["", None, "İ" * 10]
    docs = docs_of(spark, list(enumerate(texts))).withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))

    def ids(text):
        chars, found = [ord(c) for c in (text or "").lower()], set()
        for n in toxicity.NGRAMS:
            for at in range(len(chars) - n + 1):
                h = (chars[at] * int(toxicity._SALT[0]) + n * 0x85EBCA6B) % 2**32
                for j in range(1, n):
                    h = (h * 0x01000193 + chars[at + j] * int(toxicity._SALT[j])) % 2**32
                h ^= h >> 15
                found.add(h * 0x2C1B3C6D % 2**32 >> 32 - toxicity.BITS)
        return found

    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}  # a column of that name is replaced
    rest = 0.0
    for i, t in enumerate(texts):
        z = model.intercept + sum(float(model.weights[k]) for k in ids(t))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)
        if i < 150:
            rest += got[i] - (i % 5 == 0)
    assert abs(rest) < 1.5 and np.count_nonzero(model.weights) > 10


def test_toxicity_prior_when_the_sample_is_capped(spark, monkeypatch):
    """Labels whose texts tell nothing: the score is the share of all labelled rows, capped or not."""
    docs = docs_of(spark, [(i, f"text {i % 7}") for i in range(1000)])
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 50)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 100)
    monkeypatch.setattr(toxicity, "FEATURES", 0)
    assert toxicity.fit(docs, labels, F.lit(True)).score("text") == pytest.approx(0.1, abs=0.02)
    none = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert none.score("text") == pytest.approx(1 / 901, rel=0.2)


def test_long_text_in_turns(monkeypatch):
    text = " ".join(WORDS) * 3
    every = np.ones(1 << toxicity.BITS, np.uint8)
    whole = toxicity.present(text, every)
    monkeypatch.setattr(toxicity, "TURN", 100)
    assert (toxicity.present(text, every) == whole).all()


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    enc = token_counts.load_encoding(path, P.PATTERN)
    texts = ["a b  c", "x\n y", "x\n\n y", "x \ny", "x\n \ny", " lead", "trail ", "it's 3,000 café ok", "  z", "a\x1cb c", "👍 ok", "", None, "word " * 5000, "same", "same"]
    rng = np.random.default_rng(11)
    bits = [" ", "  ", "\n", "\t", "a", "B1", "'s", ".", "é", "\r\n"]
    texts += ["".join(bits[i] for i in rng.integers(0, len(bits), 20)) for _ in range(300)]
    want = Counter(len(enc.encode_ordinary(t or "")) for t in texts)
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs_of(spark, list(enumerate(texts))), path, P.PATTERN)).cache()
    rows = sums.collect()
    assert {r.n_tokens: r.n_docs for r in rows} == want
    lengths = sorted(want.elements())
    for r in rows:
        assert r.docs_ge == sum(n >= r.n_tokens for n in lengths) and r.docs_le == sum(n <= r.n_tokens for n in lengths)
        assert r.tokens_ge == sum(n for n in lengths if n >= r.n_tokens) and r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)
    for limit in (0, 1, 7, 11, 10**6):
        assert token_counts.truncated_total(sums, limit).first()[0] == sum(min(n, limit) for n in lengths)
    for q in (0.0, 0.5, 0.9, 1.0):
        assert token_counts.quantile(sums, q).first()[0] == lengths[max(0, math.ceil(q * len(lengths)) - 1)]
    assert token_counts.suffix_sums(token_counts.length_histogram(docs_of(spark, [(1, "a")]).limit(0), path, P.PATTERN)).count() == 0
    assert P.PATTERN == token_counts.SPACED
    other = r" ?\p{L}+ ?\p{L}*|\s+|[^\s\p{L}]+"  # pieces that hold inner spaces
    enc = token_counts.load_encoding(path, other)
    hist = token_counts.length_histogram(docs_of(spark, list(enumerate(texts))), path, other).collect()
    assert {r.n_tokens: r.n_docs for r in hist} == Counter(len(enc.encode_ordinary(t or "")) for t in texts)


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 7)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(120)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(120, 160)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan"), 1.0]), (203, [float("inf")]), (None, [1.0] * 4), (204, []), (7, [0.1] * 4), (250, [2.0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for i in sorted({i for i, _ in ok if i % 10 == 0}):
        q = min(v for j, v in ok if j == i)
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i)[:5]
        want |= {(i, k, j, -s) for k, (s, j) in enumerate(best, 1)}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect()} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_sparse_postings_agree():
    rng = np.random.default_rng(13)
    q, c = (rng.integers(-5, 5, (9, 8)) * (rng.random((9, 8)) < 0.3) for _ in range(2))
    assert (topk.accumulate(q, c) == q @ c.T).all()
