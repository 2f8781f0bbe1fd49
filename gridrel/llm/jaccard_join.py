"""N-gram Jaccard join by chosen paths: sampled shared tokens split the sets, small buckets are compared."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrel.llm.common import free, shuffle_width, spread_join, stash
from gridrel.llm.components import components

GRAM, SIMILAR, RECALL = 5, 0.8, 0.999
#: Levels of a path, and the bucket size up to which no further level is taken.
DEPTH, BUCKET = 3, 64
#: Sketches: 16 bits of the minimum of each of so many ranges of tokens.  Of two texts at SIMILAR
#: all but a few in 10**6 agree in MAYBE of them; one that agrees in ALIKE with a leader stands behind it.
SKETCH, MAYBE, ALIKE = 64, 0.55, 0.95
#: Texts, and tokens, of a block of sets that are compared with those of another, and columns of their product at a time.
BLOCK, BLOCK_TOKENS, COLUMNS = 512, 1 << 19, 1 << 12
#: Products of paths and tokens that are held at once, and bytes of a text that are split at once.
CELLS, TURN = 1 << 20, 1 << 20
#: Ids of texts that a task remembers to pass each only once.
KNOWN = 100_000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = re.compile(rb"\s")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, gram: int = GRAM) -> np.ndarray:
    """Sorted distinct hashes of the runs of `gram` words (A-Z in lower case, split at ASCII white space).

    A text of fewer words, but not none, is one shingle of all of them; a null has none.  A long
    text is split TURN bytes at a time.
    """
    data, at, parts = (text or "").encode().lower(), 0, []
    while at < len(data):
        end = len(data)
        if end - at > TURN and (cut := _SPACE.search(data, at + TURN)):
            end = cut.start()
        words = data[at:end].split()
        parts.append(_word_hashes(words))
        at = end
    one = np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.empty(0, np.uint64)
    if not len(one):
        return one
    if len(one) < gram:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(data.split()))], np.uint64)
    n = len(one) - gram + 1
    h = np.full(n, gram, np.uint64)
    for j in range(gram):
        h = mixed(h ^ (one[j : j + n] + np.uint64(j)))
    return np.unique(h)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def survival(b: float, similar: float, depth: int) -> float:
    """Least chance that two sets of overlap b share a path of `depth` levels in one run.

    At every level each set takes its tokens with chance 1 / (similar * size), so common tokens
    taken by both are close to a Poisson number of mean b / similar, and each goes on by itself.
    """
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-b / similar * p)
    return p


def runs_for(similar: float, depth: int, recall: float) -> int:
    """Runs repeat until a pair at the threshold is missed by all of them with at most 1 - recall."""
    runs, missed = 0, 1.0
    while missed > 1 - recall:
        missed *= 1 - survival(similar, similar, depth)
        runs += 1
    return runs


def _taken(at: np.ndarray, tokens: np.ndarray, cut: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(path, token) places of the tokens that each path takes, CELLS products at a time: at is odd, and tokens are hashes."""
    step = max(1, CELLS // len(at))
    found = []
    for k in range(0, len(tokens), step):
        path, token = np.nonzero(at[:, None] * tokens[None, k : k + step] < cut)
        found.append((path, token + k))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]


def chosen_paths(tokens: np.ndarray, runs: int, depth: int, similar: float, seed: int = 0) -> np.ndarray:
    """(n, depth) path ids of one set: rows are leaves, 0 where a branch died out before."""
    cut = np.uint64(min(2**64 - 1, int(2**64 / (similar * len(tokens)))))
    rows: list[np.ndarray] = []
    live = np.zeros((runs, depth), np.uint64)
    at = mixed(np.arange(1, runs + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)
    for level in range(depth):
        parent, token = _taken(at, tokens, cut)
        ids = mixed(mixed(at[parent] + np.uint64(level)) ^ tokens[token]) | np.uint64(1)
        ended = np.setdiff1d(np.arange(len(at)), parent)
        if level:
            rows.append(live[ended])
        live = live[parent]
        live[:, level] = ids
        at = ids
        if not len(at):
            return np.concatenate(rows) if rows else live
    return np.concatenate([*rows, live])


_RANGES = np.arange(SKETCH, dtype=np.uint64) * np.uint64(2**64 // SKETCH)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """16 bits of the least token of each of SKETCH ranges of the hash; 0 for a range without one.  Tokens are sorted."""
    first = np.searchsorted(tokens, _RANGES)
    some = first < np.append(first[1:], len(tokens))
    out = np.zeros(SKETCH, np.uint16)
    out[some] = (tokens[first[some]] & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out


PATHS_DDL = "id binary, n int, sketch binary, paths array<long>"


def _paths(runs: int, similar: float, gram: int):
    schema = pa.schema([("id", pa.binary()), ("n", pa.int32()), ("sketch", pa.binary()), ("paths", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for id_, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if id_ in known:
                        continue
                    if len(known) >= KNOWN:
                        known.clear()
                    known.add(id_)
                    if len(tokens := shingles(text.as_py(), gram)):
                        rows.append((id_, len(tokens), sketch(tokens).tobytes(), chosen_paths(tokens, runs, DEPTH, similar).astype(np.int64).ravel()))
                yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema=schema)

    return run


def text_id(text: str = "text"):
    """128 bits for a text: rows with equal texts are one text to the join."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def buckets(paths: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(bucket, id): each leaf ends at the first level whose bucket holds at most `bucket` texts, or the last.

    Only sizes are exchanged: a text's deeper paths are known beforehand.
    """
    leaves = paths.select("id", F.posexplode(F.expr(f"transform(sequence(0, size(paths) - 1, {DEPTH}), i -> slice(paths, i + 1, {DEPTH}))")).alias("leaf", "p")).where(F.size("paths") > 0)
    rest = leaves.select("id", *[F.col("p")[i].alias(f"p{i}") for i in range(DEPTH)])
    done, levels = None, []
    for level in range(DEPTH):
        here = rest.where(f"p{level} <> 0")
        sizes = stash(here.select(f"p{level}", "id").distinct().groupBy(f"p{level}").agg(F.count("*").alias("size")).where("size > 1"), "join-sizes")
        here = stash(spread_join(here, sizes, f"p{level}", "size", "inner"), "join-level")
        levels += [sizes, here]
        ends = here.where(F.lit(True) if level == DEPTH - 1 else F.col("size") <= bucket).select(F.col(f"p{level}").alias("bucket"), "id", "size").distinct()
        done = ends if done is None else done.union(ends)
        rest = here.where(F.col("size") > bucket).drop("size")
    out = stash(done, "join-buckets")
    free(*levels)
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the ranges with a token of either in which each row of a and each row of b agree."""
    x, y = a[:, None, :], b[None, :, :]
    return ((x == y) & (x != 0)).sum(2) / np.maximum(((x != 0) | (y != 0)).sum(2), 1)


def near(ids: list[bytes], sketches: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Joins the texts of a bucket that may be similar: one edge from the first text of each joined set to each other.

    Texts that agree with an earlier leader in ALIKE are joined to it and take no further part:
    what is similar to such a text is at most 1 - ALIKE farther from its leader, still above MAYBE.
    """
    root, left = np.arange(len(ids)), np.arange(len(ids))
    while len(left) > 1:
        lead, rest = left[0], left[1:]
        share = _agree(sketches[lead : lead + 1], sketches[rest])[0]
        for other in np.unique(root[rest[share >= MAYBE]]):
            if other != root[lead]:
                old, new = max(other, root[lead]), min(other, root[lead])
                root[root == old] = new
        left = rest[share < ALIKE]
    return [(ids[root[i]], ids[i]) for i in np.flatnonzero(root != np.arange(len(ids)))]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows (bucket, part, id, sketch) sorted by the first two; a run of equal keys is one group."""
    held = None
    for more in batches:
        now = pa.Table.from_batches([more]) if held is None else pa.concat_tables([held, pa.Table.from_batches([more])])
        if not now.num_rows:
            continue
        b, p = now["bucket"].to_numpy(), now["part"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (p[1:] != p[:-1])])
        held = now.slice(int(starts[-1]))
        yield _groups(now.slice(0, int(starts[-1])), starts[:-1])
    if held is not None:
        yield _groups(held, np.array([0]))


def _groups(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    out: list[tuple[bytes, bytes]] = []
    if rows.num_rows:
        ids = rows["id"].to_pylist()
        sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(-1, SKETCH)
        for a, b in zip(starts, np.r_[starts[1:], len(ids)], strict=True):
            if b - a > 1:
                out += near(ids[a:b], sketches[a:b])
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.binary()) for k in (0, 1)], names=["a", "b"])


def near_edges(done: DataFrame, sketches: DataFrame, spread: int = 4_096) -> DataFrame:
    """Edges between texts that may be similar.  A bucket of more than `spread` texts is compared in parts,
    pairs of which then meet, so that no task holds it and no pair of its texts is left out."""
    width = shuffle_width(done.sparkSession)
    parts = F.ceil(F.col("size") / spread).cast("int")
    mine = F.pmod(F.xxhash64("id"), parts).cast("int")
    # part i meets part j in the group (min, max); alone it is the group (i, i)
    meets = F.when(parts > 1, F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(mine, j) * 65536 + F.greatest(mine, j))).otherwise(F.array(F.lit(0)))
    rows = done.select("id", "bucket", F.explode(meets).alias("part")).join(sketches.select("id", "sketch"), "id")
    rows = rows.repartition(width, "bucket", "part").sortWithinPartitions("bucket", "part", "id")
    return rows.select("bucket", "part", "id", "sketch").mapInArrow(_edges, "a binary, b binary").distinct()


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted sets: products of 0/1 matrices, columns in turns."""
    tokens, place = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    counts = np.bincount(place, minlength=len(tokens))
    column = np.cumsum(counts > 1) - 1  # tokens of one set alone meet nothing
    n_columns = int((counts > 1).sum())
    use = counts[place] > 1
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])[use]
    col = column[place[use]]
    out = np.zeros((len(x), len(y)))  # each turn's product is exact in float32, their sum would not be from 2**24 on
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, n_columns, COLUMNS):
        a, b = np.searchsorted(col, [at, at + COLUMNS])
        m = np.zeros((len(x) + len(y), min(COLUMNS, n_columns - at)), np.float32)
        m[row[a:b], col[a:b] - at] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out


def _verify(similar: float):
    """Brute force over the buckets whose texts are in blocks i and j of a group: exact similarity of all pairs that met in one."""

    def run(group: pa.Table) -> pa.Table:
        place = {id_: k for k, id_ in enumerate(group["id"].to_pylist())}  # a text may come more than once
        ids = sorted(place)
        rows = [place[id_] for id_ in ids]
        sets = [np.frombuffer(group["tokens"][k].as_py(), np.uint64) for k in rows]
        met = [np.asarray(group["met"][k].values) for k in rows]
        i, j, block = group["i"][0].as_py(), group["j"][0].as_py(), group["block"].to_numpy()[rows]
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        n = np.array([len(s) for s in sets], float)
        links, edges = np.zeros(len(ids), np.int64), []
        root = np.arange(len(ids))
        for at in range(0, len(left), BLOCK):
            a = left[at : at + BLOCK]
            both = overlaps([sets[k] for k in a], [sets[k] for k in right])
            # |x & y| >= s |x | y|, in float64: sizes are exact, and the product's rounding is far below the slack
            ok = both >= similar * (n[a][:, None] + n[right][None, :] - both) - 1e-6
            ok &= a[:, None] != right[None, :]
            ok &= overlaps([met[k] for k in a], [met[k] for k in right]) > 0
            np.add.at(links, a, ok.sum(1))
            if i != j:
                np.add.at(links, right, ok.sum(0))
            for k, row in zip(a, ok, strict=True):
                near_k = right[row]
                for m in near_k[root[near_k] != root[k]]:
                    if root[m] != root[k]:
                        old, new = max(root[m], root[k]), min(root[m], root[k])
                        root[root == old] = new
                        edges.append((ids[k], ids[m], 0))
        rows = edges + [(ids[k], None, int(links[k])) for k in np.flatnonzero(links)]
        kinds = {"a": pa.binary(), "b": pa.binary(), "links": pa.int64()}
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())})

    return run


def _token_rows(gram: int):
    """(id, text, ...) to (id, tokens, ...), each text once a task while it is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, new, tokens = batch.slice(at, 256), [], []
                for k, (id_, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1), strict=True)):
                    if id_ in known:
                        continue
                    if len(known) >= KNOWN:
                        known.clear()
                    known.add(id_)
                    new.append(k)
                    tokens.append(shingles(text.as_py(), gram).tobytes())
                kept = part.take(pa.array(new, pa.int32()))
                yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(tokens, pa.binary()), *[kept.column(k) for k in range(2, part.num_columns)]], names=["id", "tokens", *part.schema.names[2:]])

    return run


def similar_texts(docs: DataFrame, similar: float = SIMILAR, gram: int = GRAM, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of distinct texts: (id, label) and (id, links), for texts that have a link.

    1. Every distinct text draws its chosen paths for all runs, and a sketch of its shingle set.
    2. Paths split texts into buckets until these are small.  Texts of a bucket whose sketches
       agree in MAYBE belong to one group, and so do groups that share a text.
    3. Buckets are brute-forced on whole sets, those of one group together, so that a set moves
       once a block and a pair that met in many buckets is compared once: all pairs that met in
       a bucket are compared exactly, and their links counted.  The components of linked texts
       are the classes.

    A group is cut into blocks by its texts and by its tokens, and a task holds two blocks.  A
    pair at the threshold meets in a bucket of some run with a chance of at least recall (see
    survival()); the sketches lose a few pairs in 10**6 of those.  Texts without shingles take no
    part; an empty table has no classes.
    """
    runs = runs_for(similar, DEPTH, recall)
    texts = docs.select(text_id().alias("id"), F.col("text").cast("string").alias("text"))
    paths = stash(texts.mapInArrow(_paths(runs, similar, gram), PATHS_DDL), "join-paths")
    one = stash(paths.groupBy("id").agg(F.first("sketch").alias("sketch"), F.first("n").alias("n")), "join-sketches")
    done = buckets(paths)
    edges = stash(near_edges(done, one), "join-edges")
    coarse = components(edges)
    met = done.groupBy("id").agg(F.collect_list("bucket").alias("met"))
    held = stash(coarse.join(one.select("id", "n"), "id").join(met, "id"), "join-members")
    sizes = held.groupBy("label").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    n_blocks = F.greatest(F.ceil(F.col("size") / (2 * BLOCK)), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    sizes = stash(sizes.select("label", "size", n_blocks.alias("blocks")), "join-groups")
    members = spread_join(held, sizes, "label", "size", "inner").select("id", "label", "blocks", "met")
    # of the rows of one text only that of the smallest doc_id moves, so a text of many copies is no hot key
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    ids = docs.select(text_id().alias("id"), doc.alias("doc"))
    first = ids.groupBy("id", "doc").agg(F.count("*").alias("held")).groupBy("id").agg(F.min(F.struct("doc", "held")).alias("f")).select("id", "f.doc", "f.held")
    some = stash(members.join(first, "id"), "join-some")
    few = spread_join(docs.select(text_id().alias("id"), doc.alias("doc"), F.col("text").cast("string").alias("text")), some, ["id", "doc"], "held", "inner")
    tokens = few.select("id", "text", "label", "blocks", "met").mapInArrow(_token_rows(gram), "id binary, tokens binary, label binary, blocks int, met array<long>")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    blocked = tokens.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocked = blocked.select("id", "tokens", "met", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = stash(blocked.groupBy("label", "i", "j").applyInArrow(_verify(similar), "a binary, b binary, links long"), "join-verified")
    free(paths, one, done, edges, coarse, held, some, sizes)
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    return components(found.where("b is not null")), links


def _per_text(docs: DataFrame, similar: float, gram: int, recall: float) -> DataFrame:
    """Per distinct text with words: id, copies, label (null without links), links; least, the smallest doc_id
    of its rows (null if all are null) and how many rows have that (held); class_least and class_text, the
    smallest doc_id of its class and the text that has it."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("id")).where(_has_words())
    found, links = similar_texts(docs, similar, gram, recall)
    rows = ids.groupBy("id", "doc_id").agg(F.count("*").alias("n"))
    rows = rows.groupBy("id").agg(F.sum("n").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("n").alias("held"))).alias("f"))
    rows = rows.select("id", "copies", F.col("f.doc_id").alias("least"), F.col("f.held").alias("held"))
    texts = stash(rows.join(found, "id", "left").join(links, "id", "left"), "join-texts")
    ends = texts.where("label is not null").groupBy("label").agg(F.count("*").alias("texts"), F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc"), "id")).alias("c"))
    ends = stash(ends.select("label", "texts", F.col("c.doc").alias("class_least"), F.col("c.id").alias("class_text")), "join-classes")
    out = spread_join(texts, ends, "label", "texts")
    of_class = lambda c, own: F.when(F.col("label").isNull(), F.col(own)).otherwise(F.col(c)).alias(c)
    return stash(out.select("id", "copies", "label", "links", "least", "held", of_class("class_least", "least"), of_class("class_text", "id")), "join-texts")


def _has_words():
    return F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))


def classes(docs: DataFrame, similar: float = SIMILAR, gram: int = GRAM, recall: float = RECALL) -> DataFrame:
    """Per row of docs: doc_id, class_id, n_links, n_copies.

    class_id is the smallest doc_id of the row's class: rows of equal text, and of texts joined
    by links.  n_links counts the other distinct texts at a Jaccard similarity of word `gram`
    shingles of at least `similar`; n_copies the other rows of the same text.  Rows without
    words (null, empty, white space) have no shingles: each is a class of its own without links
    or copies.  A null doc_id in a class counts as larger than all; a class of null ids is null.
    Columns other than doc_id and text are not read; an empty table gives an empty result.
    """
    texts = _per_text(docs, similar, gram, recall)
    zero = F.lit(0).cast("long")
    grouped = texts.where("links > 0 or copies > 1").select("id", "copies", F.col("class_least").alias("class_id"), F.coalesce("links", zero).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    # a row without words has no key
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(_has_words(), text_id()).alias("id"))
    out = spread_join(ids, grouped, "id", "copies")
    return out.select("doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_copies", zero).alias("n_copies"))


def one_of_each(docs: DataFrame, similar: float = SIMILAR, gram: int = GRAM, recall: float = RECALL) -> DataFrame:
    """One row of docs, with its own columns, for each class: the one with the smallest doc_id.

    Rows without words all stay.  Rows are judged one by one: rows that share a doc_id, or have
    none, stay or go by their own texts.  Of the texts of a class that share the smallest doc_id
    the one with the least text_id() stands for it, and of rows alike in both doc_id and text the
    one whose columns come first as JSON.  A null doc_id counts as larger than all.  An empty
    table gives an empty result.
    """
    texts = _per_text(docs, similar, gram, recall).where("label is not null or copies > 1")
    texts = texts.select(F.col("id").alias("__id"), "copies", (F.col("id") == F.col("class_text")).alias("__stands"), F.col("least").alias("__least"), F.col("held").alias("__held"))
    rows = docs.withColumn("__id", F.when(_has_words(), text_id()))
    rows = spread_join(rows, texts.withColumnRenamed("copies", "__copies"), "__id", "__copies")
    stay = F.col("__stands").isNull() | (F.col("__stands") & F.col("doc_id").cast("long").eqNullSafe(F.col("__least")))
    rows = rows.where(stay)
    if texts.where("__held > 1").isEmpty():
        return rows.select(docs.columns)
    alike = F.coalesce(F.col("__held") > 1, F.lit(False))
    row = F.struct(*[F.col(c) for c in docs.columns])
    best = rows.where(alike).groupBy("__id").agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return rows.where(~alike).select(docs.columns).union(best.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))
