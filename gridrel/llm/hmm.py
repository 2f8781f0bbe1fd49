"""LM scoring: a hidden Markov model over word classes, trained by distributed Baum-Welch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrel.llm.common import shuffle_width, stash

STATES, ROUNDS = 8, 4
#: Words with symbols of their own, the most frequent; all others share the symbols of classes.
HEAD = 32_768
#: A class of words: up to eight of length times two of alphabet times four of ending.
CLASSES = 64
END = b"\n"  # not a word: words hold no white space
#: Words that a task holds before it counts them and passes the counts on, and bytes of text split at once.
HELD_WORDS, TURN = 1 << 22, 1 << 23
WINDOW, ROWS = 128, 2_048
#: Tokens of documents that are scored together.
SCORE_TOKENS = 1 << 20
SCORE_STEP = 64


def tokens(text: str | None) -> list[bytes]:
    """Words of one text, as words_of finds them in many."""
    return (text or "").encode().lower().split()


def turns(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of at most TURN bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TURN, side="right"))
        yield batch.slice(at, max(upto, at + 1) - at)
        at = max(upto, at + 1)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts one after another, A-Z in lower case, and the number of each text's.

    The ASCII kernels know A-Z and [\x20\x09-\x0D] only, as the contract asks; a null has no words.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty piece
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    return flat.filter(some), np.bincount(row[some.to_numpy(zero_copy_only=False)], minlength=len(lists))


def word_classes(words: pa.Array) -> np.ndarray:
    """Classes of words that are not empty: of length, alphabet and last byte."""
    size = pc.binary_length(words).to_numpy().astype(np.int64)
    if not len(size):
        return size
    # the words stand one after another in the buffer
    first = int(np.frombuffer(words.buffers()[1], np.int32)[words.offset])
    last = np.frombuffer(words.buffers()[2], np.uint8)[first + np.cumsum(size) - 1].astype(np.int64)
    foreign = ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
    return np.minimum(size >> 2, 7) << 3 | foreign.astype(np.int64) << 2 | (last >> 1 & 3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []
    texts = size = 0

    def out() -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held, pa.string()))
        return pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "c"])

    for batch in batches:
        for part in turns(batch, 0):
            held.append(words_of(part.column(0))[0])
            texts, size = texts + part.num_rows, size + len(held[-1])
            if size > HELD_WORDS:
                yield out()
                held, size = [], 0
    yield out()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], names=["word", "c"])


@dataclass
class Vocabulary:
    """counts: a table of every training word, and the end; head: the words with own symbols, by rank; per class, its totals."""

    counts: DataFrame
    total: int
    distinct: int
    ends: int
    head: dict[bytes, int]
    head_counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray


def vocabulary(train: DataFrame, head: int = HEAD) -> Vocabulary:
    """Counts of all training tokens.  The head are the most frequent words, at most `head` of them.

    It ends between two levels of counts, a sixteenth of an octave wide, so that it is found from
    the numbers of words a level, and no task has to sort the words.  The end is no part of it:
    it has a symbol of its own whatever its count.
    """
    counts = stash(train.select(F.col("text").cast("string")).mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    is_end = F.col("word") == F.lit(bytearray(END))
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(is_end, F.col("c"))), F.lit(0)).alias("ends")).first()
    words = counts.where(~is_end).withColumn("level", F.floor(F.log2("c") * 16).cast("int"))
    room, least = head, 0
    for r in sorted(words.groupBy("level").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):  # 16 levels an octave: about 1,000 rows at most
        if r.n > room:
            least = r.level + 1
            break
        room -= r.n
    top = sorted(((-r.c, bytes(r.word)) for r in words.where(F.col("level") >= least).collect()))  # at most `head` words
    # bytes of the word in JVM expressions, as in word_classes
    n, last = F.octet_length("word"), F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int")
    ascii_only = F.octet_length("word") == F.char_length(F.decode("word", "UTF-8"))
    kind = F.shiftleft(F.least(F.shiftright(n, 2), F.lit(7)), 3) + F.when(ascii_only, 0).otherwise(4) + F.shiftright(last, 1).bitwiseAND(3)
    tokens_of, words_of = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.where(F.col("level") < least).groupBy(kind.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # CLASSES rows
        tokens_of[r.k], words_of[r.k] = r.n, r.v
    return Vocabulary(counts, size.n, size.v, size.ends, {w: i for i, (_, w) in enumerate(top)}, np.array([-c for c, _ in top], float), tokens_of, words_of)


TOKENISED = "doc_id long, held_out boolean, symbols array<int>, tail array<struct<word:binary,n:int>>, n_tokens long, head_known long, head_log double"


def tokenise(docs: DataFrame, held_out: Column, v: Vocabulary) -> DataFrame:
    """Symbols of whole texts; words without own symbols go along with their numbers (tail)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((list(v.head), np.log10(v.head_counts + 1)))  # at most HEAD words
    ends = v.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs = sent.value
        heads, n_head = pa.array([w.decode() for w in words], pa.string()), len(words)
        end = n_head + CLASSES
        logs = np.concatenate([logs, np.zeros(CLASSES), [np.log10(ends + 1)]])  # nothing for symbols of classes
        offsets = lambda sizes: pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        for batch in batches:
            for part in turns(batch, 2):
                found, n = words_of(part.column(2))
                row = np.repeat(np.arange(len(n)), n)
                ids = pc.fill_null(pc.index_in(found, value_set=heads), -1).to_numpy(zero_copy_only=False).copy()
                outside = ids < 0
                tail = found.filter(pa.array(outside)).dictionary_encode()
                codes, distinct = tail.indices.to_numpy(), tail.dictionary
                ids[outside] = n_head + word_classes(distinct)[codes]
                pairs, times = np.unique(row[outside] * max(len(distinct), 1) + codes, return_counts=True)
                in_row, word = np.divmod(pairs, max(len(distinct), 1))
                tails = pa.StructArray.from_arrays([distinct.cast(pa.binary()).take(pa.array(word)), pa.array(times, pa.int32())], ["word", "n"])
                known = np.bincount(row[~outside], minlength=len(n)) + (ends > 0)
                head_log = np.bincount(row, logs[ids], len(n)) + logs[end]
                symbols = np.insert(ids, np.cumsum(n), end).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(offsets(n + 1), pa.array(symbols)), pa.ListArray.from_arrays(offsets(np.bincount(in_row, minlength=len(n))), tails), pa.array(n + 1), pa.array(known), pa.array(head_log)],
                    names=["doc_id", "held_out", "symbols", "tail", "n_tokens", "head_known", "head_log"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENISED)


@dataclass
class Hmm:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (K, symbols)


def first_guess(weights: np.ndarray, states: int, seed: int) -> Hmm:
    """Sticky moves; emissions are the symbols' shares, tilted at random for each state."""
    rng = np.random.default_rng(seed)
    emit = weights * np.exp(rng.normal(0, 0.7, (states, len(weights))))
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1) if states > 1 else 1 - 0.0)
    return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def forward_backward(model: Hmm, obs: np.ndarray, mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts over rows of symbols (B, T): of starts, moves, (symbols, K) emissions; log-likelihood.

    mask: which places hold a symbol (a prefix of each row); first: which rows begin a document;
    the others start from the model's long-run share of states.
    """
    k, (b, t_max) = len(model.start), obs.shape
    move, emit = model.move.astype(np.float32), np.ascontiguousarray(model.emit.T.astype(np.float32))
    share = np.linalg.matrix_power(model.move, 64)[0].astype(np.float32)
    e = emit[obs.T]  # (T, B, K)
    whole = mask.all(0)
    if not whole.all():
        e[~mask.T] = 1.0
    alpha, scale = np.empty((t_max, b, k), np.float32), np.ones((t_max, b), np.float32)
    now = np.where(first[:, None], model.start.astype(np.float32), share) * e[0]
    for t in range(t_max):
        if t:
            now = alpha[t - 1] @ move
            now *= e[t]
        s = now.sum(1)
        np.maximum(s, 1e-30, out=s)
        scale[t] = s
        np.divide(now, s[:, None], out=alpha[t])
    beta, back_move = np.ones((b, k), np.float32), np.ascontiguousarray(move.T)
    # with these scales alpha * beta sums to 1 over the states
    moves, gamma = np.zeros((k, k)), alpha
    for t in range(t_max - 1, 0, -1):
        x = e[t]
        x *= beta
        x /= scale[t][:, None]
        if not whole[t]:
            x[~mask[:, t]] = 0
        moves += alpha[t - 1].T @ x
        back = x @ back_move
        beta = back if whole[t] else np.where(mask[:, t, None], back, np.float32(1))
        gamma[t - 1] *= beta
    moves *= move
    on = mask.T
    flat, weight = (obs.T.ravel(), gamma.reshape(-1, k)) if whole.all() else (obs.T[on], gamma[on])
    weight = np.ascontiguousarray(weight.T)
    emits = np.stack([np.bincount(flat, weight[i], emit.shape[0]) for i in range(k)], 1)
    return gamma[0][first].sum(0), moves, emits, float(np.log(scale[on]).sum())


def _windows(symbols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents cut into rows of WINDOW symbols, ROWS of them at a time."""
    cuts = [(s[at : at + WINDOW], at == 0) for s in symbols for at in range(0, len(s), WINDOW)]
    cuts.sort(key=lambda c: len(c[0]))
    for at in range(0, len(cuts), ROWS):
        part = cuts[at : at + ROWS]
        sizes = np.array([len(c[0]) for c in part])
        obs = np.zeros((len(part), sizes.max()), np.int32)
        for i, (c, _) in enumerate(part):
            obs[i, : len(c)] = c
        yield obs, np.arange(obs.shape[1]) < sizes[:, None], np.array([c[1] for c in part])


COUNTS = "row int, g array<double>"


def baum_welch(train: DataFrame, model: Hmm, rounds: int = ROUNDS, smooth: float = 0.05) -> Hmm:
    """Rounds of EM; each round sums the tasks' expected counts by row (symbols, then moves, starts)."""
    spark, (k, m) = train.sparkSession, model.emit.shape
    share = model.emit.mean(0)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((model.start, model.move, model.emit.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now = Hmm(*sent.value)
            total = np.zeros((m + k + 1, k))
            held: list[np.ndarray] = []
            size = 0

            def add() -> None:
                for obs, mask, first in _windows(held):
                    starts, moves, emits, _ = forward_backward(now, obs, mask, first)
                    total[:m] += emits
                    total[m : m + k] += moves
                    total[m + k] += starts

            for batch in batches:
                column = batch.column(0)
                flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    held.append(flat[a:b])
                    size += b - a
                    if size >= WINDOW * ROWS:
                        add()
                        held, size = [], 0
            add()
            rows = np.flatnonzero(total.any(1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(total[rows].ravel()))], names=["row", "g"])

        tasks = train.select("symbols").mapInArrow(run, COUNTS)
        summed = tasks.groupBy("row").agg(*[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(k)])
        got = summed.toPandas().sort_values("row")  # HEAD + CLASSES + STATES + 2 rows at most
        total = np.zeros((m + k + 1, k))
        total[got["row"].to_numpy(int)] = got[[f"g{i}" for i in range(k)]].to_numpy(float)
        emit = total[:m].T + smooth * share * m / k
        move, start = total[m : m + k] + 1.0, total[m + k] + 1.0
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        sent.unpersist()
    return model


def log_likelihoods(model: Hmm, symbols: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol sequence by the scaled forward recursion, whole sequences in step."""
    order = np.argsort([-len(s) for s in symbols], kind="stable")
    sizes = np.array([len(symbols[i]) for i in order])
    move, emit = model.move, np.ascontiguousarray(model.emit.T)
    out = np.zeros(len(symbols))
    now = np.tile(model.start, (len(order), 1))
    for at in range(0, int(sizes.max(initial=0)), SCORE_STEP):
        live = int(np.searchsorted(-sizes, -at, side="left"))
        now = now[:live]
        block = np.full((live, min(SCORE_STEP, int(sizes[0]) - at)), -1, np.int32)
        for i in range(live):
            piece = symbols[order[i]][at : at + SCORE_STEP]
            block[i, : len(piece)] = piece
        scale = np.ones(block.shape)
        for t in range(block.shape[1]):
            n = int(np.searchsorted(-sizes[:live], -(at + t), side="left"))
            x = now[:n] if at + t == 0 else now[:n] @ move
            x = x * emit[block[:n, t]]
            s = x.sum(1)
            scale[:n, t] = s
            now[:n] = x / s[:, None]
        out[order[:live]] += np.log10(scale).sum(1)
    return out


def trained(rows: DataFrame, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, seed: int = 0) -> tuple[Vocabulary, DataFrame, Hmm]:
    """Of rows (doc_id, text, held_out): the vocabulary and the model of those not held out, and all rows as symbols."""
    v = vocabulary(rows.where(~F.col("held_out")), head)
    done = stash(tokenise(rows, F.col("held_out"), v).withColumn("row", F.monotonically_increasing_id()), "lm-tokens")
    weights = np.concatenate([v.head_counts, v.class_tokens, [float(v.ends)]]) + 1.0
    return v, done, baum_welch(done.where(~F.col("held_out")), first_guess(weights / weights.sum(), states, seed), rounds)


def score(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, seed: int = 0) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    A token is a word or the end; c, N and V count the training tokens, the ends among them.  The
    model: hidden states emit symbols, the most frequent words (HEAD at most) and the end each
    their own and all other words their class's; a word of a class has the share (c + 1) / (N_k + V_k + 1)
    of it, the last 1 for all words not met in training.  Null and empty texts are the end alone.
    Without training rows every token is unknown.  Rows that repeat are scored, and counted, each.
    A null held_out counts as training.  Columns other than doc_id and text are not read; an
    empty table gives an empty result.

    Counts, Baum-Welch and scores read every row.  Words outside the head are joined with the
    table of counts by word, so nothing that grows with the vocabulary is broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    v, done, model = trained(rows, states, rounds, head, seed)
    n_head, symbols = len(v.head), len(v.head) + CLASSES + 1
    per_class = np.log10(v.class_tokens + v.class_words + 1)
    sent = spark.sparkContext.broadcast((model.start, model.move, model.emit, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, class_log = sent.value
        hmm, extra = Hmm(start, move, emit), np.concatenate([np.zeros(n_head), class_log, [0.0]])
        assert len(extra) == symbols
        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SCORE_TOKENS, side="right")) - 1)
                seqs = [flat[offsets[i] : offsets[i + 1]] for i in range(a, b)]
                score = log_likelihoods(hmm, seqs) - np.array([extra[s].sum() for s in seqs])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(score)], names=["row", "hmm"])
                a = b

    forward = done.select("row", "symbols").mapInArrow(run, "row long, hmm double")
    tail = done.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.n").alias("n"))
    # the side that is held in memory has distinct words, so its partitions are even
    known = tail.join(v.counts.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_log"))
    out = done.select("row", "doc_id", "held_out", "n_tokens", "head_known", "head_log").join(forward, "row").join(known, "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    base = F.col("head_log") + tail_log - F.col("n_tokens") * float(np.log10(v.total + v.distinct + 1))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("hmm") + tail_log).alias("score"))
