"""Operator 7: a hidden Markov language model, trained by Baum-Welch over all training text.

The states emit the frequent words of the corpus, one class for all other words, and the end of a text. A word of the
class has its smoothed share of the class's counts, so that any text has a probability. Expected counts are gathered
task by task and summed by Spark; the exact likelihood of a text comes from the scaled forward recursion over all of
it. Rare words never reach the driver or a broadcast: their counts meet the texts in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialise

STATES = 8
#: At most so many words are emitted one by one and known to every task.
FREQUENT = 20_000
SEGMENT = 64
#: Rounds of training, each of them over all training text.
ROUNDS = 17
PRIOR = 20.0
#: Segments of a block, and rows of expected counts that a task sends as one.
BATCH, CHUNK = 2048, 256
END = b""
FLUSH = 300_000


@dataclass(frozen=True)
class Parameters:
    """start: of a text; inner: of a piece from within a text, for training alone; emit: (symbols, states)."""

    start: np.ndarray
    inner: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))


def _is_training():
    return crc_mod("doc_id", 5) != 1


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over all training texts, words lower-cased in A-Z; the end of a text is the empty word."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0):
                held.update(raw.as_py().lower().split())
                if len(held) >= FLUSH:
                    yield _pairs(held)
                    held = Counter()
            held[END] += batch.num_rows
        if held:
            yield _pairs(held)

    return training.select("raw").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _pairs(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(held.keys()), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})


def _rank(n):
    """Counts in steps of under half a per cent: some thousand values whatever the corpus."""
    return F.floor(F.ln(n) * 256).cast("int")


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[dict[bytes, int], int]:
    """The words at or above the least count that at most ``most`` words reach, with counts; and that count's rank."""
    words = counts.where(F.length("word") > 0)
    by_rank = sorted(((r.rank, r.n) for r in words.groupBy(_rank("n").alias("rank")).agg(F.count("*").alias("n")).collect()), reverse=True)
    cut, total = 1 << 30, 0
    for rank, n in by_rank:
        total += n
        if total > most:
            break
        cut = rank
    return {bytes(r.word): r.n for r in words.where(_rank("n") >= cut).collect()}, cut


def expected_counts(p: Parameters, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward over rows of equal length: expected starts, inner starts, moves, emissions. first: of a text."""
    return _expected(p, ids.T.ravel(), np.full(len(ids), ids.shape[1]), first)


def _expected(p: Parameters, words: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same over rows whose lengths don't rise. words: the first symbols of all rows, then the second of those that have one, ..."""
    n, s = len(lengths), p.move.shape[0]
    left = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    at = np.concatenate(([0], np.cumsum(left)))
    words = words.astype(np.intp)
    # Single precision is enough for expectations, which are scaled at every step; what is summed is double.
    move, emit = p.move.astype(np.float32), p.emit.astype(np.float32)
    back_move = np.ascontiguousarray(move.T)
    emitted = emit.take(words, axis=0)
    alpha, gamma = np.empty((len(words), s), np.float32), np.empty((len(words), s), np.float32)
    inverse = np.empty((len(words), 1), np.float32)
    ones, start = np.ones((s, 1), np.float32), np.where(first[:, None], p.start, p.inner).astype(np.float32)
    for t, m in enumerate(left):
        here = slice(at[t], at[t + 1])
        a = alpha[here]
        if t:
            np.matmul(alpha[at[t - 1] : at[t - 1] + m], move, out=a)
            a *= emitted[here]
        else:
            np.multiply(start, emitted[here], out=a)
        np.divide(1, a @ ones, out=inverse[here])
        a *= inverse[here]
    moves = np.zeros((s, s))
    # Rows that end at a step have been left at one until then.
    beta = np.ones((n, s), np.float32)
    for t in range(len(left) - 1, -1, -1):
        here, m = slice(at[t], at[t + 1]), left[t]
        b = beta[:m]
        np.multiply(alpha[here], b, out=gamma[here])
        if t:
            b *= emitted[here]
            b *= inverse[here]
            moves += alpha[at[t - 1] : at[t - 1] + m].T @ b
            beta[:m] = b @ back_move
    emissions = np.stack([np.bincount(words, weights=gamma[:, k], minlength=len(p.emit)) for k in range(s)], axis=1)
    return gamma[:n][first].sum(axis=0, dtype=float), gamma[:n][~first].sum(axis=0, dtype=float), moves * p.move, emissions


def maximise(start: np.ndarray, inner: np.ndarray, moves: np.ndarray, emissions: np.ndarray, share: np.ndarray) -> Parameters:
    """New parameters; every state's emissions are drawn towards the words' shares of the corpus."""
    over = lambda x: (x + 0.1) / (x + 0.1).sum(axis=-1, keepdims=True)
    emit = (emissions + PRIOR * share[:, None]) / (emissions.sum(axis=0) + PRIOR)
    return Parameters(over(start), over(inner), over(moves), emit)


class Symbols(dict):
    """Symbol of each frequent word; ``rare`` is the class of all others, ``end`` the end of a text."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__(zip(words, range(len(words)), strict=True))
        self.rare, self.end = len(words), len(words) + 1

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((*map(self.get, words, repeat(self.rare)), self.end), np.int32, len(words) + 1)


def _segments(symbols: Symbols, raw: bytes) -> list[tuple[bool, np.ndarray]]:
    ids = symbols.of(raw.lower().split())
    return [(k == 0, ids[k : k + SEGMENT]) for k in range(0, len(ids), SEGMENT)]


def _block(rows: list[tuple[bool, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words, lengths and first of segments, as _expected takes them."""
    rows = sorted(rows, key=lambda row: -len(row[1]))
    lengths = np.array([len(x) for _, x in rows])
    steps = np.concatenate([np.arange(n) for n in lengths])
    words = np.concatenate([x for _, x in rows])[np.argsort(steps, kind="stable")]
    return words, lengths, np.array([f for f, _ in rows], bool)


def _blocks(batches, symbols: Symbols):
    """Blocks of the texts' segments, whole and shorter ones apart, so that few steps have few rows; two are held at most."""
    held: dict[bool, list] = {True: [], False: []}
    for batch in batches:
        for raw in batch.column(0):
            for row in _segments(symbols, raw.as_py()):
                rows = held[len(row[1]) == SEGMENT]
                rows.append(row)
                if len(rows) == BATCH:
                    yield _block(rows)
                    rows.clear()
    for rows in held.values():
        if rows:
            yield _block(rows)


def _add_up(p: Parameters, rows: list[tuple[bool, np.ndarray]]):
    """Expected counts of segments, as many at once as fit a cache."""
    starts, inner = np.zeros(len(p.start)), np.zeros(len(p.start))
    moves, emissions = np.zeros_like(p.move), np.zeros_like(p.emit)
    for k in range(0, len(rows), BATCH):
        found = _expected(p, *_block(rows[k : k + BATCH]))
        for total, more in zip((starts, inner, moves, emissions), found, strict=True):
            total += more
    return starts, inner, moves, emissions


def _all_counts(blocks: DataFrame, width: str, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over a table of blocks: every task adds up its own, chunk by chunk they are added up by Spark's tasks.

    The rows of the summed table are the symbols' emissions, then the moves, the start and the inner start.
    """
    symbols, states = p.emit.shape
    small = Parameters(p.start, p.inner, p.move, p.emit.astype(np.float32))

    def gather(batches):
        total = None
        for batch in batches:
            for words, lengths, first in zip(*(batch.column(k) for k in range(3)), strict=True):
                parts = np.frombuffer(words.as_buffer(), width), np.frombuffer(lengths.as_buffer(), "<i8"), np.frombuffer(first.as_buffer(), bool)
                start, inner, moves, emissions = _expected(small, *parts)
                if total is None:
                    total = np.zeros((symbols + states + 2, states))
                total[:symbols] += emissions
                total[symbols:] += np.concatenate((moves, start[None], inner[None]))
        if total is not None:
            chunks = range(0, len(total), CHUNK)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // CHUNK for k in chunks], pa.int64()), "part": pa.array([total[k : k + CHUNK].astype("<f4").tobytes() for k in chunks], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(part.as_buffer(), "<f4").astype(float)
                sums[chunk] = sums[chunk] + found if chunk in sums else found
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int64()), "part": pa.array([x.astype("<f8").tobytes() for x in sums.values()], pa.binary())})

    parts = "chunk long, part binary"
    summed = sorted((r.chunk, r.part) for r in blocks.mapInArrow(gather, parts).repartition("chunk").mapInArrow(add, parts).collect())
    table = np.concatenate([np.frombuffer(part, "<f8") for _, part in summed]).reshape(-1, states)
    return table[-2], table[-1], table[symbols:-2], table[:symbols]


@dataclass(frozen=True)
class Model:
    parameters: Parameters
    words: dict[bytes, int]
    cut: int
    n: int
    v: int
    n_end: int
    n_rare: int
    v_rare: int


def train(training: DataFrame, counts: DataFrame, *, states: int = STATES, frequent: int = FREQUENT, rounds: int = ROUNDS) -> Model:
    """Baum-Welch: ``rounds`` rounds over all training text from a random start, in which every word has its share.

    The driver holds the model and its expected counts ((frequent + 2) x states numbers), never words or texts beyond.
    Texts become symbols once; the rounds read these.
    """
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.length("word") == 0, F.col("n"))).alias("ends")).first()
    words, cut = frequent_words(counts, frequent)
    names = sorted(words)
    symbols = Symbols(names)
    n, n_end = total.n or 0, total.ends or 0
    n_rare = n - n_end - sum(words.values())
    v_rare = total.v - len(words) - (n_end > 0)
    seen = np.array([words[w] for w in names] + [n_rare, n_end], float) + 0.5
    share = seen / seen.sum()
    rng = np.random.default_rng(7)
    flat = np.full(states, 1 / states)
    emit = rng.dirichlet(np.full(states, 2.0), len(share)) * share[:, None]
    p = Parameters(flat, flat, 0.9 * np.eye(states) + 0.1 / states, emit / emit.sum(axis=0))

    if n and rounds:
        width = "<u2" if len(share) <= 1 << 16 else "<u4"

        def to_blocks(batches):
            for words, lengths, first in _blocks(batches, symbols):
                yield pa.RecordBatch.from_pydict({name: pa.array([x.tobytes()], pa.binary()) for name, x in (("words", words.astype(width)), ("lengths", lengths.astype("<i8")), ("first", first))})

        blocks = materialise(training.select("raw").mapInArrow(to_blocks, "words binary, lengths binary, first binary"), "hmm-blocks")
        for _ in range(rounds):
            p = maximise(*_all_counts(blocks, width, p), share)
    return Model(p, words, cut, n, total.v, n_end, n_rare, v_rare)


def forward(p: Parameters, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence of symbols: scaled forward recursion, all texts a step at a time."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order])
    out = np.zeros(len(texts))
    if not len(texts):
        return out
    flat = np.concatenate([texts[i] for i in order])
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    left = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    total, ones = np.zeros(len(texts)), np.ones(len(p.start))
    alpha = np.broadcast_to(p.start, (len(texts), len(p.start)))
    for t, n in enumerate(left):
        alpha = alpha[:n] if t == 0 else alpha[:n] @ p.move
        alpha = alpha * p.emit.take(flat[begin[:n] + t], axis=0)
        scale = alpha @ ones
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    out[order] = total
    return out


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    names = sorted(model.words)
    log_count = np.log10(np.array([model.words[w] for w in names] + [0, model.n_end], float) + 0.5)
    knows_end = int(model.n_end > 0)

    def run(batches):
        symbols = Symbols(names)
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, cols = [], ([], [], [], [], [])
                for raw in part.column(1):
                    words = raw.as_py().lower().split()
                    x = symbols.of(words)
                    ids.append(x)
                    rare = Counter([words[i] for i in np.flatnonzero(x == symbols.rare).tolist()])
                    known = len(words) - sum(rare.values())
                    for col, value in zip(cols, (len(x), known + knows_end, float(log_count[x[x != symbols.rare]].sum()), list(rare), list(rare.values())), strict=True):
                        col.append(value)
                rid = pa.array((task << 33) + row + np.arange(part.num_rows), pa.int64())
                row += part.num_rows
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(
                    {"rid": rid, "doc_id": part.column(0), "log_p": pa.array(forward(model.parameters, ids))}
                    | {n: pa.array(c, k) for n, c, k in zip(("n_tokens", "known", "log_c", "words", "times"), cols, kinds, strict=True)}
                )

    # Written once, so that a row's number is the same for all that reads it.
    rows = materialise(_texts(docs).mapInArrow(run, "rid long, doc_id long, log_p double, n_tokens long, known long, log_c double, words array<binary>, times array<long>"), "hmm-rows")
    rare = rows.where(F.size("words") > 0).select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("rid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rare_counts = counts.where((F.length("word") > 0) & (_rank("n") < model.cut)).select("word", "n")
    found = rare.join(rare_counts, "word", "left")
    per_row = found.groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log_c"),
        F.sum("times").alias("n_rare"),
        F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("rare_known"),
    )
    of_class = math.log10(model.n_rare + 0.5 * (model.v_rare + 1))
    of_all = math.log10(model.n + 0.5 * (model.v + 1))
    joined = rows.drop("words", "times").join(per_row, "rid", "left")
    nil = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "doc_id",
        (~_is_training()).alias("held_out"),
        "n_tokens",
        (F.col("known") + nil("rare_known")).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("log_c") + nil("rare_log_c") - F.col("n_tokens") * F.lit(of_all)).alias("base_score"),
        (F.col("log_p") + nil("rare_log_c") - nil("n_rare") * F.lit(of_class)).alias("score"),
    )


def language_model(docs: DataFrame, **kinds) -> DataFrame:
    """Trains on the rows that aren't held out and scores all rows of docs (doc_id, text).

    Null and empty texts are the end token alone; null ids count as an empty id. Repeated rows count and are scored as
    often as they stand. Without training rows base and model both give every token its uniform share.
    """
    training = _texts(docs).where(_is_training())
    counts = materialise(word_counts(training), "hmm-counts")
    return score(docs, counts, train(training, counts, **kinds))
