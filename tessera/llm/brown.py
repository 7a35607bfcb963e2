"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

A token is a word (lower-case A to Z) or the end of a document, which is also what stands before its
first word. The model gives a token w after v the probability P(class(w) | class(v)) * P(w | class(w)).

Words are counted over all training texts. The words of the head (at least `least` times, `head` of the commonest at most)
are assigned to `classes` classes by exchange: a word is moved to the class that raises the likelihood of the class bigrams
most. The commonest `core` words are exchanged one after another on the driver, until none moves. All other head words are then
inserted at once, each into the class that its neighbours' classes call for, and in further rounds every head word may be
exchanged, half of them a round, on counts of its neighbours' classes that are summed and judged in parallel
(one row of 2 * (classes + 2) counts a word); a round that lowers the likelihood is taken back and ends it. The remaining words, seen or not, are one class, in which absolute discounting leaves mass to the
unseen word. Class transitions are smoothed towards the classes' own shares.

What is broadcast is bounded by `core` and `head`. The counts of the remaining words, which grow with the input, stay
distributed: a document's remaining words are joined to them. Every text is read whole, twice; its tokens are then written
as numbers, from which all rounds and the scores are made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import parts
from .store import written

CORE, CLASSES, HEAD, LEAST, ROUNDS = 1000, 48, 1 << 18, 3, 4
HELD_MOD, HELD_AT = 7, 2
#: Distinct words, and tokens, that a task holds before it passes its counts on.
FLUSH, TOKENS = 400_000, 1 << 20
END = "\n"  # no word holds white space


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 7, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HELD_MOD == HELD_AT


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: Counter, ends: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*(w.decode() for w in counts), END], pa.string()), pa.array([*counts.values(), ends], pa.int64())], ["word", "n"])

    counts, ends = Counter(), 0
    for batch in parts(batches):
        for text in batch.column(0).to_pylist():
            counts.update(tokens(text))
            ends += 1
        if len(counts) > FLUSH:
            yield out(counts, ends)
            counts, ends = Counter(), 0
    if ends:
        yield out(counts, ends)


@dataclass
class Vocabulary:
    """Head words by descending count."""

    index: dict[bytes, int]
    counts: np.ndarray

    def ids(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        """The words, and the numbers of all tokens: one more than the last head word for others."""
        words, get, other = tokens(text), self.index.get, len(self.counts)
        ids = np.empty(len(words) + 1, np.int32)
        ids[:-1] = [get(w, other) for w in words]
        ids[-1] = get(END.encode(), other)
        return words, ids


def _numbered(vocabulary):
    """(doc_id, held_out, text) to (doc_id, held_out, row, ids, words, times): ids of all tokens, and the words outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        other, row = len(v.counts), TaskContext.get().partitionId() << 33
        for batch in parts(batches):
            ids_of, words_of, times_of, n = [], [], [], batch.num_rows
            for text in batch.column("text").to_pylist():
                words, ids = v.ids(text)
                rest = Counter(words[i] for i in np.flatnonzero(ids[:-1] == other))
                ids_of.append(ids)
                words_of.append([w.decode() for w in rest])
                times_of.append(list(rest.values()))
            ends = np.r_[0, np.cumsum([len(x) for x in ids_of])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids_of) if ids_of else np.empty(0, np.int32)))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(np.arange(row, row + n)), lists, pa.array(words_of, pa.list_(pa.string())), pa.array(times_of, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "row", "ids", "words", "times"])
            row += n

    return run


def bigrams(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(before, now) of all tokens of a column of ids; a document's last token, its end, stands before its first."""
    now, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    before, ends = np.empty_like(now), np.cumsum(sizes)
    before[1:] = now[:-1]
    before[(ends - sizes)[sizes > 0]] = now[ends[sizes > 0] - 1]
    return before, now


def _count_pairs(shared, n: int):
    """Ids to rows of the bigram matrix of `n` symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, codes, size = shared.value.astype(np.int64), [], 0
        matrix = np.zeros(n * n, np.int64)
        for batch in parts(batches):
            before, now = bigrams(batch.column("ids"))
            codes.append(symbol[before] * n + symbol[now])
            size += len(now)
            if size > TOKENS:
                matrix += np.bincount(np.concatenate(codes), minlength=n * n)
                codes, size = [], 0
        if codes:
            matrix += np.bincount(np.concatenate(codes), minlength=n * n)
        matrix = matrix.reshape(n, n)
        rows = np.flatnonzero(matrix.any(axis=1))
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array([matrix[i].tobytes() for i in rows], pa.binary())], ["before", "counts"])

    return run


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in parts(batches):
        for before, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = np.frombuffer(counts, np.int64)
            total[before] = total[before] + row if before in total else row
    for before, row in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([before], pa.int32()), pa.array([row.tobytes()], pa.binary())], ["before", "counts"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, core: int, classes: int, rounds: int = 20) -> np.ndarray:
    """Class of every symbol: the first `core` symbols are clustered, each other symbol is a class of its own."""
    n = len(pairs)
    classes = max(1, min(classes, core))
    of = np.concatenate((np.arange(core) % classes, classes + np.arange(n - core)))
    total = classes + n - core
    grouped = np.zeros((total, total))
    np.add.at(grouped, (of[:, None], of[None, :]), pairs)
    weight = (pairs.sum(axis=0) + pairs.sum(axis=1)) / 2.0
    size = np.bincount(of, weights=weight, minlength=total)
    for _ in range(rounds):
        moved = 0
        for w in range(core):
            left, right, own = pairs[:, w].astype(float), pairs[w].astype(float), float(pairs[w, w])
            left[w] = right[w] = 0
            left, right = np.bincount(of, left, total), np.bincount(of, right, total)
            a = of[w]
            grouped[:, a] -= left
            grouped[a] -= right
            grouped[a, a] -= own
            size[a] -= weight[w]
            inner = np.diagonal(grouped)[:classes]
            into = grouped[:, :classes]
            out = grouped[:classes]
            gain = (_xlogx(into + left[:, None]) - _xlogx(into)).sum(axis=0) + (_xlogx(out + right[None, :]) - _xlogx(out)).sum(axis=1)
            l, r = left[:classes], right[:classes]
            gain += _xlogx(inner + l + r + own) - _xlogx(inner + l) - _xlogx(inner + r) + _xlogx(inner)
            gain -= 2 * (_xlogx(size[:classes] + weight[w]) - _xlogx(size[:classes]))
            best = int(gain.argmax())
            b = best if gain[best] > gain[a] + 1e-6 else int(a)
            grouped[:, b] += left
            grouped[b] += right
            grouped[b, b] += own
            size[b] += weight[w]
            of[w] = b
            moved += b != a
        if not moved:
            break
    return of


def likelihood(grouped: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to what no clustering changes."""
    return float(_xlogx(grouped).sum() - _xlogx(grouped.sum(axis=0)).sum() - _xlogx(grouped.sum(axis=1)).sum())


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, at: np.ndarray, grouped: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, gain over the present one) that raises the likelihood most for each word.

    left and right: counts of the classes before and after each word, own: of the word after itself (in neither of them); at: its
    present class; grouped: class bigrams, in which the words stand at their present classes. Classes from `classes` on take no word.
    """
    n, k = left.shape
    every, f = np.arange(n), _xlogx
    size = (grouped.sum(axis=0) + grouped.sum(axis=1)) / 2
    weight = (left.sum(axis=1) + right.sum(axis=1)) / 2 + own
    gain = np.zeros((n, classes))
    for mine, other, table in ((left, right, grouped), (right, left, grouped.T)):
        word, c = np.nonzero(mine)
        count, there = mine[word, c][:, None], np.flatnonzero(at[word] == c)
        base = table[c, :classes].astype(float)
        base[there] -= other[word[there], :classes]  # without the word, its class has these fewer
        inside = np.flatnonzero(at[word] < classes)
        base[inside, at[word[inside]]] -= count[inside, 0]
        both = there[at[word[there]] < classes]
        base[both, at[word[both]]] -= own[word[both]]
        np.add.at(gain, word, f(base + count) - f(base))
    inner = np.broadcast_to(np.diagonal(grouped)[:classes], (n, classes)).astype(float)
    sizes = np.broadcast_to(size[:classes], (n, classes)).astype(float)
    placed = at < classes
    i, a = every[placed], at[placed]
    inner[i, a] -= left[i, a] + right[i, a] + own[i]
    sizes[i, a] -= weight[i]
    l, r, o = left[:, :classes], right[:, :classes], own[:, None]
    gain += f(inner + l + r + o) - f(inner + l) - f(inner + r) + f(inner)
    gain -= 2 * (f(sizes + weight[:, None]) - f(sizes))
    best = gain.argmax(axis=1)
    now = np.where(placed, gain[every, np.minimum(at, classes - 1)], -np.inf)
    return best, gain[every, best] - now


def _contexts(shared, chunks: int):
    """Ids to counts of (word, its neighbour's class): per chunk of words one row of sorted codes and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, k = shared.value
        head, held, size = len(of) - 1, [], 0

        def out() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            each = -(-head // chunks) * (2 * k + 1)  # a chunk is every chunks-th word
            chunk = codes // each
            cuts = np.flatnonzero(np.diff(chunk)) + 1
            rows = zip(chunk[np.r_[0, cuts]].tolist(), np.split(codes % each, cuts), np.split(n, cuts), strict=True)
            rows = [(c, x.astype("<u4").tobytes(), y.astype("<u4").tobytes()) for c, x, y in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["chunk", "codes", "counts"])

        for batch in parts(batches):
            before, now = (x.astype(np.int64) for x in bigrams(batch.column("ids")))
            same = before == now
            for word, c in ((now, np.where(same, 2 * k, of[before])), (before, k + of[now])):
                keep = (word < head) if word is now else (word < head) & ~same
                word, c = word[keep], c[keep]
                held.append((word % chunks * -(-head // chunks) + word // chunks) * (2 * k + 1) + c)
            size += len(now)
            if size > TOKENS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _proposals(shared, chunks: int, classes: int):
    """Sums the counts of each chunk of words, which come one chunk after another, and finds every word's best class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, grouped = shared.value
        k, head = len(grouped), len(of) - 1
        each = -(-head // chunks)

        def out(chunk: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
            words = np.arange(chunk, head, chunks)
            table = table.reshape(each, 2 * k + 1)[: len(words)]
            for start in range(0, len(words), 512):
                part, own = table[start : start + 512], words[start : start + 512]
                best, gain = best_classes(part[:, :k], part[:, k : 2 * k], part[:, 2 * k], of[own], grouped, classes)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(best.astype(np.int32)), pa.array(gain)], ["word", "best", "gain"])

        at, table = None, np.empty(0)
        for batch in parts(batches, 1):
            chunk, codes, counts = (c[0].as_py() for c in batch.columns)
            if chunk != at:
                if at is not None:
                    yield from out(at, table)
                at, table = chunk, np.zeros(each * (2 * k + 1), np.int64)
            table[np.frombuffer(codes, "<u4")] += np.frombuffer(counts, "<u4")  # codes are distinct in a row
        if at is not None:
            yield from out(at, table)

    return run


@dataclass
class Model:
    vocabulary: Vocabulary
    of: np.ndarray  # class of each head word, then of all others
    emission: np.ndarray  # log10 P(word | class) of head words, then 0
    transition: np.ndarray  # log10 P(class | class before)
    tokens: int
    types: int
    rest_tokens: int
    discount: float
    unseen: float  # P(unseen word | the rest's class)


def _matrix(ids: DataFrame, symbol: np.ndarray, n: int) -> np.ndarray:
    """Bigram counts of the symbols of all ids: n rows and columns."""
    shared = ids.sparkSession.sparkContext.broadcast(symbol)
    rows = ids.mapInArrow(_count_pairs(shared, n), "before int, counts binary").repartition("before").mapInArrow(_add_rows, "before int, counts binary")
    out = np.zeros((n, n), np.int64)
    for before, row in rows.collect():
        out[before] = np.frombuffer(row, np.int64)
    return out


def cluster(ids: DataFrame, head: int, core: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each head word and, last, of all others; class bigrams). Two classes take no head word by exchange: that
    of words still to be inserted, empty in the end, and that of the words outside the head."""
    spark, core = ids.sparkSession, min(core, head)
    symbol = np.append(np.minimum(np.arange(head), core), core + 1)
    of = exchange(_matrix(ids, symbol, core + 2), core, classes)[symbol]
    classes = max(1, min(classes, core))
    k = classes + 2
    grouped, chunks = _matrix(ids, of, k), int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = likelihood(grouped)
    for turn in range(rounds + 1 if core else 0):
        shared = spark.sparkContext.broadcast((of, grouped))
        counts = ids.mapInArrow(_contexts(spark.sparkContext.broadcast((of, k)), chunks), "chunk int, codes binary, counts binary")
        found = counts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_proposals(shared, chunks, classes), "word int, best int, gain double").toPandas()  # `head` rows
        word, to = found["word"].to_numpy(), found["best"].to_numpy()
        # Words that move at once may undo one another's gain: half of them a round.
        moves = of[word] == classes if turn == 0 else (found["gain"].to_numpy() > 1e-6) & (of[word] != to) & (word % 2 == turn % 2)
        after = of.copy()
        after[word[moves]] = to[moves]
        again = _matrix(ids, after, k)
        if turn and likelihood(again) <= best:
            break
        of, grouped, best = after, again, likelihood(again)
    return of, grouped


def fit(docs: DataFrame, core: int = CORE, classes: int = CLASSES, head: int = HEAD, least: int = LEAST, rounds: int = ROUNDS) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the training documents, the counts (word, n) of all their words, and the numbered tokens of all documents."""
    spark = docs.sparkSession
    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    texts = source.where(~F.col("held_out")).select("text")
    counts = written(texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # The head is cut at an eighth of a power of two, so that no task sends more words than the head holds.
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    sizes = counts.where(F.col("n") >= least).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 8 * 63 rows at most
    cut = min((r.level for r, upto in zip(sizes, np.cumsum([r["count"] for r in sizes]), strict=True) if upto < head), default=1 << 20)
    common = counts.where((F.col("n") >= least) & (level >= cut) | (F.col("word") == END)).toPandas()  # `head` rows at most
    common = common.sort_values(["n", "word"], ascending=[False, True])
    n = common["n"].to_numpy(np.int64)
    vocabulary = Vocabulary({w.encode(): i for i, w in enumerate(common["word"])}, n)
    facts = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2")).first()

    shared = spark.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = written(source.mapInArrow(_numbered(shared), f"doc_id {kind}, held_out boolean, row long, ids array<int>, words array<string>, times array<int>"), "tokens")
    of, grouped = cluster(numbered.where(~F.col("held_out")).select("ids"), len(n), core, classes, rounds)

    k = len(grouped)
    share = (grouped.sum(axis=0) + 0.5) / (grouped.sum() + 0.5 * k)
    transition = np.log10((grouped + 5 * share[None, :]) / (grouped.sum(axis=1, keepdims=True) + 5))
    inside = np.bincount(of[:-1], weights=n, minlength=k)
    emission = np.append(np.log10(n / inside[of[:-1]]), 0.0)
    total, types = int(facts.tokens or 0), int(facts.types)
    rest_tokens, rest_types = total - int(n.sum()), types - len(n)
    n1, n2 = int(facts.n1 or 0), int(facts.n2 or 0)
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    model = Model(vocabulary, of, emission, transition, total, types, rest_tokens, discount, (discount * rest_types + 1) / (rest_tokens + 1))
    return model, counts, numbered


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        other = len(m.vocabulary.counts)
        base = np.append(np.log10((m.vocabulary.counts + 1) / (m.tokens + m.types + 1)), 0.0)
        for batch in parts(batches):
            before, now = bigrams(batch.column("ids"))
            sizes = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(sizes) - sizes  # no document is without its end
            sums = [np.add.reduceat(x, starts) if len(starts) else x for x in ((now != other).astype(np.int64), base[now], m.emission[now] + m.transition[m.of[before], m.of[now]])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("row"), pa.array(sizes), *map(pa.array, sums)], ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, core: int = CORE, classes: int = CLASSES, head: int = HEAD, least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (by token).

    score is the log10 probability of the whole text with its end; base_score that of the add-one unigram model. An unseen
    word counts as one further word in both. A null text is empty: its end alone is scored. With no training document every
    token is unseen. Equal rows get equal scores, rows that share a doc_id are scored each for itself. Other columns are left out; an
    empty table gives an empty one.
    """
    model, counts, numbered = fit(docs, core, classes, head, least, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double"
    scored = numbered.select("doc_id", "held_out", "row", "ids").mapInArrow(_score(shared), schema)

    rest = numbered.select("row", F.explode(F.arrays_zip("words", "times")).alias("_w")).select("row", F.col("_w.words").alias("word"), F.col("_w.times").alias("times"))
    seen = rest.join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    inside = F.when(F.col("n").isNotNull(), (n - model.discount) / (model.rest_tokens + 1)).otherwise(model.unseen)
    sums = seen.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * F.log10((n + 1) / (model.tokens + model.types + 1))).alias("_base"),
        F.sum(F.col("times") * F.log10(inside)).alias("_score"),
    )
    add = lambda c, d: F.col(c) + F.coalesce(d, F.lit(0))
    out = scored.join(sums, "row", "left")
    out = out.select("doc_id", "held_out", "n_tokens", add("n_known", "_known").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), add("base_score", "_base").alias("base_score"), add("score", "_score").alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
