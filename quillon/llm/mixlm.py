"""Language-model scoring by online logistic context mixing.

A text is its words, A-Z lower-cased, and an end mark. Each token is coded in two steps.

What the corpus says of a token. It is coded byte by byte, with a closing space, by the bits of a prefix code. Every bit
is predicted from hashed contexts: the last two bytes of the token with its class, the last three, the last four, all
of the token so far, and all of it with its class. A predictor's table holds how often the bit was 0 and 1 in that
context and code position over all training texts. The predictions, as log odds, are combined by weights chosen by a
gate (the place in the token and how often the token so far was seen); a calibration table refines the result. Weights
and calibration are fitted online over all distinct training tokens, each predicted by what its other occurrences
counted. The pass goes through the table once, in rounds of one run, eight, 64 and so on: every run of a round goes on
from the weights that all rounds before have learned, and only what runs of one round learned side by side is averaged.
This probability is mixed with the token's share in the table of counts, which grows with the corpus; the weight of the two, for each class, comes from all counts as well.

What the text says of it. As a text is coded, its own words are counted, and which followed which. A token is predicted
from what followed the word before it in this text so far, else from the words of this text so far, else from the
corpus; how much each of the first two is trusted depends on how often it held the next token until then. So contexts
reach over words, and the mixture adapts to each text.

The class of a token is what the text has shown so far: the label (a language, say) of the last word before it that
stands nearly always under one label. That is the one thing learned from a bounded sample, ``sample_rows`` labelled
training rows; labels are used in learning only.

The corpus part of a token's cost depends on token and class alone, so tokens are counted, fitted and costed once for
each distinct pair. Tokens counted at least ``t`` times, with ``t`` chosen so that at most ``head_words`` are, go to the
executors with their costs; the others of a text are stored with its row, each with what the text says of it, exploded
and joined with the table. No text is shuffled, and the driver sees the head, the hints, weights a run of the table and
2 * SLOTS counters.

Defined cases: a null or empty text is the end mark alone; a null id counts as the empty text in the choice of training
rows; repeated rows are scored one by one and each counts in training; without training rows all counts are 0; null
labels teach no class; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_batches, materialize, shuffle_parts, texts

END = b"\n"
#: Bits of slots of each predictor: the token, the token and class, four bytes, three bytes, two bytes and class. In this
#: order each begins at a multiple of its size, so that its offset and a slot are put together by bits.
WIDTHS = (22, 22, 21, 20, 19)
WORD = 0
OFFSETS = np.cumsum([0, *(1 << w for w in WIDTHS)])[:-1].astype(np.uint32)
SHIFTS = np.array([[32 - w] for w in WIDTHS], np.uint32)
SLOTS = int(sum(1 << w for w in WIDTHS))
BLOCK = 1 << 14
PLACES, GATES = 5, 15
#: Tokens coded together, and bits between two steps of the weights.
TOKENS, CHUNK = 1 << 12, 1 << 12
#: Distinct tokens of one online pass.
RUN = 1 << 16
RATE, PRIOR, CLIP, CELLS = 0.3, 0.3, 8.0, 33
#: Trust in a text's own counts: this share of how often they held the next token, from (held, asked) on.
TRUST, ASKED = 0.6, (1.0, 4.0)
POWER = 0x9E3779B97F4A7C15
BACK = pow(POWER, -1, 1 << 64)
SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def classes_of(words: list[bytes], hints: dict[bytes, int]) -> np.ndarray:
    """Class of each token: the hint of the last word before it that has one, else 0."""
    told = np.fromiter(map(hints.get, words, repeat(0)), np.int32, len(words))
    at = np.where(told > 0, np.arange(1, len(words) + 1), 0)
    last = np.concatenate([[0], np.maximum.accumulate(at)[:-1]])
    return np.concatenate([[0], told])[last].astype(np.int32)


def tokens_of(text: bytes) -> list[bytes]:
    """The words of a text and the end mark."""
    return [*text.lower().split(), END]


def learn_hints(docs: DataFrame, rows: int, words: int, share: float = 0.9, least: int = 8) -> dict[bytes, int]:
    """Words of ``docs(doc_id, text, label)`` that nearly always stand under one label, with its number from 1; the ``words`` most frequent.

    From the distinct rows of the ``rows`` least hashes of id and text.
    """
    docs = docs.where("label is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    last = docs.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return {}

    def count(batches):
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, label in zip(texts(batch), batch.column("label").to_pylist()):
                seen[label].update(text.lower().split())
        columns = ([w for c in seen.values() for w in c], [k for k, c in seen.items() for _ in c], [n for c in seen.values() for n in c.values()])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.int64()))], names=["word", "label", "n"])

    each = docs.where(F.col("h") <= last).select("text", "label").mapInArrow(count, "word binary, label string, n long")
    found = each.groupBy("word", "label").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("total"), F.max(F.struct("n", "label")).alias("top"))
    found = found.where((F.col("total") >= least) & (F.col("top.n") >= share * F.col("total"))).orderBy(F.col("total").desc(), "word").limit(words)
    found = [(bytes(r["word"]), r["top"]["label"]) for r in found.collect()]
    number = {x: k + 1 for k, x in enumerate(sorted({x for _, x in found}))}
    return {w: number[x] for w, x in found}


def prefix_code(counts: np.ndarray):
    """Start, length, inner nodes and bits of the code path of each byte value."""
    heap = [(int(c) + 1, k, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, used = {}, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]], parent[b[2]] = (used, 0), (used, 1)
        heapq.heappush(heap, (a[0] + b[0], used, used))
        used += 1
    nodes, bits, lengths = [], [], []
    for k in range(256):
        path, at = [], k
        while at in parent:
            at, bit = parent[at]
            path.append((at - 256, bit))
        nodes += [n for n, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
        lengths.append(len(path))
    lengths = np.array(lengths)
    nodes = np.array(nodes, np.uint32) * np.uint32(0x9E3779B1) >> SHIFTS  # a predictor a row
    return np.cumsum(lengths) - lengths, lengths, nodes, np.array(bits, np.uint8)


def pieces(words: list[bytes], classes: np.ndarray, code):
    """(slots by predictor and bit, bits, place of each bit, token of each bit) of up to TOKENS tokens at a time."""
    start, length, nodes, bits = code
    for k in range(0, len(words), TOKENS):
        part = words[k : k + TOKENS]
        run = np.frombuffer(b"\0" * 8 + b"".join([w if w == END else w + b" " for w in part]), np.uint8).astype(np.uint64)
        sizes = np.fromiter((len(w) + (w != END) for w in part), np.int64, len(part))
        n, token = len(run) - 8, np.repeat(np.arange(len(part)), sizes)
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = np.zeros(n, np.uint64)
        for j in range(4):  # the four bytes before each, nearest lowest
            last |= run[7 - j : 7 - j + n] << np.uint64(8 * j)
        held = lambda m: (last & ((np.uint64(1) << (np.uint64(8) * np.minimum(place, m).astype(np.uint64))) - np.uint64(1))) + np.minimum(place, m).astype(np.uint64) * SALT[1]
        cls = (classes[k : k + TOKENS][token].astype(np.uint64) + np.uint64(1)) * SALT[4]
        # all bytes of the token before each, by sums of powers over the run
        up, down = np.cumprod(np.full((2, n + 1), [[POWER], [BACK]], np.uint64), axis=1, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((run[8:] + np.uint64(1)) * up[:n], dtype=np.uint64)])
        start_of = np.repeat(np.cumsum(sizes) - sizes, sizes)
        word = (sums[:n] - sums[start_of]) * down[start_of]
        contexts = np.stack([word, word * SALT[2] + cls, held(4), held(3), held(2) + cls])
        contexts = (contexts + np.uint64(1)) * SALT[:, None]
        contexts = ((contexts ^ (contexts >> np.uint64(29))) * SALT[0] >> np.uint64(32)).astype(np.uint32)
        contexts = contexts >> SHIFTS | OFFSETS[:, None]
        b = run[8:].astype(np.int64)
        each = length[b]
        owner = np.repeat(np.arange(n), each)
        first = np.cumsum(each) - each
        at = np.arange(len(owner)) - np.repeat(first - start[b], each)
        slots = contexts.take(owner, axis=1)
        slots ^= nodes.take(at, axis=1)
        yield slots, bits[at], np.minimum(place, PLACES - 1)[owner], token[owner] + k


#: Counts as bytes: exact to 128, beyond it the nearest of geometric steps. Zeros and ones of a slot are the low and the
#: high byte of one number, so 24 MB are broadcast and a prediction is one look at them and one at a table of log odds.
EXACT = 128
LEVELS = np.concatenate([np.arange(129.0), np.floor(128 * 1.265 ** np.arange(1, 128))])
ODDS = np.subtract.outer(np.log(LEVELS + PRIOR), np.log(LEVELS + PRIOR)).astype(np.float32).ravel()
SEEN = np.add.outer(LEVELS, LEVELS).ravel()
SEEN = ((SEEN > 0).astype(np.uint8) + (SEEN > 12)).astype(np.uint8)  # 0: never, 1: a few times, 2: often
_EDGES = np.concatenate([np.arange(0.5, 128), np.sqrt(LEVELS[128:-1] * LEVELS[129:])])


def as_levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(_EDGES, counts, side="right").astype(np.uint8)


def mixed_odds(odds, gate, weights):
    return np.clip(np.einsum("ij,ij->j", odds, weights[:, gate]), -CLIP, CLIP)


def cell_of(mixed, gate):
    """The cell of the calibration table."""
    return gate * CELLS + ((mixed + CLIP) * ((CELLS - 1) / (2 * CLIP)) + 0.5).astype(np.int64)


def refine(mixed, gate, table):
    """Calibrated probability of a one, averaged with the mixed one."""
    return 0.5 * (1 / (1 + np.exp(-mixed)) + table[cell_of(mixed, gate)])


class Model:
    """Counters of all slots, the weights and the calibration table."""

    def __init__(self, counts: np.ndarray, code):
        self.counts, self.code = counts, code
        self.weights = np.full((len(WIDTHS), GATES), 1.0 / len(WIDTHS))
        self.table = np.tile(1 / (1 + np.exp(-np.linspace(-CLIP, CLIP, CELLS))), GATES)
        self.hits, self.total = 20.0 * self.table, np.full(GATES * CELLS, 20.0)

    def fit(self, words: list[bytes], classes: np.ndarray, n: np.ndarray, weights: np.ndarray, hits: np.ndarray, total: np.ndarray) -> None:
        """One online pass over tokens counted ``n`` times; each is predicted without one occurrence of its own."""
        for slots, bit, place, token in pieces(words, classes, self.code):
            counts = self.counts.take(slots)
            own = np.where(bit, counts >> 8, counts & 255)
            counts -= ((own > 0) & (own <= EXACT)) * np.where(bit, 256, 1).astype(np.uint16)  # beyond, one occurrence is less than a level
            gate = place + PLACES * SEEN.take(counts[WORD]).astype(np.int64)
            left, worth = ODDS.take(counts), np.log2(n + 1.0).astype(np.float32)[token]
            for a in range(0, len(bit), CHUNK):
                x, y, g, w = left[:, a : a + CHUNK], bit[a : a + CHUNK], gate[a : a + CHUNK], worth[a : a + CHUNK]
                mixed = mixed_odds(x, g, weights)
                error, seen = w * (y - 1 / (1 + np.exp(-mixed))), np.bincount(g, weights=w, minlength=GATES) + 200.0
                for p in range(len(x)):
                    weights[p] += RATE * np.bincount(g, weights=error * x[p], minlength=GATES) / seen
                cell = cell_of(mixed, g)
                hits += np.bincount(cell, weights=w * y, minlength=len(hits))
                total += np.bincount(cell, weights=w, minlength=len(hits))

    def settle(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Go on with the weights of passes that began with these, averaged by the bits behind them, and the calibration of all so far."""
        sums, behind = 50.0 * self.weights, np.full(GATES, 50.0)
        for weights, h, t in parts:
            bits = t.reshape(GATES, CELLS).sum(axis=1)
            sums, behind, self.hits, self.total = sums + weights * bits, behind + bits, self.hits + h, self.total + t
        self.weights, self.table = (sums / behind).astype(np.float32), (self.hits / self.total).astype(np.float32)

    def bits(self, words: list[bytes], classes: np.ndarray) -> np.ndarray:
        """Coding cost of each token."""
        out = np.zeros(len(words))
        for slots, bit, place, token in pieces(words, classes, self.code):
            counts = self.counts.take(slots)
            gate = place + PLACES * SEEN.take(counts[WORD]).astype(np.int64)
            one = refine(mixed_odds(ODDS.take(counts), gate, self.weights), gate, self.table)
            cost = -np.log2(np.where(bit, one, 1 - one))
            out += np.bincount(token, weights=cost, minlength=len(words))
        return out


# -- what is gathered from the corpus ------------------------------------------------------


def token_counts(docs: DataFrame, train: Column, hints: dict[bytes, int]) -> DataFrame:
    """(word, class, n) of all texts; n counts the rows where ``train`` holds, and may be 0."""

    def count(batches):
        seen: dict[int, Counter] = defaultdict(Counter)
        other: dict[int, set] = defaultdict(set)

        def rows():
            for k, found in other.items():
                for word in found - seen[k].keys():
                    seen[k][word] = 0
            words = [w for c in seen.values() for w in c]
            classes = [k for k, c in seen.items() for _ in c]
            n = [x for c in seen.values() for x in c.values()]
            seen.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(classes, pa.int32()), pa.array(n, pa.int64())], names=["word", "class", "n"])

        for batch in batches:
            for text, learn in zip(texts(batch), batch.column("learn").to_pylist()):
                tokens = tokens_of(text)
                classes = classes_of(tokens, hints)
                cuts = [0, *(np.nonzero(np.diff(classes))[0] + 1).tolist(), len(tokens)]
                for a, b in zip(cuts, cuts[1:]):
                    (seen if learn else other)[int(classes[a])].update(tokens[a:b])
            if sum(map(len, seen.values())) + sum(map(len, other.values())) > 1 << 19:
                yield rows()
        if seen or other:
            yield rows()

    found = docs.select("text", train.alias("learn")).mapInArrow(count, "word binary, class int, n long")
    return found.groupBy("word", "class").agg(F.sum("n").alias("n"))


def bit_counts(tokens: DataFrame, code) -> np.ndarray:
    """Zeros and ones of every slot over all counted tokens, as the two bytes of a number."""

    def count(batches):
        total = np.zeros(2 * SLOTS, np.float32)  # levels are coarser than its rounding
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.float32)
            for slots, bit, _, token in pieces(batch.column("word").to_pylist(), batch.column("class").to_numpy(), code):
                each = n[token]
                for row in slots:
                    np.add.at(total, row * np.uint32(2) + bit, each)
        parts = [(k, total[k * BLOCK : (k + 1) * BLOCK]) for k in range(-(-len(total) // BLOCK))]
        parts = [(k, zlib.compress(p.astype(np.int64).tobytes(), 1)) for k, p in parts if p.any()]
        for a in range(0, len(parts), 64):
            k, d = zip(*parts[a : a + 64])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(d, pa.binary())], names=["block", "counts"])

    def add(batches):
        now, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "counts"])
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                if block != now:
                    if now is not None:
                        yield out()
                    now, total = block, np.zeros(BLOCK, np.int64)
                part = np.frombuffer(zlib.decompress(data), np.int64)
                total[: len(part)] += part
        if now is not None:
            yield out()

    schema = "block int, counts binary"
    summed = tokens.where("n > 0").mapInArrow(count, schema).repartition(shuffle_parts(tokens.sparkSession), "block")
    summed = summed.sortWithinPartitions("block").mapInArrow(add, schema)
    total = np.zeros(-(-2 * SLOTS // BLOCK) * BLOCK, np.uint8)
    for r in materialize(summed, "lm-bits").toLocalIterator():  # 2 * SLOTS counters whatever the input
        total[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = as_levels(np.frombuffer(zlib.decompress(r["counts"]), np.int64))
    return total[: 2 * SLOTS].view("<u2").astype(np.uint16)


def byte_counts(tokens: DataFrame) -> np.ndarray:
    """How often each byte occurs in the training texts, a space or the end mark behind each word."""

    def count(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            total += np.bincount(np.frombuffer(b"".join(words), np.uint8), weights=np.repeat(n, sizes), minlength=256).astype(np.int64)
            total[32] += n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], names=["byte", "n"])

    total = np.zeros(256, np.int64)
    for r in tokens.where("n > 0").mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        total[r["byte"]] = r["n"]
    return total


def in_runs(batches, size: int):
    """(run, words, classes, counts) of ``size`` tokens of one run, the last ones of it fewer, however the batches lie."""
    now, held, parts = None, 0, []

    def joined():
        whole = pa.Table.from_batches(parts)
        return now, whole.column("word").to_pylist(), whole.column("class").to_numpy(), whole.column("n").to_numpy()

    for batch in batches:
        runs = batch.column("run").to_numpy()
        cuts = [0, *(np.nonzero(np.diff(runs))[0] + 1).tolist(), len(runs)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b and runs[a] != now:
                if held:
                    yield joined()
                now, held, parts = int(runs[a]), 0, []
            while a < b:
                take = min(b - a, size - held)
                parts.append(batch.slice(a, take))
                a, held = a + take, held + take
                if held == size:
                    yield joined()
                    held, parts = 0, []
    if held:
        yield joined()


def rounds_of(runs: int) -> list[tuple[int, int]]:
    """The first run of each round and the one behind its last; each ends at eight times as many runs and one more, as a round reads the table anew."""
    cuts = [0]
    while cuts[-1] < runs:
        cuts.append(min(8 * cuts[-1] + 1, runs))
    return list(zip(cuts, cuts[1:]))


def fitted(tokens: DataFrame, code):
    """The model of all training tokens and its counters as they were broadcast: counted, then weights and calibration by one online pass.

    Tokens are dealt to runs of about ``RUN`` by hash, each in the order of another hash, so neither the number of
    partitions nor their order changes a weight. A round is a job; its runs begin with the weights of the rounds before.
    """
    spark = tokens.sparkSession
    counted = spark.sparkContext.broadcast(bit_counts(tokens, code))
    model = Model(counted.value, code)
    known = tokens.where("n > 0")
    runs = max(1, -(-known.count() // RUN))
    dealt = known.select(F.pmod(F.xxhash64("word", "class"), F.lit(runs)).cast("int").alias("run"), "word", "class", "n")
    shape = {"weights": (len(WIDTHS), GATES), "hits": (-1,), "total": (-1,)}

    def learned(first: int, behind: int, start: np.ndarray) -> DataFrame:
        def learn(batches):
            mine, now, state = None, None, None
            out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *(pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in state)], names=["run", "weights", "hits", "total"])
            for run, words, classes, n in in_runs(batches, TOKENS):
                mine = mine or Model(counted.value, code)
                if run != now:
                    if now is not None:
                        yield out()
                    now, state = run, (start.astype(np.float64), np.zeros(GATES * CELLS), np.zeros(GATES * CELLS))
                mine.fit(words, classes, n, *state)
            if now is not None:
                yield out()

        mine = dealt.where((F.col("run") >= first) & (F.col("run") < behind))
        mine = mine.repartitionById(min(behind - first, shuffle_parts(spark)), F.col("run") - first).sortWithinPartitions("run", F.hash("word", "class"), "word", "class")
        return mine.mapInArrow(learn, "run long, weights binary, hits binary, total binary")

    for first, behind in rounds_of(runs):
        parts = materialize(learned(first, behind, model.weights), "lm-weights")
        model.settle(tuple(np.frombuffer(r[c], "<f8").reshape(shape[c]) for c in shape) for r in parts.orderBy("run").toLocalIterator())
    return model, counted


def class_weights(costs: DataFrame, rounds: int = 3) -> DataFrame:
    """(class, total, trust): the weight of a token's share in the counts of its class beside its coded bits, by expectation maximisation.

    Every occurrence is predicted without itself. One row a class, so the table is broadcast.
    """
    spark = costs.sparkSession
    now = {r["class"]: (r["total"], 0.8) for r in costs.groupBy("class").agg(F.sum("n").alias("total")).collect()}
    table = lambda: spark.createDataFrame([(k, *v) for k, v in now.items()], "class int, total long, trust double")
    for _ in range(rounds):
        share = F.col("trust") * (F.col("n") - 1) / F.greatest(F.col("total") - 1, F.lit(1))
        coded = (1 - F.col("trust")) * F.pow(F.lit(2.0), -F.col("bits"))
        held = costs.where("n > 0").join(F.broadcast(table()), "class").groupBy("class", "total").agg((F.sum(F.col("n") * share / (share + coded)) + 1).alias("held"))
        for r in held.collect():
            now[r["class"]] = (r["total"], r["held"] / (r["total"] + 2.0))
    return table()


def head_of(words: DataFrame, most: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Number, log10(count + 1) and probabilities by class (0: not known) of the words of the largest counts, at most ``most`` of them.

    ``most`` is what the table of words and classes may hold at 16 classes; with more, there are fewer words.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    words = words.where("n > 0")
    sizes = words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("count"), F.max(F.array_max(F.map_keys("p"))).alias("class")).collect()
    classes, held, cut = 1 + max((r["class"] for r in sizes), default=0), 0, None
    for r in sorted(sizes, key=lambda r: -r["level"]):
        held += r["count"]
        if held > most * 16 // max(classes, 16):
            break
        cut = r["level"]
    found = [] if cut is None else words.where(level >= cut).toLocalIterator()
    number, gain, rows = {}, [], []
    for r in found:
        number[bytes(r["word"])] = len(number)
        gain.append(math.log10(r["n"] + 1.0))
        rows.append([r["p"].get(k, 0.0) for k in range(classes)])
    p = np.array([*rows, [0.0] * classes])  # the last row stands for all other words
    return number, np.array([*gain, 0.0]), p


# -- scoring -------------------------------------------------------------------------------


def _before(*keys: np.ndarray) -> np.ndarray:
    """How often each row of keys occurred before."""
    order = None
    for key in reversed(keys):
        key = key.astype(np.uint16) if key.max(initial=0) < 1 << 16 else key  # short numbers are sorted by digits
        order = np.argsort(key, kind="stable") if order is None else order[np.argsort(key[order], kind="stable")]
    n = len(order)
    first = np.ones(n, bool)
    first[1:] = False
    for key in keys:
        ranked = key[order]
        first[1:] |= ranked[1:] != ranked[:-1]
    at = np.arange(n)
    out = np.empty(n, np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def _trust(held: np.ndarray, asked: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The share of a text's own counts at each place, from how often they held the next token at the places ``asked`` before; 0 where not asked."""
    hits, places = (np.cumsum(x) - x for x in ((held & asked).astype(np.int64), asked.astype(np.int64)))
    return np.where(asked, TRUST * (ASKED[0] + hits - hits[begin]) / (ASKED[1] + places - places[begin]), 0.0)


def told(ids: np.ndarray, text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of each token of several texts: with the corpus's probability p, that of the mixture is x + y * p.

    ``ids``: a number for each word, from 0; ``text``: the number of its text; ``begin``: where that begins.
    """
    at = np.arange(len(ids)) - begin
    seen = _before(text, ids)
    trust = _trust(seen > 0, at > 0, begin)
    x, y = trust * seen / np.maximum(at, 1), 1.0 - trust
    prev = np.where(at[1:] > 0, ids[:-1], int(ids.max()) + 1)  # no word stands before the first
    follows = np.concatenate([[0], _before(text[1:], prev, ids[1:])])  # how often it followed the word before it
    after = np.concatenate([[0], np.where(at[1:] > 0, seen[:-1], 0)])  # how often anything followed that word before
    trust = _trust(follows > 0, after > 0, begin)
    return trust * follows / np.maximum(after, 1) + (1.0 - trust) * x, (1.0 - trust) * y


def together(lists, most: int = 1 << 13):
    """Lists of tokens in groups of about ``most`` tokens, to be worked on at once."""
    held, n = [], 0
    for tokens in lists:
        held.append(tokens)
        n += len(tokens)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def learn(docs: DataFrame, label_rows: int, hint_words: int):
    """Hints, model and the words table (word, n, p: probability by class) of ``docs(doc_id, text, label, learn)``."""
    hints = learn_hints(docs.where("learn"), label_rows, hint_words)
    tokens = materialize(token_counts(docs, F.col("learn"), hints), "lm-tokens")
    code = prefix_code(byte_counts(tokens))
    model, counted = fitted(tokens, code)
    weights, table = model.weights, model.table

    def cost(batches):
        mine = None
        for batch in batches:
            mine = mine or Model(counted.value, code)
            mine.weights, mine.table = weights, table
            bits = mine.bits(batch.column("word").to_pylist(), batch.column("class").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits)], names=["word", "class", "n", "bits"])

    costs = materialize(tokens.mapInArrow(cost, "word binary, class int, n long, bits double"), "lm-costs")
    p = F.col("trust") * F.col("n") / F.greatest("total", F.lit(1)) + (1 - F.col("trust")) * F.pow(F.lit(2.0), -F.col("bits"))
    each = costs.join(F.broadcast(class_weights(costs)), "class").select("word", "class", "n", p.alias("p"))
    words = each.groupBy("word").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("class", "p"))).alias("p"))
    return hints, model, materialize(words, "lm-words")


def score(
    docs: DataFrame, train: Column, label: str | None = None, sample_rows: int = 512, hint_words: int = 1 << 14, head_words: int = 1 << 16
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row; learned where ``train`` holds.

    ``label``: a column that classes are learned from, with at most ``hint_words`` words of ``sample_rows`` rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(label) if label else F.lit(None)).cast("string").alias("label"), train.alias("learn"))
    hints, _, words = learn(slim, sample_rows, hint_words)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    below = float(np.log10(float(total["tokens"] + total["distinct"] + 1)))
    head = spark.sparkContext.broadcast(head_of(words, head_words))

    def run(batches):
        number, gain, chance = head.value
        for batch in batches:
            out, rest, ends = [], ([], [], [], []), [0]
            for part in together(map(tokens_of, texts(batch))):
                flat = [w for tokens in part for w in tokens]
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                text = np.repeat(np.arange(len(part)), sizes)
                begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
                names = dict.fromkeys(flat)
                names = dict(zip(names, range(len(names))))
                each = lambda f, *more: np.fromiter(map(f, names, *more), np.int64, len(names))  # noqa: E731, B023  for each distinct word
                ids = np.fromiter(map(names.__getitem__, flat), np.int64, len(flat))
                known, hint = each(number.get, repeat(-1))[ids], each(hints.get, repeat(0))[ids]
                last = np.maximum.accumulate(np.where(hint > 0, np.arange(1, len(ids) + 1), 0))
                last = np.concatenate([[0], last[:-1]])  # one behind the last hint before
                classes = np.where(last > begin, hint[np.maximum(last, 1) - 1], 0)
                x, y = told(ids, text, begin)
                p = chance[known, np.minimum(classes, chance.shape[1] - 1)]
                held = p > 0
                fresh = ~held & (x == 0)  # the first of a rare word: what y costs is known already
                costs = -np.log2(np.where(held, x + y * p, np.where(fresh, y, 1.0)))
                y[fresh] = 1.0
                for column, value in zip(rest[1:], (classes, x, y)):
                    column.append(value[~held])
                rest[0].extend(flat[k] for k in np.nonzero(~held)[0].tolist())
                sums = [np.bincount(text, weights=w, minlength=len(part)) for w in (held, np.where(held, gain[known], 0.0), costs, each(len)[ids])]
                ends += (ends[-1] + np.cumsum(sizes - sums[0].astype(np.int64))).tolist()
                out += zip(sizes.tolist(), sums[0].astype(np.int64).tolist(), sums[1].tolist(), sums[2].tolist(), (sums[3].astype(np.int64) + sizes - 1).tolist())
            rest = (rest[0], *(np.concatenate(c) if c else np.empty(0) for c in rest[1:]))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            rare = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(rest, (pa.binary(), pa.int32(), pa.float64(), pa.float64()))], ["word", "class", "x", "y"])
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *arrays], names=["row", "doc_id", "n_tokens", "n_known", "base", "bits", "size", "rest"])

    rows = slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, bits double, size long, rest array<struct<word: binary, class: int, x: double, y: double>>"
    rows = materialize(rows.mapInArrow(run, schema), "lm-rows")
    rare = rows.select("row", F.explode("rest").alias("r")).select("row", "r.*").join(words, "word")
    rare = rare.groupBy("row").agg(
        F.count_if(F.col("n") > 0).alias("more"),
        F.sum(F.log10(F.col("n") + 1.0)).alias("gain"),
        F.sum(-F.log2(F.col("x") + F.col("y") * F.element_at("p", F.col("class")))).alias("cost"),
    )
    bits = F.col("bits") + F.coalesce("cost", F.lit(0.0))
    return rows.drop("rest").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total["tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (-bits * F.lit(float(np.log10(2.0)))).alias("score"), (bits / F.col("size")).alias("bits_per_byte"),
    )
