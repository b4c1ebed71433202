"""SimHash near-duplicates by exact tiled comparison.

Fingerprints: a bit is set when it is set in more than half of the hashes of a text's word
shingles. Equal fingerprints are one class, told by a group-by. The classes are laid into tiles
by the bit counts of ``blocks`` equal parts of the fingerprint, each count divided by ``band``.
Two fingerprints within ``radius`` bits differ by at most that much in the sum of their bit-count
differences, so only tiles that close are compared, and those exactly: numpy exclusive-or and
bit counts over blocks of pairs. With one part this is the plain comparison of bit counts; with
more parts far fewer pairs remain and none within the radius is lost.

A tile over ``tile_rows`` classes is split, and so are the classes that visit it, so a compare
task holds 2 * tile_rows fingerprints at most. It reports a spanning forest of its links instead
of all pairs, and ``components`` joins the forests. The number of tiles is bounded by
(bits / blocks / band + 1) ** blocks whatever the input, so their sizes may go to the driver.

Defined cases: a text without words has fingerprint zero and links like any other; a text with
fewer words than a shingle is one shingle; a null text is empty; rows with a null id share classes
but never name them, and a component of such rows only has a null name; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_batches, materialize, shuffle_parts, texts
from quillon.llm.components import components

SEED = 42
#: Names of classes whose rows all have null ids; above every real id in use.
NAMELESS = (1 << 63) - (1 << 33)


def shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words joined by spaces, repeats included."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(line[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(words: list[bytes], width: int, lanes: int) -> bytes:
    """Big-endian bytes, 64 bits a lane; lane k hashes with seed SEED + k."""
    out = []
    for lane in range(lanes):
        hashes = shingle_hashes(words, width, SEED + lane)
        ones = np.zeros(64, np.int64)
        for k in range(0, len(hashes), 1 << 15):
            part = hashes[k : k + (1 << 15)].astype(">u8")
            ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, width: int, bits: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint of ``text`` as bytes."""
    arrow_batches(docs.sparkSession)
    lanes = bits // 64

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.lower().split(), width, lanes) for t in texts(batch)]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=[*keep, "fp"])

    slim = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = slim.select(*keep).withColumn("fp", F.lit(None).cast("binary")).schema
    for field in schema:
        field.nullable = True
    return slim.mapInArrow(run, schema)


# -- tiles ---------------------------------------------------------------------------------


def as_lanes(column: pa.Array, bits: int) -> np.ndarray:
    """Fixed-length binaries as an array of big-endian 64-bit lanes."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, ">u8").reshape(-1, bits // 64).astype(np.uint64)


def tile_codes(fps: np.ndarray, bits: int, blocks: int, band: int):
    """Coordinates of each fingerprint's tile, and their code."""
    raw = fps.astype(">u8").view(np.uint8).reshape(len(fps), blocks, bits // 8 // blocks)
    counts = np.bitwise_count(raw).sum(axis=2, dtype=np.int64) // band
    base = bits // blocks // band + 1
    return counts, counts @ (base ** np.arange(blocks, dtype=np.int64)), base


def tile_steps(blocks: int, band: int, radius: int, base: int) -> list[tuple[tuple[int, ...], int]]:
    """Steps to tiles of a smaller code that may hold fingerprints within the radius."""
    reach = min(base, (radius - 1) // band + 1 if radius else 0)
    steps = []
    for d in product(range(-reach, reach + 1), repeat=blocks):
        gap = sum((abs(x) - 1) * band + 1 for x in d if x)
        code = sum(x * base**k for k, x in enumerate(d))
        if gap <= radius and code < 0:
            steps.append((d, code))
    return steps


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Grid:
    """Cells of bounded size over the occupied tiles."""

    def __init__(self, counts: dict[int, int], bits: int, radius: int, blocks: int, band: int, tile_rows: int):
        self.bits, self.radius, self.blocks, self.band = bits, radius, blocks, band
        self.base = bits // blocks // band + 1
        self.steps = tile_steps(blocks, band, radius, self.base)
        self.codes = np.array(sorted(counts), np.int64)
        rows = np.array([counts[c] for c in self.codes.tolist()], np.int64)
        self.subs = -(-rows // tile_rows)
        seen = {}
        for c, n in counts.items():
            digits = [(c // self.base**k) % self.base for k in range(blocks)]
            for d, step in self.steps:
                if c + step in counts and all(0 <= x + y < self.base for x, y in zip(digits, d)):
                    seen[c + step] = seen.get(c + step, 0) + n
        visits = np.array([seen.get(c, 0) for c in self.codes.tolist()], np.int64) + np.where(self.subs > 1, rows, 0)
        self.visits = np.maximum(1, -(-visits // tile_rows))
        self.first = np.concatenate([[0], np.cumsum(self.subs * self.visits)])
        self.pairs = float((rows * (np.minimum(rows, tile_rows) / 2.0 + visits)).sum())

    def cells(self, fps: np.ndarray):
        """(cell, row) arrays of residents and of visitors."""
        digits, codes, _ = tile_codes(fps, self.bits, self.blocks, self.band)
        home = np.searchsorted(self.codes, codes)
        mixed = _mix(np.bitwise_xor.reduce(fps, axis=1))
        sub = (mixed % self.subs[home].astype(np.uint64)).astype(np.int64)
        turn = (mixed >> np.uint64(33)).astype(np.int64)
        rows = np.arange(len(fps))
        out = ([], [])

        def add(kind, at, tile, s, v):
            out[kind].append((self.first[tile] + s * self.visits[tile] + v, at))

        for v in range(int(self.visits[home].max(initial=0))):
            k = rows[self.visits[home] > v]
            add(0, k, home[k], sub[k], v)
        for s in range(int(self.subs[home].max(initial=0)) - 1):
            k = rows[sub > s]
            add(1, k, home[k], s, turn[k] % self.visits[home[k]])
        for d, step in self.steps:
            near = digits + np.array(d)
            tile = np.searchsorted(self.codes, codes + step)
            ok = ((near >= 0) & (near < self.base)).all(axis=1) & (tile < len(self.codes))
            ok[ok] = self.codes[tile[ok]] == (codes + step)[ok]
            if not ok.any():
                continue
            k, t = rows[ok], tile[ok]
            for s in range(int(self.subs[t].max())):
                in_sub = self.subs[t] > s
                add(1, k[in_sub], t[in_sub], s, turn[k[in_sub]] % self.visits[t[in_sub]])
        return out


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j in place; a label is the least index of its set."""
    while True:
        a, b = label[i], label[j]
        new = a != b
        if not new.any():
            return
        i, j, a, b = i[new], j[new], a[new], b[new]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := label[label], label):
            label[:] = nxt


def link_cell(residents: np.ndarray, visitors: np.ndarray, radius: int) -> np.ndarray:
    """Set labels of residents followed by visitors, linked within the radius."""
    every = np.concatenate([residents, visitors])
    label, n = np.arange(len(every)), len(residents)
    weight = np.bitwise_count(every).sum(axis=1, dtype=np.int64)
    high, wide = 128, 2048
    for i in range(0, n, high):
        a = every[i : min(i + high, n)]
        low, top = weight[i : i + len(a)].min() - radius, weight[i : i + len(a)].max() + radius
        for j in range(i, len(every), wide):
            b = every[j : j + wide]
            if weight[j : j + wide].max() < low or weight[j : j + wide].min() > top:
                continue  # bit counts that differ beyond the radius
            apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
            for lane in range(1, every.shape[1]):
                apart = apart + np.bitwise_count(a[:, None, lane] ^ b[None, :, lane])
            x, y = np.nonzero(apart <= radius)
            if len(x):
                merge_labels(label, x + i, y + j)
    return label


def tile_links(classes: DataFrame, bits: int, radius: int, blocks: int, band: int, tile_rows: int) -> DataFrame:
    """``classes(fp, name)``, one row per fingerprint, to edges (a, b) that span every link within the radius."""
    spark = classes.sparkSession

    def count(batches):
        total: dict[int, int] = {}
        for batch in batches:
            codes, n = np.unique(tile_codes(as_lanes(batch.column("fp"), bits), bits, blocks, band)[1], return_counts=True)
            for c, k in zip(codes.tolist(), n.tolist()):
                total[c] = total.get(c, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["tile", "n"])

    sizes = classes.select("fp").mapInArrow(count, "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n")).collect()
    grid = Grid({r["tile"]: r["n"] for r in sizes}, bits, radius, blocks, band, tile_rows)

    def deal(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                for role, found in enumerate(grid.cells(as_lanes(part.column("fp"), bits))):
                    for cell, row in found:
                        at = pa.array(row)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cell, pa.int64()), pa.array(np.full(len(row), role, np.int32)), part.column("name").take(at), part.column("fp").take(at)],
                            names=["cell", "role", "name", "fp"],
                        )

    parts = int(min(20000, max(shuffle_parts(spark), grid.pairs / 4e9)))
    dealt = classes.mapInArrow(deal, "cell long, role int, name long, fp binary")
    return compare_cells(dealt, bits, radius, parts)


def link(prints: DataFrame, bits: int, radius: int, blocks: int, band: int, tile_rows: int = 1 << 15) -> DataFrame:
    """``prints(doc_id, fp, ...)`` (a stored table) with ``component_id``, the least doc_id reachable."""
    fallback = F.lit(NAMELESS) + F.xxhash64("fp").bitwiseAND((1 << 32) - 1)
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("name")).withColumn("name", F.coalesce("name", fallback))
    classes = materialize(classes, "simhash-classes")
    edges = tile_links(classes, bits, radius, blocks, band, tile_rows)
    label = components(edges)
    named = classes.join(label, F.col("name") == F.col("node"), "left").select("fp", F.coalesce("label", "name").alias("label"))
    component = F.when(F.col("label") < NAMELESS, F.col("label")).alias("component_id")
    return prints.join(named, "fp").select(*prints.columns, component)


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 64, radius: int = 2, blocks: int = 4, band: int = 1) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs(doc_id, text)``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = materialize(fingerprints(slim, width, bits), "simhash-prints")
    return link(prints, bits, radius, blocks, band)


# -- near-duplicates, verified -------------------------------------------------------------


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(words, width, SEED))


def set_fingerprint(grams: np.ndarray, lanes: int) -> bytes:
    """Majority bits of distinct shingles; lane k mixes the hashes k times further, a tie takes the bit of the least hash.

    Without that, texts of two or four shingles have few bits set and seem alike.
    """
    out, mixed = [], grams
    for lane in range(lanes):
        if lane:
            mixed = _mix(_mix(mixed + np.uint64(0x9E3779B97F4A7C15)))
        ones = np.zeros(64, np.int64)
        for k in range(0, len(mixed), 1 << 15):
            part = mixed[k : k + (1 << 15)].astype(">u8")
            ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        if len(mixed):
            ones = 2 * ones + np.unpackbits(mixed[:1].astype(">u8").view(np.uint8))
        out.append(np.packbits(ones > len(mixed)).tobytes())
    return b"".join(out)


def band_keys(grams: np.ndarray, bands: int, per_band: int) -> list[int]:
    """A key for each band of ``per_band`` least hashes of a set; of two sets alike in s each band agrees with s ** per_band."""
    if not len(grams):
        return [0] * bands
    many = np.arange(bands * per_band, dtype=np.uint64)
    turn, step = _mix(2 * many + np.uint64(1)) | np.uint64(1), _mix(many + np.uint64(1 << 32))
    least = np.full(len(many), np.iinfo(np.uint64).max)
    for k in range(0, len(grams), 1 << 14):
        part = grams[k : k + (1 << 14)]
        part = part ^ (part >> np.uint64(32))
        least = np.minimum(least, ((part[None, :] * turn[:, None] + step[:, None]) >> np.uint64(16)).min(axis=1))
    key = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, per_band).T:
        key = _mix(_mix(key) + column)
    return key.view(np.int64).tolist()


def set_prints(docs: DataFrame, width: int, bits: int, bands: int, per_band: int, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, fp, digest (equal for equal shingle sets) and the band keys."""

    def run(batches):
        for batch in batches:
            found = ([], [], [])
            for t in texts(batch):
                grams = shingle_set(t.lower().split(), width)
                found[2].append(band_keys(grams, bands, per_band))
                found[0].append(set_fingerprint(grams, bits // 64))
                found[1].append(xxhash.xxh3_128_digest(grams.tobytes()))
            made = [pa.array(c, t) for c, t in zip(found, (pa.binary(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "fp", "digest", "bands"])

    extra = {c: F.lit(None).cast(t) for c, t in (("fp", "binary"), ("digest", "binary"), ("bands", "array<long>"))}
    schema = docs.select(*keep).withColumns(extra).schema
    for field in schema:
        field.nullable = True
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def compare_cells(dealt: DataFrame, bits: int, radius: int, parts: int) -> DataFrame:
    """``dealt(cell, role, name, fp)`` to edges (a, b) that span the links of each cell: residents (role 0) with one another and with visitors."""

    def compare(batches):
        held, current = [], None

        def links():
            role, names, fps = (np.concatenate([h[k] for h in held]) for k in range(3))
            if len(names) < 2:
                return None
            order = np.lexsort((np.bitwise_count(fps).sum(axis=1, dtype=np.int64), role))
            names, fps, n = names[order], fps[order], int((role == 0).sum())
            label = link_cell(fps[:n], fps[n:], radius)
            k = np.nonzero(label != np.arange(len(label)))[0]
            return pa.RecordBatch.from_arrays([pa.array(names[k]), pa.array(names[label[k]])], names=["a", "b"]) if len(k) else None

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            role, name = batch.column("role").to_numpy(), batch.column("name").to_numpy()
            fps = as_lanes(batch.column("fp"), bits)
            cuts = [0, *(np.nonzero(np.diff(cell))[0] + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and current != cell[a]:
                    if (out := links()) is not None:
                        yield out
                    held.clear()
                current = cell[a]
                held.append((role[a:b], name[a:b], fps[a:b]))
        if held and (out := links()) is not None:
            yield out

    return dealt.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long")


def band_links(sets: DataFrame, bits: int, radius: int, tile_rows: int) -> DataFrame:
    """``sets(name, fp, bands)``, a stored table, to edges (a, b) that span the pairs within the radius that share a band key.

    The tiles are the band keys; one of more than ``tile_rows`` sets is compared block by block.
    """
    spark = sets.sparkSession
    rows = sets.select(F.explode("bands").alias("band"), "name", "fp")
    tiles = rows.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    tiles = materialize(tiles.select("band", F.ceil(F.col("m") / tile_rows).cast("long").alias("blocks")), "simhash-tiles")
    rows = rows.join(tiles, "band").select("band", F.pmod(F.xxhash64("name"), "blocks").alias("own"), F.col("blocks").alias("others"), "name", "fp")
    dealt = deal_blocks(rows, "band", ["name", "fp"])
    cell = F.xxhash64("band", "i", "j").alias("cell")  # of two cells with one hash the rows are compared as well
    return compare_cells(dealt.select(cell, "role", "name", "fp"), bits, radius, shuffle_parts(spark))


def deal_blocks(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Each row of ``rows(group, own, others, ...)``, of block ``own``, to the pairs (i, j) of its block with the first ``others`` ones."""
    dealt = rows.select(group, "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("other"), *columns)
    role = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("role")
    return dealt.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), role, *columns)


def alike_sets(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``similarity``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def verify_cell(fps: np.ndarray, sets: list[np.ndarray], n: int, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links that span every pair within the radius and alike; of the first ``n`` among each other if all are, else with the rest."""
    label, size, out = np.arange(len(sets)), np.array(list(map(len, sets))), []
    for a in range(n):
        begin = a + 1 if n == len(sets) else n
        far = np.bitwise_count(fps[begin:] ^ fps[a]).sum(axis=1, dtype=np.int64)
        fits = np.minimum(size[begin:], size[a]) >= similarity * np.maximum(size[begin:], size[a]) - 1e-9
        for b in (np.nonzero((far <= radius) & fits & (label[begin:] != label[a]))[0] + begin).tolist():
            if label[a] != label[b] and alike_sets(sets[a], sets[b], similarity):
                out.append((a, b))
                label[label == max(label[a], label[b])] = min(label[a], label[b])
    return out


def verified_links(members: DataFrame, width: int, similarity: float, bits: int, radius: int, cell_rows: int, cell_shingles: int) -> DataFrame:
    """``members(grp, name, fp, text)`` to edges (a, b) that join what the pairs of each group within the radius and alike join.

    Every member is compared with the first of its group. Those alike to it need no comparison with each other; the rest
    is compared block by block with one another and with them, so a task never holds more than two blocks.
    """
    spark = members.sparkSession

    def shingle(batches):
        for batch in batches:
            grams = [shingle_set(t.lower().split(), width) for t in texts(batch)]
            names = ["grp", "name", "fp"]
            made = [pa.array([len(g) for g in grams], pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "n", "grams"])

    def near(a: bytes, b: bytes) -> bool:
        return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() <= radius

    def lead(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("fp", "grams", "first_fp", "first_grams")))
            alike = [near(f, g) and alike_sets(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity) for f, a, g, b in rows]
            names = ["grp", "name", "fp", "n", "grams", "first"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(alike, pa.bool_())], names=[*names, "alike"])

    def compare(batches):
        held, current = [], None

        def links():
            held.sort(key=lambda h: h[0])
            n = sum(h[0] == 0 for h in held)
            fps = np.frombuffer(b"".join(h[2] for h in held), ">u8").reshape(-1, bits // 64).astype(np.uint64)
            found = verify_cell(fps, [np.frombuffer(h[3], np.uint64) for h in held], n, radius, similarity)
            return pa.RecordBatch.from_arrays([pa.array([held[k[side]][1] for k in found], pa.int64()) for side in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("grp", "i", "j", "role", "name", "fp", "grams")]
            for grp, i, j, *row in zip(*columns):
                if (grp, i, j) != current:
                    if len(held) > 1:
                        yield links()
                    held, current = [], (grp, i, j)
                held.append(row)
        if len(held) > 1:
            yield links()

    sets = materialize(members.mapInArrow(shingle, "grp long, name long, fp binary, n long, grams binary"), "simhash-shingles")
    first = sets.groupBy("grp").agg(F.min("name").alias("first"))
    first = first.join(sets.select("grp", F.col("name").alias("first"), F.col("fp").alias("first_fp"), F.col("grams").alias("first_grams")), ["grp", "first"])
    told = sets.join(first, "grp").mapInArrow(lead, "grp long, name long, fp binary, n long, grams binary, first long, alike boolean")
    told = materialize(told, "simhash-led")

    def blocks(alike: bool):
        of = F.col("alike") == alike
        return F.greatest(F.ceil(F.count_if(of) / cell_rows), F.ceil(F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)) / cell_shingles)).cast("long")

    sizes = told.groupBy("grp").agg(blocks(False).alias("b"), blocks(True).alias("b_alike")).where("b > 0")
    rest = told.join(sizes, "grp")
    own = F.when(F.col("alike"), F.col("b") + F.pmod(F.xxhash64("name"), "b_alike")).otherwise(F.pmod(F.xxhash64("name"), "b")).alias("own")
    others = F.when(F.col("alike"), F.col("b")).otherwise(F.col("b") + F.col("b_alike")).alias("others")
    dealt = deal_blocks(rest.select("grp", own, others, "name", "fp", "grams"), "grp", ["name", "fp", "grams"])
    edges = dealt.repartition(shuffle_parts(spark), "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(compare, "a long, b long")
    return edges.unionByName(told.where("alike and name <> first").select(F.col("name").alias("a"), F.col("first").alias("b")))


#: Bits that two texts of the given shingle similarity differ in, on average, plus a deviation for the spread.
def radius_of(similarity: float, bits: int, deviations: float = 1.0) -> int:
    cosine = 2 * similarity / (1 + similarity)
    share = np.arccos(cosine) / np.pi
    return int(round(bits * share + deviations * np.sqrt(bits * share * (1 - share))))


def drop_near_duplicates(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, bits: int = 128, bands: int = 16, per_band: int = 4,
    tile_rows: int = 1 << 15, cell_rows: int = 512, cell_shingles: int = 1 << 21,
) -> DataFrame:
    """One row of each group of near-duplicates of ``docs``: that of the least doc_id, with its columns as they were.

    Two rows are linked if the sets of their ``width``-word shingles have a Jaccard similarity of at least
    ``similarity``. SimHash finds the candidates: fingerprints within the radius of that similarity, its mean plus three
    deviations. So wide a radius leaves bit counts little to skip, so the tiles are the keys of ``bands`` bands of
    ``per_band`` least hashes of the sets, of which two sets alike in 0.8 share one but for 2 pairs in 10,000, and only
    fingerprints of one tile are compared. Each candidate link is then told by the sets themselves (as 64-bit hashes),
    and the groups are those of the true links.

    Defined cases: rows of equal sets are one; a null text is empty, and texts without words are one group; a text of
    fewer words than a shingle is one shingle; rows with a null id stay only if no row of their group has one, one for
    each such group; an empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    radius = radius_of(similarity, bits, 3.0)
    tagged = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row"), "text")
    rows = materialize(set_prints(tagged, width, bits, bands, per_band, keep=("doc", "_row")), "simhash-rows")
    first = F.min_by(F.struct("fp", "bands"), "_row").alias("s")
    sets = rows.groupBy("digest").agg(F.min("_row").alias("name"), first).select("digest", "name", "s.*")
    sets = materialize(sets, "simhash-sets")
    near = components(band_links(sets, bits, radius, tile_rows))  # candidates only: sets without one are not in it
    members = sets.join(near, F.col("name") == F.col("node")).select(F.col("label").alias("grp"), "name", "fp")
    members = members.join(rows.select(F.col("_row").alias("name"), F.col("doc.text").alias("text")), "name")
    edges = verified_links(members.select("grp", "name", "fp", "text"), width, similarity, bits, radius, cell_rows, cell_shingles)
    named = sets.join(components(edges), F.col("name") == F.col("node"), "left").select("digest", F.coalesce("label", "name").alias("grp"))
    named = materialize(named, "simhash-groups")
    ids = rows.select("digest", F.col("doc.doc_id").cast("long").alias("id"), "_row").join(named, "digest")
    first = ids.groupBy("grp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("_row"))).alias("first"))
    return rows.join(first.select(F.col("first._row").alias("_row")), "_row", "left_semi").select("doc.*")
