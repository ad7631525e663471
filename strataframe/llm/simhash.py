"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint bits are grouped into partitions of correlated bits. A pair within ``radius`` bits is within ``t`` bits in
some partition whenever the sum of ``t + 1`` over the partitions exceeds ``radius``; dynamic programming picks unequal
thresholds (0, 2, 4, or none at all) of least estimated work from statistics of all fingerprints. A threshold of ``2 r`` is
probed by giving each fingerprint every key within ``r`` bits of its own part: two parts within ``2 r`` bits share a key.
Fingerprints that share a key are verified on all bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import cut, fresh, kept, portions, release_memory
from .graph import connected_components
from .shingles import shingle_hashes, shingle_set

#: Members of one key that a task compares with each other; larger groups are dealt out in blocks.
BLOCK = 1024
#: What writing, moving and sorting one key costs, in comparisons of two fingerprints.
KEY_COST = 500
LANES = np.uint64(0x0101010101010101)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits for each hash; word 0 is the hash itself."""
    if not word:
        return h
    x = h + np.uint64((word * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of ``counts`` hashes: the word whose bits are set in over half the group (0 if empty)."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.cumsum(n) - n
    pieces = -(-n // 255)  # a byte lane holds 255 at most
    owner = np.repeat(np.arange(len(full)), pieces)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[owner] + 255 * inner
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    word = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        set_ = np.add.reduceat(lanes, starts, axis=0) * 2 > n[:, None]
        for j in range(8):
            word |= set_[:, j].astype(np.uint64) << np.uint64(8 * j + k)
    out[full] = word
    return out


def collision(bits: int, t: int, p: float) -> float:
    """The probability that two fingerprints differ in at most ``t`` of ``bits`` bits, when each bit differs with probability ``p``."""
    return sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(t + 1)) if t >= 0 else 0.0


def fingerprints(df: DataFrame, key: str, text: str, shingle: int, words: int = 1) -> DataFrame:
    """``(key, f0, ..., f{words-1})`` for every row, 64 bits a word; a text without words has zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in portions(batch.column(1)):
                part = batch.slice(at, size)
                hashes, counts = [], []
                for t in part.column(1).to_pylist():
                    found = shingle_hashes(t, shingle)
                    hashes += found
                    counts.append(len(found))
                h, n = np.array(hashes, np.uint64), np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(majority(_mixed(h, w), n).view(np.int64)) for w in range(words)]], names=["key", *[f"f{w}" for w in range(words)]])
        release_memory()

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, " + ", ".join(f"f{w} long" for w in range(words)))


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits of word 0, how many have both set (64 x 64, from all of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(f), 65536):
                bits = np.unpackbits(f[at : at + 65536].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, i]), pa.array(np.r_[-1, j]), pa.array(np.r_[n, both.ravel()].astype(np.int64))], names=["i", "j", "n"])

    both, total = np.zeros((64, 64)), 0
    for r in nodes.select("f0").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r.i < 0:
            total = r.n
        else:
            both[r.i, r.j] = r.n
    return total, both


def ball(width: int, radius: int) -> np.ndarray:
    """Every mask of ``width`` bits with at most ``radius`` set."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(width), k)], np.int64)


class Plan(list):
    """Partitions as ``(bits, threshold)``; bits numbered from the lowest."""


def _pairs_within(bits: list[int], t: int, n: int, differ: np.ndarray) -> float:
    """Estimated pairs of fingerprints within ``t`` bits on these bits: a beta-binomial with the mean and variance that the
    two-bit counts give exactly for a random pair. ``differ``: how often a random pair differs in both of two bits."""
    w = len(bits)
    d = differ[np.ix_(bits, bits)]
    mean = max(float(np.trace(d)), 1e-9)
    p = min(mean / w, 1 - 1e-9)
    var = max(float(d.sum()) - mean**2, 1e-9)
    rho = min(max((var / (w * p * (1 - p)) - 1) / max(w - 1, 1), 1e-6), 0.999)
    a, b = p * (1 / rho - 1), (1 - p) * (1 / rho - 1)
    log_beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    share = sum(math.exp(math.lgamma(w + 1) - math.lgamma(k + 1) - math.lgamma(w - k + 1) + log_beta(k + a, w - k + b) - log_beta(a, b)) for k in range(t + 1))
    return min(1.0, share) * n * n / 2


def _work(bits: list[int], t: int, n: int, differ: np.ndarray) -> float:
    """Estimated work of a partition: its keys, its pairs, and dealing keys with many members out in blocks."""
    keys = sum(math.comb(len(bits), k) for k in range(t // 2 + 1))
    members = keys * 2 * _pairs_within(bits, 0, n, differ) / max(n, 1)  # of a key
    return KEY_COST * n * keys * (1 + (math.ceil(members / BLOCK) + 1 if members > BLOCK / 4 else 0)) + _pairs_within(bits, t, n, differ)


def plan(n: int, both: np.ndarray, radius: int) -> Plan:
    """Partitions and thresholds of least estimated work for ``radius``; see the module's text."""
    return costed(n, both, radius)[0]


def costed(n: int, both: np.ndarray, radius: int, parts: tuple[int, ...] = (2, 3, 4, 5, 6)) -> tuple[Plan, float]:
    """:func:`plan` with its estimated work."""
    one = np.diag(both) / max(n, 1)
    joint = both / max(n, 1)
    none = 1 - one[:, None] - one[None, :] + joint
    only = one[:, None] - joint
    differ = 2 * (joint * none + only * only.T)  # both bits differ: 11/00 or 10/01
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-9))
    close = np.abs(joint - np.outer(one, one)) / np.outer(spread, spread)
    np.fill_diagonal(close, -1)
    order = [int(np.unravel_index(close.argmax(), close.shape)[0])]
    while len(order) < 64:  # the next bit is the one most correlated with the last few
        rest = [i for i in range(64) if i not in order]
        order.append(max(rest, key=lambda i: float(close[i, order[-6:]].max())))
    best: tuple[float, Plan] | None = None
    for m in parts:
        cuts = [round(64 * i / m) for i in range(m + 1)]
        groups = [sorted(order[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # covered so far: cost, thresholds
        for g in groups:
            new: dict[int, tuple[float, list[int]]] = {}
            for covered, (cost, ts) in table.items():
                for t in (-1, 0, 2, 4):
                    extra = 0.0 if t < 0 else _work(g, t, n, differ)
                    at = min(radius + 1, covered + t + 1)
                    if at not in new or cost + extra < new[at][0]:
                        new[at] = (cost + extra, [*ts, t])
            table = new
        if radius + 1 in table and (best is None or table[radius + 1][0] < best[0]):
            cost, ts = table[radius + 1]
            best = (cost, Plan((g, t) for g, t in zip(groups, ts, strict=True) if t >= 0))
    if best is None:
        raise ValueError(f"no thresholds cover {radius} bits")
    return best[1], best[0]


def _keys(f: np.ndarray, chosen: Plan) -> np.ndarray:
    """All keys of each fingerprint (rows); a key holds the partition's number above its bits."""
    out = []
    for i, (bits, t) in enumerate(chosen):
        part = np.zeros(len(f), np.int64)
        for k, b in enumerate(bits):
            part |= ((f >> np.int64(b)) & np.int64(1)) << np.int64(k)
        out.append((part[:, None] ^ ball(len(bits), t // 2)[None, :]) | np.int64(i << 56))
    return np.concatenate(out, axis=1)


def spanning_forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of an adjacency matrix, as index pairs."""
    k = len(near)
    a, b, left = [], [], np.ones(k, bool)
    for root in range(k):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            hit = near[front] & left
            new = np.flatnonzero(hit.any(0))
            b += new.tolist()
            a += front[hit[:, new].argmax(0)].tolist()
            left[new] = False
            front = new
    return a, b


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words, broadcast over all but the last axis."""
    out = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int16)
    for w in range(1, x.shape[-1]):
        out += np.bitwise_count(x[..., w] ^ y[..., w])
    return out


def _links(keys: np.ndarray, nodes: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys: all of them in short runs, a spanning forest of them in others."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    small = np.repeat(size <= 16, size)
    got_a, got_b = [], []
    for d in range(1, 16):
        i = np.flatnonzero(small[d:] & (keys[d:] == keys[:-d])) + d
        if not len(i):
            break
        i = i[_distance(f[i], f[i - d]) <= radius]
        got_a.append(nodes[i - d])
        got_b.append(nodes[i])
    for s, k in zip(first[size > 16].tolist(), size[size > 16].tolist(), strict=True):
        x = f[s : s + k]
        near = _distance(x[:, None, :], x[None, :, :]) <= radius
        if np.count_nonzero(near) > k:
            a, b = spanning_forest(near)
            got_a.append(nodes[s : s + k][a])
            got_b.append(nodes[s : s + k][b])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *got_a]), np.concatenate([none, *got_b])


def _verified(rows: DataFrame, words: int, radius: int, limit: int | None) -> DataFrame:
    """Links of rows ``(key, node, f...)``, as ``(a, b, hot)`` with ``hot`` null; runs over ``limit`` are passed on, row by row, as ``(node, null, key)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, hot=None):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), pa.nulls(n, pa.int64()) if hot is None else pa.array(hot, pa.int64())], names=["a", "b", "hot"])

        rest: list[np.ndarray] | None = None
        spilling: int | None = None  # the key whose rows are being passed on
        for batch in _with_end(batches):
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns] if batch is not None else None
            if cols is None:
                if rest is None or not len(rest[0]):
                    break
                cols, done = rest, True
                rest = None
            else:
                done = False
                if rest is not None and len(rest[0]):
                    cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            keys = cols[0]
            if spilling is not None:
                n = int(np.searchsorted(keys, spilling, "right"))
                if n:
                    yield out(cols[1][:n], None, keys[:n])
                    cols = [c[n:] for c in cols]
                    keys = cols[0]
                if len(keys):
                    spilling = None
                else:
                    rest = None
                    continue
            end = len(keys) if done else int(np.searchsorted(keys, keys[-1], "left"))
            rest = [c[end:] for c in cols]
            cols = [c[:end] for c in cols]
            if limit is not None and len(cols[0]):
                first = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
                size = np.diff(np.r_[first, len(cols[0])])
                hot = np.repeat(size > limit, size)
                if hot.any():
                    yield out(cols[1][hot], None, cols[0][hot])
                    cols = [c[~hot] for c in cols]
            if len(cols[0]):
                a, b = _links(cols[0], cols[1], np.stack(cols[2:], axis=1).view(np.uint64), radius)
                if len(a):
                    yield out(a, b)
            if limit is not None and len(rest[0]) > limit:
                spilling = int(rest[0][0])
                yield out(rest[1], None, rest[0])
                rest = None

    return rows.mapInArrow(run, "a long, b long, hot long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def links(nodes: DataFrame, words: int, radius: int, chosen: Plan | None = None, probed: int = 1) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the nodes ``(node, f0, ...)`` that share a key and lie within ``radius`` bits of each other.

    Keys are those of the plan ``chosen`` in the first ``probed`` words; ``words`` words, the last ones, are verified. Without a
    plan word 0 is probed so that every pair within ``radius`` shares a key. Of the pairs within a key only a spanning
    forest is returned. Keys with over ``BLOCK`` members are compared block against block by many tasks.
    """
    every = [c for c in nodes.columns if c != "node"]
    names = every[-words:]
    if chosen is None:
        n, both = bit_statistics(nodes)
        if n < 2:
            return nodes.sparkSession.createDataFrame([], "a long, b long")
        chosen = plan(n, both, radius)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                k = np.concatenate([_keys(part.column(1 + w).to_numpy(zero_copy_only=False), chosen) + np.int64(w << 59) for w in range(probed)], axis=1)
                own = pa.array(np.repeat(np.arange(part.num_rows), k.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), part.column(0).take(own), *[c.take(own) for c in part.columns[-words:]]], names=["k", "node", *names])

    rows = nodes.select("node", *every).mapInArrow(probe, "k long, node long, " + ", ".join(f"{x} long" for x in names))
    found = cut(_verified(rows.repartition("k").sortWithinPartitions("k"), words, radius, BLOCK))
    edges = found.where("hot IS NULL").select("a", "b")
    hot = found.where("hot IS NOT NULL").select(F.col("hot").alias("k"), F.col("a").alias("node"))
    blocks = hot.groupBy(F.col("k").alias("hk")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    dealt = hot.join(blocks, F.col("k") == F.col("hk")).select("k", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = dealt.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k"), "node").join(nodes.select("node", *names), "node").select("k", "node", *names)
    again = _verified(tasks.repartition("k").sortWithinPartitions("k"), words, radius, None).select("a", "b")
    return edges.unionByName(again).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``(key, f0, component)``: fingerprints of every row and the smallest key reachable over links.

    Two texts link when their fingerprints differ in ``radius`` bits or fewer; links chain. Null and blank texts have the
    zero fingerprint and link like others. A null key is no node: its component is null. Repeated keys are repeated in
    the result. An empty table gives an empty result; other columns of ``df`` play no part. Groups of equal fingerprints
    are one node, and are kept before they are joined to the rows, so that Spark can split one that has many rows.
    """
    prints = kept(fingerprints(df, key, text, shingle), "prints")
    nodes = cut(prints.where("key IS NOT NULL").groupBy("f0").agg(F.min(F.col("key").cast("long")).alias("node")).select("node", "f0"))
    parts = connected_components(links(nodes, 1, radius))
    grouped = kept(nodes.join(parts.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("f0", F.coalesce("component", "node").alias("component")), "groups")
    out = prints.join(grouped, "f0", "left")
    return out.select("key", "f0", F.when(F.col("key").isNotNull(), F.col("component")).alias("component"))


#: 64-bit words of the fingerprints that :func:`similar_texts` makes, the last two of which verify a pair.
WORDS = 16


def probing(n: int, both: np.ndarray, similarity: float, recall: float) -> tuple[Plan, int]:
    """A plan, and the number of words to probe with it, of least estimated work for pairs at ``similarity`` to share a key with ``recall``.

    Two sets of equal size and Jaccard similarity ``s`` have the cosine ``2 s / (1 + s)``, and a fingerprint bit of theirs
    differs with the probability ``acos(cosine) / pi``, less for sets of unequal size.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    best: tuple[float, Plan, int] | None = None
    for radius in range(1, 12):
        chosen, cost = costed(n, both, radius)
        hit = 1 - math.prod(1 - collision(len(bits), t, p) for bits, t in chosen)
        probed = math.ceil(math.log(1 - recall) / math.log(max(1 - hit, 1e-12)))
        if probed <= WORDS and (best is None or cost * probed < best[0]):
            best = cost * probed, chosen, probed
    if best is None:
        raise ValueError(f"{WORDS} words do not find {recall} of the pairs at {similarity}")
    return best[1], best[2]


def similar_texts(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, recall: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """``(key, th, component)`` of every row and ``(component, key, th)`` of the row that stays for each component.

    Two texts link when their sets of ``shingle``-word shingles (A-Z in lower case) have a Jaccard similarity of ``percent``
    hundredths or more; links chain. Candidates are found by fingerprints of the sets: a pair at the bound shares a key of
    some probed word with a probability of about ``recall`` (nearer pairs more often), and is compared on two more words.
    What these connect is then linked exactly by the sets themselves, so no text links with another below the bound.

    Texts of equal sets always link, null and blank texts with each other. ``component`` is a number of no meaning; ``th`` is
    a hash of the text. The row that stays is the one of smallest key, null last; of rows of that key the one of smallest
    ``th``. Repeated rows are repeated in the first table. Keys may repeat, with any texts. An empty table gives empty ones.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    names = [f"f{w}" for w in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in portions(batch.column(2)):
                part = batch.slice(at, size)
                sets = [shingle_set(t, shingle) for t in part.column(2).cast(pa.binary()).to_pylist()]
                ids = np.array([[xxhash.xxh3_64_intdigest(s.tobytes(), seed) for seed in (1, 2)] for s in sets], np.uint64).view(np.int64)
                n, h = np.fromiter(map(len, sets), np.int64, len(sets)), np.concatenate(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids[:, 0]), pa.array(ids[:, 1]), *[pa.array(majority(_mixed(h, w), n).view(np.int64)) for w in range(WORDS)]], names=["key", "th", "a", "b", *names])
        release_memory()

    prints = kept(rows.select("key", "th", "text").mapInArrow(run, "key long, th long, a long, b long, " + ", ".join(f"{x} long" for x in names)), "prints")
    least = F.min(F.struct(F.col("key").isNull().alias("nul"), "key", "th")).alias("least")
    nodes = prints.groupBy("a", "b").agg(least, *[F.first(x).alias(x) for x in names]).withColumn("node", F.monotonically_increasing_id())
    nodes = kept(nodes.select("node", "a", "b", "least.key", "least.th", *names), "nodes")  # numbers do not change once they are kept
    words = nodes.select("node", *names)
    n, both = bit_statistics(words)
    if n > 1:
        chosen, probed = probing(n, both, percent / 100, recall)
        p = math.acos(200 * percent / (100 + percent) / 100) / math.pi
        near = next(t for t in range(129) if collision(128, t, p) >= 0.999)
        loose = kept(connected_components(links(words, 2, near, chosen, probed)), "loose")
        wanted = nodes.join(loose.withColumnRenamed("node", "l"), F.col("node") == F.col("l")).select("node", F.xxhash64("key", "th").alias("wr"), F.col("th").alias("wt"))
        own = rows.select(F.xxhash64("key", "th").alias("r"), "th", "text")
        texts = own.join(wanted, (F.col("r") == F.col("wr")) & (F.col("th") == F.col("wt"))).groupBy("r", "th", "node").agg(F.first("text").alias("text"))
        sets = jaccard.sets_of(texts.select("node", "text"), shingle)
        members = kept(sets.join(loose.select(F.col("node").alias("l"), F.col("component").alias("group")), F.col("node") == F.col("l")).select("group", "node", "hashes"), "sets")
        parts = connected_components(jaccard.exact_links(members, percent)).withColumnRenamed("node", "l")
        nodes = nodes.join(parts, F.col("node") == F.col("l"), "left")
    else:
        nodes = nodes.withColumn("component", F.lit(None).cast("long"))
    nodes = kept(nodes.select("a", "b", "key", "th", F.coalesce("component", "node").alias("component")), "components")
    stays = nodes.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("nul"), "key", "th")).alias("least")).select("component", "least.key", "least.th")
    return prints.select("key", "th", "a", "b").join(nodes.select("a", "b", "component"), ["a", "b"]).select("key", "th", "component"), stays


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one row of each component of :func:`similar_texts`; its columns, of whatever names, are kept.

    Of repeated rows one stays, and of rows of one key those whose texts differ by more than the bound.
    """
    r, t = fresh(df, "row"), fresh(df, "text")
    _, stays = similar_texts(df, key, text, **options)
    stays = stays.select(F.xxhash64("key", "th").alias(f"{r}s"), F.col("th").alias(f"{t}s"))
    own = df.withColumn(t, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn(r, F.xxhash64(F.col(key).cast("long"), F.col(t)))
    return own.dropDuplicates([r, t]).join(stays, (F.col(r) == F.col(f"{r}s")) & (F.col(t) == F.col(f"{t}s")), "left_semi").drop(r, t)
