"""Near-duplicate detection: fast similarity sketches, banding, exact verification, components.

A document is the set of its distinct 5-word shingles, held as sorted 64-bit hashes. Its sketch has
`BANDS * ROWS` coordinates: in round i every element is thrown into a hashed bin and offers
(i, hash); a bin keeps its smallest offer; after as many rounds as there are bins, round i fills
bin i - t, so every coordinate is full after 2t rounds, and agreement of coordinates estimates
similarity with the concentration of that scheme. Two sets of similarity s meet in a bucket with
probability 1 - (1 - s^ROWS)^BANDS: at 0.8 all but 1.3e-7 of links meet, at 0.85 all but 1e-10.

1. Documents with equal sets are one class; only one of each class goes on.
2. Every bucket of two or more classes tests each against the smallest one, its pivot: as many
   pairs as members. Pairs whose sizes forbid a link go first; the rest are confirmed on full sets.
3. Components of these links. Buckets whose members are all in one component are done, as are pairs.
4. In every other bucket, members of different components are still to be compared. Its largest
   component is dealt in blocks; the others meet every block, and each other in pairs of blocks. A
   task has one or two blocks, counts exact intersections by matrix products over shared shingles,
   and returns only the links that join components. That holds for buckets of up to `BLOCKS` blocks,
   so no set is sent more than BLOCKS times. Members of larger ones are split by what they share
   first: two sets of similarity t have a shingle in common among the |x| - ceil(t|x|) + 1 shingles
   of each that are in the fewest sets, so members meet under those shingles alone (most occur in no
   other set and lead nowhere). A shingle with at most `FEW` members gives pairs, which are confirmed
   on full sets; one with more is dealt in blocks like a bucket. Components again.

So buckets have no cap and no group is gathered whole. Members of one bucket that are unlike each
other cost rows in proportion to their shingles. Only where more than FEW members share even their
rarest shingles, and are still not linked through a pivot, do rows grow with members x blocks.

Defined results: null or empty text, or text of white space, has an empty set, is a group of its own
and is kept; fewer than five words are one shingle; null ids sort last; rows that repeat an id and
a text are copies of each other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach_groups, discard, documents, materialize, released
from .components import components

WORDS = 5
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
BLOCK = 512
BLOCKS = 16
FEW = 48
_RNG = np.random.default_rng(10)
_PLACE = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_ROUND = _RNG.integers(1, 2**63, 2 * BINS, dtype=np.uint64)
_BAND = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LOW40 = np.uint64((1 << 40) - 1)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(56)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


class Words(dict):
    """64-bit hashes of words, kept; a full memo (at most 256 Ki words, about 32 MB) starts afresh. Long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        if len(word) > 64:
            return xxhash.xxh3_64_intdigest(word)
        if len(self) >= 1 << 18:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: str | None, memo: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles. bytes.lower and bytes.split know ASCII only, as the rule has it."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    if len(h) < WORDS:
        acc = np.array([len(h)], np.uint64)
        for x in h:
            acc = _mix(acc ^ x)
        return acc
    n = len(h) - WORDS + 1
    acc = h[:n] * _PLACE[0]
    for k in range(1, WORDS):
        acc += _mix(h[k : k + n] + np.uint64(k)) * _PLACE[k]
    return np.unique(_mix(acc))


def sketch(x: np.ndarray) -> np.ndarray:
    """The BINS coordinates of a set that isn't empty."""
    out, empty, i = np.zeros(BINS, np.uint64), np.ones(BINS, bool), 0
    while i < 2 * BINS and empty.any():
        k = min(max(1, 4096 // len(x)), 255, BINS - i % BINS)
        v = _mix(x[None, :] ^ _ROUND[i : i + k, None])
        local = np.arange(k, dtype=np.uint64)[:, None]
        bins = ((v >> np.uint64(40)) * np.uint64(BINS)) >> np.uint64(24) if i < BINS else np.broadcast_to(np.uint64(i - BINS) + local, v.shape)
        offers = np.sort(((bins << np.uint64(56)) | (local << np.uint64(48)) | ((v & _LOW40) << np.uint64(8))).ravel())
        at = np.minimum(np.searchsorted(offers, _EDGES), len(offers) - 1)
        best = offers[at]
        new = empty & ((best >> np.uint64(56)) == np.arange(BINS, dtype=np.uint64))
        out[new] = (((best[new] >> np.uint64(48)) & np.uint64(255)) + np.uint64(i)) << np.uint64(40) | ((best[new] >> np.uint64(8)) & _LOW40)
        empty &= ~new
        i += k
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    acc = _BAND.copy()
    for row in coordinates.reshape(BANDS, ROWS).T:
        acc = _mix(acc ^ row) + _BAND
    return acc.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """From (rid, doc_id, k1, k2, text): rid, doc_id, k1, k2, n, set_key, bands (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            n, keys, all_bands = [], [], []
            for text in batch.column(4).to_pylist():
                s = shingles(text, memo)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                all_bands.append(bands(sketch(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(all_bands, pa.list_(pa.int64()))], names=["rid", "doc_id", "k1", "k2", "n", "set_key", "bands"])

    return docs.mapInArrow(released(run), "rid long, doc_id long, k1 long, k2 long, n long, set_key binary, bands array<long>")


def with_sets(docs: DataFrame) -> DataFrame:
    """From (cid, text): cid and its set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            sets = [shingles(t, memo).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["cid", "set"])

    return docs.mapInArrow(released(run), "cid long, set binary")


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """From (a, b, set_a, set_b): the links a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            keep = []
            for k, (x, y) in enumerate(zip(left, right, strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[k] for k in keep], pa.int64()), "b": pa.array([b[k] for k in keep], pa.int64())})

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(released(run), "a long, b long")


def block_links(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different components among some members, a spanning forest of them, on exact intersections."""
    m, sizes = len(ids), np.array([len(s) for s in sets])
    owner, values = np.repeat(np.arange(m), sizes), np.concatenate(sets)
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[code]
    rows, cols = owner[use], place[code[use]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    common = np.zeros((m, m), np.float32)
    width = max(256, (4 << 20) // max(1, m))
    for a in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(cols, [a, a + width])
        part = np.zeros((m, width), np.float32)
        part[rows[low:high], cols[low:high] - a] = 1
        common += part @ part.T
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    linked &= component[:, None] != component[None, :]
    root = {int(c): int(c) for c in component}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = find(int(component[i])), find(int(component[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def open_buckets(members: DataFrame) -> DataFrame:
    """key, main (the largest component), n_main, n_other, members: buckets that have several components and aren't mere pairs."""
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy("key").agg(F.max(F.struct("size", (-F.col("component")).alias("component"))).alias("m"), F.sum("size").alias("members"), F.count(F.lit(1)).alias("components")).filter("components > 1 AND members > 2")
    return materialize(main.select("key", (-F.col("m.component")).alias("main"), F.col("m.size").alias("n_main"), (F.col("members") - F.col("m.size")).alias("n_other"), "members"), "near-open")


def rare_postings(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key (a shingle), cid, n, component, df: members under their rarest shingles, as many as it takes for two linked sets to share one. A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(k).to_numpy(), sizes)) for k in range(3)] + [pa.array(raw)], names=["cid", "n", "component", "key"])

    wanted = members.select("cid", "n", "component").distinct().join(sets, "cid").select("cid", "n", "component", "set")
    every = materialize(wanted.mapInArrow(released(run), "cid long, n long, component long, key long"), "near-shingles")
    common = materialize(every.groupBy("key").agg(F.count(F.lit(1)).alias("df")), "near-common")
    ranked = attach_groups(every, common, "key", "df", every.count())
    first = Window.partitionBy("cid").orderBy("df", "key")
    out = ranked.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    out = materialize(out.filter("df > 1").drop("nth"), "near-postings")
    discard(every, common)
    return out


def remaining_links(members: DataFrame, sets: DataFrame, percent: int, block: int, few: int = FEW, blocks: int = BLOCKS) -> DataFrame:
    """Links between members of different components of a bucket. members: key, cid, n, component; with sets a written table."""
    main = open_buckets(members)
    met = attach_groups(members, main, "key", "members", members.count()).filter("main IS NOT NULL")
    met = materialize(met, "near-unsettled")
    small, large = met.filter(F.col("members") <= blocks * block), met.filter(F.col("members") > blocks * block)
    found = block_groups(small, sets, percent, block)
    if large.limit(1).count():
        postings = rare_postings(large, sets, percent)
        some = postings.filter(F.col("df") <= few)
        a, b = (some.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("cid", "n", "component")]) for x in "ab")
        near = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("component_a") != F.col("component_b"))
        pairs = a.join(b, "key").filter("cid_a < cid_b").filter(near).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).distinct()
        sided = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b")), "b")
        many = postings.filter(F.col("df") > few).drop("df")
        main = open_buckets(many)
        found = found.unionByName(confirmed(sided, percent)).unionByName(block_groups(attach_groups(many, main, "key", "members", many.count()).filter("main IS NOT NULL"), sets, percent, block))
    return found


def block_groups(met: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links out of comparisons of blocks. met: key, cid, component and what `open_buckets` says of the key."""
    main_blocks, other_blocks = F.ceil(F.col("n_main") / block).cast("int"), F.ceil(F.col("n_other") / block).cast("int")
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("component") == F.col("main"), main_blocks).otherwise(other_blocks)).cast("int")
    met = met.withColumn("own", own).withColumn("main_blocks", main_blocks).withColumn("other_blocks", other_blocks)
    # A group is named by two blocks: (main, other) or two of the others, the smaller first.
    groups = F.when(F.col("component") == F.col("main"), F.transform(F.sequence(F.lit(0), F.col("other_blocks") - 1), lambda o: F.struct(F.lit(0).alias("kind"), F.col("own").alias("x"), o.alias("y")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda b: F.struct(F.lit(0).alias("kind"), b.alias("x"), F.col("own").alias("y"))),
            F.when(F.col("other_blocks") > 1, F.transform(F.filter(F.sequence(F.lit(0), F.col("other_blocks") - 1), lambda o: o != F.col("own")), lambda o: F.struct(F.lit(1).alias("kind"), F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))).otherwise(F.array()),
        )
    )
    dealt = met.select("key", "cid", "component", F.explode(groups).alias("g")).select("key", "g.kind", "g.x", "g.y", "cid", "component")
    dealt = dealt.join(sets, "cid")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        got = block_links(group["cid"].to_numpy(), group["component"].to_numpy(), [np.frombuffer(s, np.uint64) for s in group["set"]], percent)
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("key", "kind", "x", "y").applyInPandas(run, "a long, b long")


class NearDuplicates:
    """The narrow table `docs` (rid, doc_id, k1, k2, n, set_key), the `classes` and their groups."""

    def __init__(self, docs: DataFrame, percent: int = 80, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"):
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64("text", "doc_id", F.lit(7)))
        rows = sketches(source.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "k1", "k2", "text"))
        sketched = materialize(rows, "near-sketches")
        self.docs = materialize(sketched.drop("bands"), "near-rows")
        self.rows = sketched.count()
        least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "k1", "k2", "n")
        classes = sketched.filter("n > 0").groupBy("set_key").agg(F.min(least).alias("best"), F.count(F.lit(1)).alias("copies"))
        classes = materialize(classes.select("set_key", "copies", F.col("best.rid").alias("cid"), "best.doc_id", "best.k1", "best.k2", "best.n"), "near-classes")
        # one of each class: its row is known by rid
        kept = sketched.select("rid", "n", "bands").join(classes.select(F.col("cid").alias("rid")), "rid")
        members = kept.select(F.explode("bands").alias("key"), F.col("rid").alias("cid"), "n")
        every = members = materialize(members, "near-members")
        discard(sketched)
        buckets = members.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1")
        buckets = materialize(buckets.select("key", "members", F.col("pivot.cid").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "near-buckets")
        members = materialize(attach_groups(members, buckets, "key", "members", members.count()).filter("pivot IS NOT NULL"), "near-met")
        discard(every, buckets)
        wanted = members.select("cid").distinct().join(classes.select("cid", "k1", "k2"), "cid")
        found = source.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("cid", "text")
        sets = materialize(with_sets(found), "near-sets")
        pairs = members.filter("cid <> pivot").filter(F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent).select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct()
        pairs = materialize(pairs, "near-pairs")
        hubs = materialize(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("times")).join(sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b")), "b"), "near-hubs")
        sided = attach_groups(pairs, hubs, "b", "times", pairs.count(), share=50).join(sets.select(F.col("cid").alias("a"), F.col("set").alias("set_a")), "a")
        links = materialize(confirmed(sided, percent), "near-links")
        discard(pairs, hubs)
        first = components(links)
        known = materialize(members.select("key", "cid", "n").join(first.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")), "near-known")
        discard(members)
        more = materialize(remaining_links(known, sets, percent, block), "near-more")
        discard(known, sets)
        if more.limit(1).count():
            first = components(links.unionByName(more))
        joined = classes.join(first.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        met = classes
        joined = materialize(joined, "near-joined")
        discard(links, more, met)
        best = joined.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("cid").alias("rid"))).alias("best"), F.count(F.lit(1)).alias("n_classes"))
        best = materialize(best, "near-best")
        classes = attach_groups(joined, best, "component", "n_classes", joined.count())
        self.classes = materialize(classes.select("set_key", "copies", F.col("best.doc_id").alias("component_id"), F.col("best.rid").alias("keep_rid")), "near-groups")
        discard(joined, best)

    def resolved(self) -> DataFrame:
        """rid, doc_id, k1, k2, n, component_id, keep_rid of every row."""
        met = attach_groups(self.docs, self.classes, "set_key", "copies", self.rows)
        return met.select("rid", "doc_id", "k1", "k2", "n", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("keep_rid", "rid").alias("keep_rid"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`."""
    rows = NearDuplicates(docs, **options).resolved()
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("rid") == F.col("keep_rid")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: the smallest id, nulls last."""
    found = NearDuplicates(docs, id_col=id_col, text_col=text_col, **options)
    rows = materialize(found.resolved(), "near-resolved")
    discard(found.docs, found.classes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(id_col).cast("long"), text).alias("k1"), F.xxhash64(text, F.col(id_col).cast("long"), F.lit(7)).alias("k2"))
    gone = rows.filter("rid <> keep_rid").select("k1", "k2").distinct()
    again = rows.filter("rid = keep_rid").select("k1", "k2")
    # Rows that repeat an id and a text share their keys: the one to keep is among them.
    repeated = gone.join(again, ["k1", "k2"], "left_semi")
    left = keyed.join(gone.join(again, ["k1", "k2"], "left_anti"), ["k1", "k2"], "left_anti")
    if not repeated.limit(1).count():
        return left.select("row.*")
    mixed = left.join(repeated.withColumn("twice", F.lit(True)), ["k1", "k2"], "left")
    return mixed.filter("twice IS NULL").select("row.*").unionByName(mixed.filter("twice").dropDuplicates(["k1", "k2"]).select("row.*"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)
