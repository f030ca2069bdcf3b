"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

The work on texts that no band brings together ends with their signature. Texts with equal n-gram sets become one set
with a number of copies. Pairs of sets meet where a band brings them together: in the bucket of the first band hash that
both have, or, for sets that share so many bands that they would meet again and again, once in their cluster. A set is
sent to each such meeting once (large ones are cut into blocks and each pair of blocks is a task), and there pairs are
compared on their full sets of n-gram hashes. Only counts and a spanning forest of the links leave a task, never the
pairs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm import hashing
from lexivec.llm.common import fresh, join_counted, sieve, text_of
from lexivec.llm.graphs import components
from lexivec.llm.hashing import U64, mixed
from lexivec.sources.folders import materialize

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9995
MAX_HASHES = 256
#: Sets in a block, and n-grams in a block.
BLOCK_SETS, BLOCK_GRAMS = 1024, 1 << 21
#: Meetings that are smaller than a block share tasks of about so many sets.
TASK_SETS = 256


def plan_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold shares some band with probability recall."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1)
    for rows in range(2, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


class Shingler:
    """64-bit hashes of the word n-grams of a text; words are runs of bytes that are not ASCII white space."""

    def __init__(self, words: int = WORDS):
        self.words, self.hasher = words, hashing.RangeHasher(20240501)
        self.places = np.random.default_rng(20240505).integers(1, 1 << 63, words, dtype=U64) | U64(1)
        self.inside = np.ones(256, bool)
        self.inside[list(b" \t\n\x0b\f\r")] = False

    def grams(self, text: str) -> np.ndarray:
        """Sorted, distinct; a text of fewer words is a single n-gram, one without words has none."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        h = self.hasher(data, *hashing.runs(data, self.inside))
        return np.unique(hashing.grams(h, self.places[: min(self.words, len(h))])) if len(h) else h


class Signer:
    """Band hashes of a set of n-gram hashes."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240502)
        self.bands, self.rows = bands, rows
        self.factors = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
        self.weights = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | U64(1)
        self.salts = rng.integers(1, 1 << 63, bands, dtype=np.uint64)

    def sign(self, grams: np.ndarray) -> np.ndarray:
        x = (grams ^ (grams >> U64(32))).astype(np.uint32)
        least = np.full(self.bands * self.rows, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(least, (self.factors * x[i : i + 1024]).min(axis=1), out=least)
        return mixed((least.reshape(self.bands, self.rows).astype(np.uint64) * self.weights).sum(axis=1, dtype=np.uint64) + self.salts).view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """(doc_id, text_hash, set_key, n_grams, bands) for each row of (doc_id, text); without words the last three are null."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, signer = Shingler(words), Signer(bands, rows)
        for pdf in batches:
            keys, sizes, hashes = [], [], []
            for text in pdf["text"]:
                g = shingler.grams(text)
                keys.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
                sizes.append(len(g))
                hashes.append(signer.sign(g) if len(g) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "set_key": keys, "n_grams": sizes, "bands": hashes})

    rows_in = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text_of().alias("text"))
    signed = rows_in.mapInPandas(sign, "doc_id string, text_hash bigint, set_key binary, n_grams int, bands array<bigint>")
    return signed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _overlaps(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions (i of left, j of right, i != j) whose sets have a Jaccard similarity of threshold or more."""
    sizes = np.array([len(g) for g in grams])
    ids, inverse, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(grams)), sizes)
    shared = counts[inverse] > 1
    ids_of, owner = inverse[shared], owner[shared]
    bounds = np.searchsorted(owner, np.arange(len(grams) + 1))
    mark = np.zeros(len(ids), np.int64)
    a, b = [], []
    in_right = np.zeros(len(grams), bool)
    in_right[right] = True
    keep = in_right[owner]
    right_ids, right_owner = ids_of[keep], owner[keep]
    for i in left:
        own = ids_of[bounds[i] : bounds[i + 1]]
        if not len(own):
            continue
        mark[own] = 1
        common = np.bincount(right_owner, mark[right_ids], len(grams))
        mark[own] = 0
        hit = np.flatnonzero(common >= threshold * (sizes + sizes[i] - common) - 1e-9)
        hit = hit[(hit != i) & in_right[hit] & (common[hit] > 0)]
        a.append(np.full(len(hit), i))
        b.append(hit)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position in each position's component."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows, sets) of the join of docs (doc_id, text) with itself.

    rows: doc_id, text_hash, set_key, one for each row of docs. sets: set_key, first_id (the smallest doc_id), copies,
    n_links (rows at the threshold or more, without itself), root (set_key of the component).
    Null and empty texts have no n-grams: their set_key is null and they link to nothing. Texts with the same words in
    the same order are copies whatever their white space. Repeated rows are copies of each other; null ids are rows
    like any others."""
    bands, per_band = plan_bands(threshold, recall)
    rows = materialize(signatures(docs.select("doc_id", "text"), bands, per_band, words))
    sets = materialize(
        rows.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    )
    tasks = materialize(_meetings(sets, max(1, round(bands * threshold**per_band / 2))))
    found = materialize(_verified(docs, sets, tasks, threshold, words))
    roots = components(found.where("root is not null").select(F.col("set_key").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "set_key"})
    counts = found.groupBy("set_key").agg(F.sum("n_links").alias("linked"))
    sets = (
        sets.drop("bands", "n_grams")
        .join(counts, "set_key", "left")
        .join(roots, "set_key", "left")
        .select("set_key", "first_id", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "set_key").alias("root"))
    )
    return rows.select("doc_id", "text_hash", "set_key"), sets


def _meetings(sets: DataFrame, strong: int) -> DataFrame:
    """(set_key, cluster, task, i, j, block, at): the tasks that compare each set, with the block it is in there and its
    places (band, unit) in the meetings of that task.

    Sets that share `strong` bands or more with the smallest set of their buckets are a cluster, which meets once (band
    -1). A bucket meets too if it has sets of more than one cluster; large clusters in it are blocks of their own, which
    are not compared with themselves again."""
    banded = sets.select("set_key", F.posexplode("bands").alias("band", "hash")).select("set_key", "band", F.xxhash64("band", "hash").alias("bucket"))
    total = banded.count()
    buckets = materialize(banded.groupBy("bucket").agg(F.min("set_key").alias("head"), F.count("*").alias("k")).where("k > 1"))
    shared = materialize(join_counted(banded, buckets, "bucket", "k", total))
    ties = shared.where("set_key != head").groupBy("set_key", "head").count().where(F.col("count") >= strong)
    clusters = components(ties.select(F.col("set_key").alias("a"), F.col("head").alias("b"))).withColumnsRenamed({"node": "set_key", "root": "cluster"})
    placed = shared.join(clusters, "set_key", "left").select("set_key", "band", "bucket", "k", F.coalesce("cluster", "set_key").alias("cluster"))
    mixed_buckets = placed.groupBy("bucket").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.first("k").alias("k")).where("low != high")
    apart = join_counted(placed.drop("k"), mixed_buckets.select("bucket", "k"), "bucket", "k", total).select("set_key", "band", F.col("bucket").alias("unit"), "cluster")
    together = clusters.select("set_key", F.lit(-1).alias("band"), F.xxhash64("cluster").alias("unit"), "cluster")
    members = materialize(apart.unionByName(together).join(sets.select("set_key", "n_grams"), "set_key"))

    # Blocks: (0, b) for sets of small clusters, (c, b) for the c-th large cluster of a bucket.
    per_cluster = members.groupBy("band", "unit", "cluster").agg(F.count("*").alias("k"), F.sum("n_grams").alias("g"))
    needed = F.greatest(F.col("k") / BLOCK_SETS, F.col("g") / BLOCK_GRAMS)
    large = (F.col("band") >= 0) & (needed > 1)
    units = per_cluster.groupBy("band", "unit").agg(
        F.sum("k").alias("rows"),
        F.array_sort(F.collect_list(F.when(large, F.struct("cluster", F.ceil(needed).cast("int").alias("n"))))).alias("large"),
        F.ceil(F.sum(F.when(large, 0.0).otherwise(needed))).cast("int").alias("rest"),
    )
    units = materialize(units.select("band", "unit", "rows", "large", F.concat(F.array("rest"), F.transform("large", lambda x: x["n"])).alias("blocks")))
    small = (F.size("blocks") == 1) & (F.get("blocks", F.lit(0)) == 1)
    found = units.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(small, F.col("rows"))), F.lit(0)).alias("small")).first()
    n_tasks = found["small"] // TASK_SETS + 1
    joined = join_counted(members.drop("n_grams"), units, ["band", "unit"], "rows", found["rows"])

    def block(c: Column, b: Column) -> Column:
        return F.struct(c.cast("int").alias("c"), b.cast("int").alias("b"))

    c = F.coalesce(F.array_position(F.transform("large", lambda x: x["cluster"]), F.col("cluster")), F.lit(0))
    own = block(c, F.pmod(F.xxhash64("set_key", F.lit(1)), F.get("blocks", c.cast("int"))))
    others = F.flatten(F.transform("blocks", lambda n, i: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: block(i, b))).otherwise(F.array().cast("array<struct<c:int,b:int>>"))))
    spread = joined.withColumn("own", own).withColumn("other", F.explode(F.filter(others, lambda o: (o["c"] != F.col("own.c")) | (o["c"] == 0))))
    shown = [F.concat_ws(":", x["c"], x["b"]) for x in (F.least("own", "other"), F.greatest("own", "other"), F.col("own"))]
    spread = spread.select(
        "set_key", "cluster", "band", "unit",
        F.when(small, F.pmod(F.xxhash64("band", "unit"), F.lit(n_tasks)).cast("string")).otherwise(F.concat_ws(":", F.col("band").cast("string"), F.col("unit").cast("string"))).alias("task"),
        *[x.alias(name) for x, name in zip(shown, ("i", "j", "block"), strict=True)],
    )
    return spread.groupBy("set_key", "cluster", "task", "i", "j", "block").agg(F.collect_set(F.struct("band", "unit")).alias("at"))


def _verified(docs: DataFrame, sets: DataFrame, tasks: DataFrame, threshold: float, words: int) -> DataFrame:
    """(set_key, n_links, root) from each task that compared the set; root is null where it found no link."""
    members = materialize(sets.join(tasks.select("set_key").distinct(), "set_key", "left_semi"))

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for pdf in batches:
            grams = [shingler.grams(t) for t in pdf["text"]]
            keys = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in grams]
            yield pd.DataFrame({"set_key": keys, "grams": [g.view(np.int64) for g in grams]})

    firsts = materialize(members.select(F.col("first_id").alias("wanted")).distinct())
    near, _ = sieve(docs.select("doc_id", "text"), F.xxhash64("doc_id"), firsts.select(F.xxhash64("wanted").alias("key")))
    texts = near.join(firsts, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    grams = texts.select(text_of().alias("text")).mapInPandas(shingle, "set_key binary, grams array<bigint>")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("set_key").drop_duplicates("set_key", ignore_index=True)
        left, right = ((pdf["block"] == pdf[end].iloc[0]).to_numpy() for end in "ij")
        bands = np.stack(pdf["bands"])
        a, b = _overlaps([np.asarray(g, np.int64) for g in pdf["grams"]], np.flatnonzero(left), np.flatnonzero(right), threshold)
        # A pair counts where it meets: in its cluster, or else in the bucket of the first band that both sets have.
        unit_of = np.full((len(pdf), bands.shape[1] + 1), -1, np.int64)
        numbers: dict[tuple, int] = {}
        for row, at in zip(unit_of, pdf["at"], strict=True):
            for place in at:
                row[place["band"] + 1] = numbers.setdefault((place["band"], place["unit"]), len(numbers))
        equal = bands[a] == bands[b]
        cluster = pdf["cluster"].to_numpy()
        place = np.where(cluster[a] == cluster[b], 0, np.where(equal.any(axis=1), equal.argmax(axis=1) + 1, -1)) if len(a) else np.zeros(0, np.int64)
        here = (place >= 0) & (unit_of[a, place] == unit_of[b, place]) & (unit_of[a, place] >= 0)
        a, b = a[here], b[here]
        copies = pdf["copies"].to_numpy()
        n = np.bincount(a, copies[b], len(pdf))
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            n += np.bincount(b, copies[a], len(pdf))
        root = _roots(len(pdf), a, b)
        keys = pdf["set_key"].to_numpy()
        alone = (n == 0) & (root == np.arange(len(pdf)))
        return pd.DataFrame({"set_key": keys, "n_links": n.astype(np.int64), "root": np.where(alone, None, keys[root])})

    heads = members.select("set_key", "copies", "bands")
    return tasks.join(heads, "set_key").join(grams, "set_key").groupBy("task", "i", "j").applyInPandas(compare, "set_key binary, n_links bigint, root binary")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of docs: class_id is the smallest doc_id that chains of links lead to.

    A row without words is a class of its own; a class in which every id is null has a null class_id."""
    rows, sets = links(docs, threshold)
    sets = materialize(sets)
    ids = materialize(sets.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n_sets")))
    of = materialize(join_counted(sets, ids, "root", "n_sets", sets.count()).select("set_key", "class_id", "n_links", "copies"))
    named = join_counted(rows.where("set_key is not null"), of, "set_key", "copies", rows.count()).select("doc_id", "class_id", F.col("n_links").cast("bigint").alias("n_links"))
    return named.unionByName(rows.where("set_key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that with the smallest doc_id (null last), of equal ids that with the smallest
    text hash, and one of equal rows. Rows without words stay."""
    rows, sets = links(docs, threshold)
    sets = materialize(sets.select("set_key", "root", "copies"))
    named = join_counted(rows.where("set_key is not null"), sets, "set_key", "copies", rows.count())
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    named = materialize(named.groupBy("root", "doc_id", "text_hash").count())
    first = materialize(named.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("k")))
    marks = join_counted(named, first, "root", "k", named.count()).where("k > 1 or count > 1").select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), (order == F.col("first")).alias("stays"), F.col("count").alias("times")
    )
    marks = materialize(marks)
    h, d, stays, times, other = (fresh(f"lx_{x}", docs) for x in ("hash", "id", "stays", "times", "other"))
    marks = marks.select(F.col("d").alias(d), F.col("h").alias(other), F.col("stays").alias(stays), F.col("times").alias(times))
    hashed = docs.withColumn(h, F.xxhash64(F.col("text")))
    gone = marks.where(~F.col(stays) | (F.col(times) > 1))
    maybe, clear = sieve(hashed, F.xxhash64("doc_id", h), gone.select(F.xxhash64(d, other).alias("key")))

    def against(which: DataFrame, how: str) -> DataFrame:
        return maybe.join(which, maybe["doc_id"].eqNullSafe(which[d]) & (maybe[h] == which[other]), how)

    out = clear.unionByName(against(gone, "left_anti"))
    repeated = marks.where(F.col(stays) & (F.col(times) > 1))
    if not repeated.isEmpty():
        out = out.unionByName(against(repeated, "left_semi").dropDuplicates(["doc_id", h]))
    return out.drop(h)
