"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Documents with one set of word n-grams form a class, and classes are joined. A
class posts its prefix: the n-grams of its set that are rarest first, as many as two
similar sets must share at least one of. Rarity comes from counts of all documents'
n-grams in a table of 2**SKETCH_BITS cells, whose size doesn't depend on the data;
any order gives right results, a good one short posting lists.

Posting lists are never expanded into all pairs. In the first rounds every class meets
one class, the first of most of its lists in its length band. Components of the links
found so are labelled on the postings, and only classes of one list whose components
differ go on: more links inside a component couldn't change it. In the last round all
pairs that are left of such lists meet, if they pass the length, positional and suffix
filters (the last bounds what two sets can share by their sizes in hash ranges). Pairs
are made distinct and verified on the whole sets.

Words are runs without white space, with A-Z lower-cased. Defined cases: null and
empty texts have an empty set and are linked with nothing; a text of fewer words than
n has its whole word sequence as its one n-gram; repeated rows are linked; an empty
table gives no rows; other columns are ignored by ``classes_of`` and kept by
``keep_one``. n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fresh, materialise, release
from .components import components
from .kernel import Words, slices
from .repeats import pack, unpack

NGRAM, PERCENT, SKETCH_BITS, CHUNKS, SALT_ROWS, ROUNDS, BINS = 5, 75, 21, 64, 2000, 3, 64
_CELLS = (1 << SKETCH_BITS) // CHUNKS


def _sets(part: pa.RecordBatch, column: str, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words = Words(part.column(column), lower=True)
    grams = words.windows(n)
    for r, size in enumerate(words.counts()):
        if size >= n:
            yield np.unique(grams[words.first[r] : words.first[r + 1] - n + 1])
        elif size:
            own = words.hashes[words.first[r] : words.first[r + 1]]
            yield np.array([xxhash.xxh3_64_intdigest(own.tobytes(), seed=n)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _bins(own: np.ndarray) -> np.ndarray:
    return np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=BINS)


def _keys(own: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n, k1, k2 (the set's digest), bins (its sizes by hash range), and each
    task's counts by cell."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, size = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        names = ["doc_id", "n", "k1", "k2", "bins", "chunk", "counts"]
        for batch in batches:
            for part in slices(batch, "text"):
                rows, grams = [], []
                for own in _sets(part, "text", n):
                    rows.append((len(own), *_keys(own)))
                    grams.append(own)
                waiting += grams
                size += sum(map(len, grams))
                if size > len(counts):
                    counts += np.bincount(_cells(np.concatenate(waiting)), minlength=len(counts))
                    waiting, size = [], 0
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                flat = np.concatenate([_bins(own) for own in grams]).astype(np.int32)
                bins = pa.ListArray.from_arrays(pa.array(np.arange(len(grams) + 1, dtype=np.int32) * BINS), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, bins, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names)
        if waiting:
            counts += np.bincount(_cells(np.concatenate(waiting)), minlength=len(counts))
        if counts.any():
            none = pa.nulls(CHUNKS, pa.int64())
            blobs = pa.array([pack(c) for c in counts.reshape(CHUNKS, _CELLS)], pa.binary())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(CHUNKS, pa.list_(pa.int32())), pa.array(range(CHUNKS), pa.int32()), blobs], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(task, "doc_id long, n long, k1 long, k2 long, bins array<int>, chunk int, counts binary")


def _sketch(scanned: DataFrame) -> np.ndarray:
    """Counts by cell over all documents; 2**SKETCH_BITS numbers (the largest where one is larger)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + unpack(blob, np.int64)[0]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(s) for s in sums.values()], pa.binary())], ["chunk", "counts"])

    parts = scanned.filter("chunk is not null").select("chunk", "counts")
    once = parts.mapInArrow(add, "chunk int, counts binary")
    out = np.zeros((CHUNKS, _CELLS), np.int64)
    for r in once.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[r.chunk] += unpack(r.counts, np.int64)[0]
    return np.minimum(out.reshape(-1), np.iinfo(np.uint32).max).astype(np.uint32)


def _postings(docs: DataFrame, n: int, percent: int, sketch) -> DataFrame:
    """gram, k1, n, pos of every class's prefix; a class once per task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = sketch.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for own in _sets(part, "text", n):
                    key = _keys(own)
                    if len(own) and key not in seen:
                        seen.add(key)
                        head = len(own) - -(-percent * len(own) // 100) + 1
                        order = np.lexsort((own, cells[_cells(own)]))[:head]
                        out.append((own[order], np.full(head, key[0]), np.full(head, len(own)), np.arange(head)))
                if out:
                    gram, k1, size, pos = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram.view(np.int64)), pa.array(k1), pa.array(size.astype(np.int32)), pa.array(pos.astype(np.int32))],
                        ["gram", "k1", "n", "pos"],
                    )

    return docs.select(F.col("text").cast("string")).mapInArrow(task, "gram long, k1 long, n int, pos int")


def _may_link(na: str, pa_: str, nb: str, pb: str, percent: int) -> str:
    """Length and positional filter for sets of na and nb with a common n-gram at pa_ and pb."""
    need = f"{percent} * ({na} + {nb})"
    return (
        f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) and "
        f"{100 + percent} * least({na} - {pa_}, {nb} - {pb}) >= {need}"
    )


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: representatives' doc_ids of the pairs (pivot, k1) that are similar.
    A pivot's set is held while its members stream by; large groups are salted."""
    wanted = pairs.select(F.col("pivot").alias("k1")).union(pairs.select("k1")).distinct()
    reps = classes.join(wanted, "k1").select(F.col("rep").alias("doc_id"), "k1").distinct()
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(reps, "doc_id")
    text = materialise(text, "jaccard-text")
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    members = pairs.join(salts, "pivot").join(text, "k1").select(
        "pivot", F.pmod(F.xxhash64("k1"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "text"
    )
    heads = salts.join(text.withColumnRenamed("k1", "pivot"), "pivot").select(
        "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "doc_id", "text"
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                found = []
                cols = (part.column(c).to_pylist() for c in ("pivot", "salt", "kind", "doc_id"))
                for pivot, salt, kind, doc, own in zip(*cols, _sets(part, "text", n), strict=True):
                    if (pivot, salt) != now:
                        now, held = (pivot, salt), []
                    spread = _bins(own)
                    if kind == 0:
                        held.append((doc, own, spread))
                        continue
                    for other, theirs, spread_b in held:
                        total = len(own) + len(theirs)
                        if doc == other or (100 + percent) * int(np.minimum(spread, spread_b).sum()) < percent * total:
                            continue  # suffix filter: at most so many can be common
                        both = len(np.intersect1d(own, theirs, assume_unique=True))
                        if (100 + percent) * both >= percent * total:
                            found.append((other, doc))
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = heads.unionByName(members).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "kind")
    return rows.mapInArrow(task, "a long, b long")


def classes_of(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (smallest doc_id with the same set), per row."""
    spark = docs.sparkSession
    scanned = materialise(_scan(docs, n), "jaccard-scan")
    own = scanned.filter("chunk is null")
    classes = materialise(own.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    sketch = spark.sparkContext.broadcast(_sketch(scanned))

    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    inlist = Window.partitionBy("gram").orderBy("n", "k1")
    lists = _postings(docs, n, percent, sketch).withColumns({"before": F.lag("k1").over(inlist), "after": F.lead("k1").over(inlist)})
    lists = lists.filter("(before is not null or after is not null) and (before is null or before <> k1)")
    lists = materialise(lists.select("gram", "k1", "n", "pos"), "jaccard-lists")
    sketch.destroy()
    release(spark)

    tried = materialise(spark.createDataFrame([], "pivot long, k1 long"), "jaccard-tried")
    labels = spark.createDataFrame([], "node long, component long")
    for turn in range(ROUNDS + 1):
        # lists whose classes are in different components
        owner = classes.join(labels, F.col("rep") == F.col("node"), "left").select("k1", F.coalesce("component", "rep").alias("part"))
        placed = lists.join(owner, "k1")
        mixed = placed.groupBy("gram").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("gram")
        smaller = materialise(placed.join(mixed, "gram"), "jaccard-mixed")
        discard(lists)
        lists = smaller.select("gram", "k1", "n", "pos")
        lists.scratch = smaller.scratch
        if turn < ROUNDS:  # each class meets one first class of its lists, that of most of them
            # first that with most postings, which has least of its own; later any
            weight = F.col("postings") if turn == 0 else F.xxhash64("k1", F.lit(turn))
            postings = smaller.groupBy("k1").agg(F.count("*").alias("postings"))
            inband = Window.partitionBy("gram", "band").orderBy(F.desc("weight"), "k1")
            head = F.first(F.struct("k1", "n", "pos", "part")).over(inband).alias("head")
            rows = smaller.join(postings, "k1").withColumns({"band": band, "weight": weight}).select("k1", "n", "pos", "part", head)
            rows = rows.filter("head.part <> part and " + _may_link("n", "pos", "head.n", "head.pos", percent))
            votes = rows.groupBy(F.col("head.k1").alias("pivot"), "k1").agg(F.count("*").alias("votes"))
            votes = votes.join(tried, ["pivot", "k1"], "left_anti")
            pairs = votes.groupBy("k1").agg(F.max_by("pivot", F.struct("votes", "pivot")).alias("pivot")).select("pivot", "k1")
        else:  # what is left: all pairs of one list and different components
            bins = own.join(smaller.select("k1").distinct(), "k1").groupBy("k1").agg(F.first("bins").alias("bins"))
            sized = smaller.join(bins, "k1")
            a, b = (sized.select("gram", *[F.col(c).alias(c + x) for c in ("k1", "n", "pos", "part", "bins")]) for x in "ab")
            most = "aggregate(zip_with(binsa, binsb, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"
            suffix = f"{100 + percent} * {most} >= {percent} * (na + nb)"
            rows = a.join(b, "gram").filter(f"k1a < k1b and parta <> partb and {_may_link('na', 'posa', 'nb', 'posb', percent)} and {suffix}")
            pairs = rows.select(F.col("k1a").alias("pivot"), F.col("k1b").alias("k1")).distinct().join(tried, ["pivot", "k1"], "left_anti")
        pairs = materialise(pairs, "jaccard-pairs")
        links = materialise(_verify(docs, classes, pairs, n, percent), "jaccard-links")
        labels = materialise(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "jaccard-labels")
        tried = tried.unionByName(pairs).unionByName(pairs.select(F.col("k1").alias("pivot"), F.col("pivot").alias("k1")))
        release(spark)
    discard(lists)

    out = own.join(classes, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"))
    out = out.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id")


def keep_one(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row of each group of similar ones, with its own columns: that with the smallest
    doc_id, null ids last. Rows are known by id and text; of equal rows one stays, but rows
    with an empty set are linked with nothing and all stay."""
    (key,) = fresh(docs, "row_key")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.withColumn(key, row)
    found = classes_of(keyed.select(F.col(key).alias("doc_id"), F.col("text")), n, percent)
    found = materialise(found.groupBy(F.col("doc_id").alias(key), "n_shingles", "component_id").agg(F.count("*").alias("copies")), "jaccard-rows")
    ids = keyed.select(key, F.col("doc_id").cast("long").alias("id")).distinct()
    best = found.filter("n_shingles > 0").join(ids, key).groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", key))[key].alias(key))
    best = materialise(best.join(found.select(key, "copies"), key).select(key, "copies"), "jaccard-kept")
    single = best.filter("copies = 1").select(key).unionByName(found.filter("n_shingles = 0").select(key))
    repeated = keyed.join(best.filter("copies > 1"), key, "left_semi").dropDuplicates([key])
    return keyed.join(single, key, "left_semi").unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
