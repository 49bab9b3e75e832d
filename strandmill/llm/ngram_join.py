"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, cut by size-derived bounds.

Two sets of a and b n-grams with Jaccard of at least t differ in few n-grams, a number that follows from a. Cut the
n-gram space into two more column blocks than that: at least two blocks of the pair's incidence rows are then equal.
So one equal block picks the pairs whose product is worth accumulating, and a passage that many documents share picks
none unless whole blocks agree. The product itself runs over row blocks of such documents, adds up overlaps column
block by column block, and drops pairs that cannot reach the overlap which their sizes ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandmill.llm.common import arrow_rows, components, join_hot, materialize, running_sum, slices, tidy

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams; a shorter text is one sequence, an empty one none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    with np.errstate(over="ignore"):
        run = np.full(len(words) - width + 1, np.uint64(width) * MIX)
        for k in range(width):
            run = mixed(run * np.uint64(3) + hashes[k:len(words) - width + 1 + k])
    return np.unique(run)


class Bounds:
    """Size classes of sets and the column blocks of each, for Jaccard of at least percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:  # a set's partner is in its own class or a neighbouring one
            edges.append(100 * edges[-1] // percent + 1)
        self.edges = np.array(edges)
        #: a set of a n-grams differs from a larger partner by at most (100 - percent) * a / percent
        self.apart = (100 - percent) * (self.edges[1:] - 1) // percent
        #: below 90 % blocks hold so few n-grams that empty and single ones link strangers: more blocks let these go
        self.spare = self.apart // 5 + 2 if percent < 90 else 0 * self.apart

    def schemes(self, size: int) -> list[tuple[int, int]]:
        """(class, blocks) under which a set shows its blocks: as the smaller and as the larger of a pair."""
        own = int(np.searchsorted(self.edges, size, "right")) - 1
        return [(c, int(self.apart[c] + self.spare[c]) + 2) for c in (own, own - 1) if c >= 0 and self.apart[c] > 0]

    def blocks(self, grams: np.ndarray) -> np.ndarray:
        """Hashes of a set's column blocks. Equal ones need not be of equal blocks; equal blocks have equal ones.

        An empty block says little, so it counts only together with another empty one: of two equal blocks of a pair
        one has an n-gram, or both are empty. With spare blocks a set that has more full ones than its pairs can
        differ in, say k, shows only the k + 1 fullest: in one order of all blocks, the first k + 1 of either of two
        linked sets hold an equal one of the other's, which is among the other's first if that leaves blocks out too.
        """
        out = []
        spread = mixed(grams ^ MIX)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))
            for c, n in self.schemes(len(grams)):
                cuts = np.concatenate(([0], np.searchsorted(grams, (np.arange(1, n) * (2**64 / n)).astype(np.uint64)), [len(grams)]))
                full = np.diff(cuts) > 0
                tag = np.uint64(c) * np.uint64(1 << 32) + np.arange(n, dtype=np.uint64)
                hashes = mixed((sums[cuts[1:]] - sums[cuts[:-1]]) + mixed(tag))[full]
                k = min(int(self.apart[c]), (100 - self.percent) * len(grams) // self.percent)
                if self.spare[c] and len(hashes) > k:
                    out.append(hashes[np.lexsort((hashes, -np.diff(cuts)[full]))[:k + 1]])
                    continue
                out.append(hashes)
                empty = tag[~full]
                if len(empty) > 1:
                    i, j = np.triu_indices(len(empty), 1)
                    out.append(mixed(mixed(empty[i]) * np.uint64(3) + empty[j]))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


PROFILE = "struct<n:bigint,h1:bigint,h2:bigint,blocks:array<bigint>>"


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def profiles(column, size: int, percent: int):
    """Set size, two hashes of the set and its column blocks, for each text."""
    @arrow_udf(PROFILE)
    def profile(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bounds = Bounds(percent)
        for batch in slices(batches):
            n, h1, h2, blocks = [], [], [], []
            for x in batch:
                grams = ngrams(x.as_py(), size)
                n.append(len(grams))
                with np.errstate(over="ignore"):
                    h1.append(int(np.sum(mixed(grams ^ MIX), dtype=np.uint64).view(np.int64)))
                    h2.append(int(np.sum(mixed(grams + np.uint64(0x51ED270B)), dtype=np.uint64).view(np.int64)))
                blocks.append(bounds.blocks(grams))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists(blocks)], names=["n", "h1", "h2", "blocks"])

    return profile(column)


def sets(column, size: int):
    @arrow_udf("array<bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            yield lists([ngrams(x.as_py(), size) for x in batch])

    return of(column)


def linked(rows: list[np.ndarray], others: list[np.ndarray] | None, percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """Links within ``rows``, or between ``rows`` and ``others``: the incidence product, column block by column block.

    Only pairs whose sizes allow a link are looked at; after each block those that cannot reach their bound any more
    are discarded, and the rest of the columns is skipped once none is left. ``others`` are counted on from ``rows``.
    """
    every = rows + (others or [])
    if len(every) == 2:  # most groups are one pair
        shared = len(np.intersect1d(*every, assume_unique=True))
        return [(0, 1)] if 100 * shared >= percent * (len(every[0]) + len(every[1]) - shared) else []
    lengths = np.array([len(x) for x in every])
    flat, owner = np.concatenate(every), np.repeat(np.arange(len(every)), lengths)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    column, owner = rank[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    half = len(rows) if others is not None else 0
    a, b = lengths[:, None], lengths[None, :]
    need = -(-percent * (a + b) // (100 + percent))
    alive = np.minimum(a, b) >= need
    alive &= (np.arange(len(every))[:, None] < half) & (np.arange(len(every))[None, :] >= half) if half else np.triu(np.ones_like(alive), 1)
    overlap = np.zeros(alive.shape, np.float32)
    left = np.bincount(owner, minlength=len(every))
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, columns):
        lo, hi = np.searchsorted(column, (start, start + columns))
        block = np.zeros((len(every), min(columns, width - start)), np.float32)
        block[owner[lo:hi], column[lo:hi] - start] = 1
        overlap += block @ block.T
        left = left - np.bincount(owner[lo:hi], minlength=len(every))
        alive &= overlap + np.minimum(left[:, None], left[None, :]) >= need
        if not alive.any():
            return []
    i, j = np.nonzero(alive & (overlap >= need))
    return list(zip(i.tolist(), j.tolist()))


def spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A forest that joins what ``pairs`` join."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs:
        if (x := find(a)) != (y := find(b)):
            root[x] = y
            out.append((a, b))
    return out


def product_links(percent: int):
    """Streams rows (group, left, right, side, node, grams) sorted by group and gives each group's spanning links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links():
            first = [x for x in held if x[0] == 0]
            second = [x for x in held if x[0] == 1]
            nodes = [x[1] for x in first + second]
            return [(nodes[i], nodes[j]) for i, j in spanning(linked([x[2] for x in first], [x[2] for x in second] or None, percent))] if len(nodes) > 1 else []

        for batch in batches:
            found = []
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            sides, nodes, grams = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
            ends, values = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
            for i, group in enumerate(groups):
                if group != key:
                    found += links()
                    key, held = group, []
                held.append((sides[i], nodes[i], values[ends[i]:ends[i + 1]].copy()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        found = links()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def identities(docs: DataFrame, key: str, text: str) -> tuple[Column, Column, bool]:
    """The number of a row, whether it is its key, and whether that holds for all rows: rows without a key have a number by
    their text, which is no row's key.

    Where keys are missing, the numbers are held against all keys, and salted anew until none is a key.
    """
    own, salt = F.col(key).cast("long"), 0
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    if docs.where(own.isNull()).limit(1).count():
        keys = docs.where(own.isNotNull()).select(own.alias("id"))
        while docs.where(own.isNull()).select(F.xxhash64(content, F.lit(salt)).alias("id")).join(keys, "id", "left_semi").limit(1).count():
            salt += 1
    else:
        return own, F.lit(True), True
    return F.coalesce(own, F.xxhash64(content, F.lit(salt))), own.isNotNull(), False


def near_labels(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90,
                block_weight: int = 600_000, broadcast_rows: int = 1_000_000, batch_rows: int = 1000) -> DataFrame:
    """``(id, keyed, n, label, named)`` for every row: its number and whether that is its key, its set's size, and the
    smallest key of its component, or the smallest number, not ``named``, where no row of it has a key.

    Rows of equal sets form a class (found by partial aggregation, never listed), and one row of each class takes part
    in the join. Row blocks hold about ``block_weight`` n-grams, which bounds a task's memory however large a group is.
    Candidate groups are first held against one row each; only pairs of which one is not linked to that row are left
    for the blocks, so a group around one text costs its size, not its square. Texts are read twice: all of them for
    their blocks, candidates once more for their sets. All steps with Python are written here, in batches of ``batch_rows``.
    """
    with arrow_rows(docs.sparkSession, batch_rows):
        return joined(docs, identities(docs, key, text), text, size, percent, block_weight, broadcast_rows)


def joined(docs: DataFrame, who: tuple[Column, Column, bool], text: str, size: int, percent: int, block_weight: int, broadcast_rows: int) -> DataFrame:
    """The steps of ``near_labels`` for rows with the numbers of :func:`identities`."""
    number, keyed, whole_keys = who
    base = docs.select(number.alias("id"), keyed.alias("keyed"), F.col(text).cast("string").alias("text"))
    of_set = ["n", "h1", "h2"]
    seen = materialize(base.withColumn("p", profiles(F.col("text"), size, percent)).select("id", "keyed", "p.*"), "ngram-profiles")
    classes = materialize(seen.where("n > 0").groupBy(*of_set).agg(F.min("id").alias("node"), F.count("*").alias("c")), "ngram-classes")

    # 1. column blocks: classes that share one are joined to the smallest of those that do. Block lists are as large as
    # texts, so rows find out where they lie whether they stand for their class; only pairs (row, block) are shuffled, once
    repeated = classes.where("c > 1").select(*of_set, "node")
    few = repeated.count() <= broadcast_rows
    shaped = seen.where(F.size("blocks") > 0).join(F.broadcast(repeated) if few else repeated, of_set, "left").where("node is null or node = id").select(F.col("id").alias("node"), "blocks")
    if not few:
        shaped = materialize(shaped, "ngram-shaped")
    shown = shaped.select("node", F.explode("blocks").alias("block"))
    # the few blocks that very many rows show are found by a sketch and joined where they lie, so that no task gets one whole
    hot = list(shown.freqItems(["block"], 0.0005).first()[0] or ())  # all with a 2,000th of the pairs, 2,000 at most
    everywhere = shown.where(F.col("block").isin(hot))
    hubs = everywhere.groupBy("block").agg(F.min("node").alias("hub"), F.count("*").alias("c"))  # a row for each hot block
    of_block = Window.partitionBy("block")
    drawn = shown.where(~F.col("block").isin(hot)).select("node", F.min("node").over(of_block).alias("hub"), F.count("*").over(of_block).alias("c")).where("c > 1")
    drawn = drawn.union(everywhere.join(F.broadcast(hubs), "block").select("node", "hub", "c"))
    met = materialize(drawn.groupBy("node", "hub").agg(F.sum("c").alias("met")), "ngram-met")
    tidy(docs.sparkSession)
    seen = materialize(seen.select("id", "keyed", *of_set), "ngram-keys", seen)  # the blocks are not needed any more
    groups = components(met.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")), "ngram-candidates")

    # 2. the sets of candidates only: their rows are found by key, broadcast while they are few
    weight = F.col("most") + 2000
    sized = materialize(groups.join(classes.groupBy("node").agg(F.min("n").alias("least"), F.max("n").alias("most")), "node")
                        .join(met.groupBy("node").agg(F.sum("met").alias("met")), "node", "left"), "ngram-sized")
    wanted = sized.select(F.col("node").alias("id"))
    candidates = sized.count()
    if candidates <= broadcast_rows:
        wanted = F.broadcast(wanted)
    filled = materialize(base.join(wanted, "id").select(F.col("id").alias("node"), sets(F.col("text"), size).alias("grams"))
                         .where(F.size("grams") > 0).withColumn("same", F.xxhash64("grams")).dropDuplicates(["node", "same"]).drop("same"), "ngram-sets")

    def products(seats: DataFrame) -> DataFrame:
        """Links of the block pairs (component, l, r) that ``seats(node, component, l, r, side)`` fills."""
        work = filled.join(seats, "node").select("component", "l", "r", "side", "node", "grams")
        return work.repartition("component", "l", "r").sortWithinPartitions("component", "l", "r", "side", "node").mapInArrow(product_links(percent), "a long, b long")

    # 3. all of a group against its row that met the most others, in parts; what it links needs no comparison with each other
    whole = sized.groupBy("component").agg(F.max_by("node", F.struct("met", "node")).alias("head"), F.ceil(F.sum(weight) / F.lit(block_weight)).alias("parts"))
    dealt = join_hot(sized.select("node", "component"), whole.join(sized.groupBy("component").agg(F.count("*").alias("c")), "component"), "component", "c", candidates).withColumn("l", F.pmod(F.xxhash64("node"), F.col("parts")))
    seats = dealt.where("node <> head").select("node", "component", "l", F.lit(-1).alias("r"), F.lit(0).alias("side")).union(
        whole.select(F.col("head").alias("node"), "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("l"), F.lit(-1), F.lit(1)))
    near = materialize(products(seats), "ngram-heads")
    linked = near.select("a", "b").join(whole.select(F.col("head").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).union(whole.select(F.col("head").alias("node"))).distinct()
    marked = sized.join(linked.withColumn("_l", F.lit(True)), "node", "left").withColumn("close", F.coalesce("_l", F.lit(False))).drop("_l")
    left = marked.groupBy("component").agg(F.count_if(~F.col("close")).alias("left"), F.count("*").alias("c")).where("left > 0").drop("left")

    # 4. row blocks of the groups that have rows left, by size, and the block pairs whose sizes allow links
    placed = materialize(running_sum(join_hot(marked, left, "component", "c", candidates), ["component", "close"], ["most", "node"], weight, "upto", "ngram-order").withColumn("part", F.floor(F.col("upto") / F.lit(block_weight))), "ngram-placed")
    spans = placed.groupBy("component", "close", "part").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    x, y = spans.where("not close").alias("x"), spans.alias("y")
    two = x.join(y, F.expr(f"x.component = y.component and (y.close or x.part <= y.part) and x.most * 100 >= y.least * {percent} and (not y.close or y.most * 100 >= x.least * {percent})"))
    pairs = two.select(F.col("x.component").alias("component"), F.col("x.part").alias("l"), F.when(F.col("y.close"), -2 - F.col("y.part")).otherwise(F.col("y.part")).alias("r"))
    block = F.when(F.col("close"), -2 - F.col("part")).otherwise(F.col("part"))
    sides = pairs.select("component", "l", "r", F.col("l").alias("block"), F.lit(0).alias("side")).union(
        pairs.where("l <> r").select("component", "l", "r", F.col("r").alias("block"), F.lit(1).alias("side")))
    rest = products(placed.withColumn("block", block).join(sides, ["component", "block"]).select("node", "component", "l", "r", "side"))
    found = components(near.union(rest), "ngram-links").withColumnRenamed("component", "label")

    # 5. every row's component by its class; most classes are one row without links
    known = classes.join(found, "node", "left").where("label is not null or c > 1").select(*of_set, F.coalesce("label", "node").alias("label"))
    labelled = seen.join(known, of_set, "left").select("id", "keyed", "n", F.coalesce("label", "id").alias("label"))
    if whole_keys:
        return labelled.withColumn("named", F.lit(True))
    # 6. components with rows that have no key are named by their smallest key
    labelled = materialize(labelled, "ngram-labelled")
    least = labelled.groupBy("label").agg(F.min(F.when(F.col("keyed"), F.col("id"))).alias("least"), F.count_if(~F.col("keyed")).alias("without")).where("without > 0")
    least = materialize(least.select("label", "least", F.lit(True).alias("partly")), "ngram-least")
    renamed = labelled.join(F.broadcast(least) if least.count() <= broadcast_rows else least, "label", "left")
    return renamed.select("id", "keyed", "n", F.coalesce("least", "label").alias("label"), (F.col("partly").isNull() | F.col("least").isNotNull()).alias("named"))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90, **limits) -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row: components of the links Jaccard >= percent / 100.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct ``size``-word n-grams, or the
    whole sequence of fewer words. Null or empty texts have size 0 and stand alone. ``component_id`` is the smallest
    key of the component; rows that share a key are one document and share it. A row with a null key is linked like
    any other, shown with a null key, and has a null component unless a keyed row is in it. An empty table gives an
    empty one; other columns of ``docs`` don't matter.
    """
    return near_labels(docs, key, text, size, percent, **limits).select(
        F.when(F.col("keyed"), F.col("id")).alias(key), F.col("n").alias("n_shingles"), F.when(F.col("named"), F.col("label")).alias("component_id"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90,
                     block_weight: int = 600_000, broadcast_rows: int = 1_000_000, batch_rows: int = 1000) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key, or of the smallest text hash if none has one.

    Only the identities to drop, and those that several rows bear, are joined with the rows; both are broadcast while
    they are few. Columns of any name pass.
    """
    who = identities(docs, key, text)
    with arrow_rows(docs.sparkSession, batch_rows):
        labels = materialize(joined(docs, who, text, size, percent, block_weight, broadcast_rows).select("id", "label"), "ngram-labels")
    counted = labels.groupBy("id").agg(F.min("label").alias("label"), F.count("*").alias("rows"))
    marked = materialize(counted.where("id <> label or rows > 1").select("id", (F.col("id") != F.col("label")).alias("drop")), "ngram-marked")
    if marked.count() <= broadcast_rows:
        marked = F.broadcast(marked)
    tidy(docs.sparkSession)
    rows = docs.select(who[0].alias("id"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).join(marked, "id", "left")
    alone = rows.where("drop is null").select("row.*")
    return alone.union(rows.where("not drop").dropDuplicates(["id"]).select("row.*"))


def op4_ngram_jaccard_join(spark, sf_dir):
    from strandmill.llm.common import table

    return near_components(table(spark, sf_dir, "documents"))


def oracle_sql(percent: int = 90) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] END AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= {percent} * (x.n + y.n - o.o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""
