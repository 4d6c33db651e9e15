"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

DartMinHash: every element owns a plane of (weight, rank) on which darts are thrown by hash, one per unit
of area on average and the same for every document. A document sees the darts below its element's weight
and below a rank limit chosen so that about k ln k + 2k are seen; each dart belongs to one of k
coordinates, and a coordinate keeps its earliest dart. Two signatures agree in a coordinate with the
probability of the weighted Jaccard similarity. A coordinate left empty doubles the limit.

Joining: texts with equal words are one node from the start. Nodes that share a band meet in a bucket; buckets
of the same nodes are one. Instead of all pairs of a bucket, its members are compared with one centre, the
node with the most bucket mates, which in a group of copies links nearly all of them. Passes go on over buckets
that still hold several components, with the next centre among those that no earlier one is linked to.

What is left then, nodes that share a bucket but no component, is joined exactly: shingles are put in order of
their frequency among those nodes, and two nodes of the wanted similarity share one among the few rarest
of each. How few depends on both sizes, so nodes meet by size classes. A crowd of texts that share a long
passage and are less similar than wanted have enough shingles of their own to make no pair at all.

Every candidate is verified on the shingle sets, which are taken once from the texts of the nodes that have
bucket mates. Nodes are numbered by the hash of their words; keys come in again at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.frames import long_hash, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
# Signatures of a pair with the wanted similarity agree in fewer coordinates than this many standard
# deviations below the mean once in ten million pairs.
DEVIATIONS = 5.2
# Passes over centres end when less than this share of what they compare is linked; the rest is exact.
LEAST_LINKED = 1 / 64
# Ratio of the sizes at the ends of a size class of the exact join.
CLASS_RATIO = 1.03
BLOCK_ELEMENTS = 1 << 18
FRACTION_BITS, RANK_BITS = 36, 48
SEED = 0x9E3779B97F4A7C15
_CDF = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that mixes them well (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, … for each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _darts(
    elements: np.ndarray, weights: np.ndarray, documents: np.ndarray, limits: np.ndarray, k: int
) -> np.ndarray:
    """(document, coordinate, rank) of all darts seen, packed in one number each.

    The plane is cut into cells of area 1: level 0 has weights 0 to 1 and ranks by steps of 1, level n
    weights 2^(n-1) to 2^n and ranks by steps of 2^(1-n).
    """
    found = []
    levels = int(np.ceil(np.log2(weights.max()))) + 1 if len(weights) else 0
    for level in range(levels):
        low, high = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0**level)
        step = 1.0 / (high - low)
        own = np.flatnonzero(weights > low)
        cells = np.ceil(limits[documents[own]] / step).astype(np.int64)
        at, cell = np.repeat(own, cells), _within(cells)
        tag = scramble(np.uint64(level) + np.uint64(SEED)) + cell.astype(np.uint64)
        drawn = scramble(elements[at] ^ scramble(tag))
        counts = np.searchsorted(_CDF, (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
        counts = np.minimum(counts, len(_CDF) - 1)
        of, number = np.repeat(np.arange(len(at)), counts), _within(counts)
        dart = scramble(drawn[of] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(SEED))
        at, cell = at[of], cell[of]
        rank = ((cell + (dart >> np.uint64(28)).astype(np.float64) * 2.0**-36) * step * 2.0**FRACTION_BITS).astype(np.uint64)
        seen = rank <= (limits[documents[at]] * 2.0**FRACTION_BITS).astype(np.uint64)
        partly = weights[at] < high
        if partly.any():
            weight = low + (scramble(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * (high - low)
            seen &= ~partly | (weight <= weights[at])
        at, rank, dart = at[seen], rank[seen], dart[seen]
        coordinate = scramble(dart ^ np.uint64(0xC3C3C3C3C3C3C3C3)) % np.uint64(k)
        place = documents[at].astype(np.uint64) * np.uint64(k) + coordinate
        found.append((place << np.uint64(RANK_BITS)) | rank)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """One row of k darts (their ranks) per document. `elements` are 64-bit hashes, document after
    document, `weights` at least 1, `sizes` the number of elements of each document, at least 1."""
    with np.errstate(over="ignore"):
        elements = scramble(elements.astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    norms = np.bincount(owner, weights=weights, minlength=len(sizes))
    out = np.zeros((len(sizes), k), np.uint64)
    todo, throws = np.arange(len(sizes)), k * math.log(k) + 2 * k
    while len(todo):
        number = np.full(len(sizes), -1)
        number[todo] = np.arange(len(todo))
        chosen = number[owner] >= 0
        packed = np.sort(_darts(elements[chosen], weights[chosen], number[owner[chosen]], throws / norms[todo], k))
        places = packed >> np.uint64(RANK_BITS)
        first = np.ones(len(packed), bool)
        first[1:] = places[1:] != places[:-1]
        table = np.zeros(len(todo) * k, np.uint64)
        table[places[first].astype(np.int64)] = (packed[first] & np.uint64((1 << RANK_BITS) - 1)) + np.uint64(1)
        table = table.reshape(len(todo), k)
        full = (table > 0).all(axis=1)
        out[todo[full]] = table[full]
        todo, throws = todo[~full], throws * 2
    return out


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(table), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(table), scramble(np.array([band + 1], np.uint64))[0])
        for row in range(rows):
            key = scramble(key ^ table[:, band * rows + row])
        keys[:, band] = key
    return keys.view(np.int64)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of the distinct shingles; fewer words than a shingle are one shingle, no words are none."""
    last = F.greatest(F.lit(1), F.size(words) - (size - 1))
    return F.when(
        F.size(words) > 0,
        F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, size)))),
    ).otherwise(F.array().cast("array<bigint>"))


def signed(docs: DataFrame, key: str, text: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """`key`, `raw` (hash of the text), `h1`, `h2` (of the words), `signature`, `bands` of every text with a word."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            start = 0
            while start < len(sizes):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + BLOCK_ELEMENTS, side="right")) - 1)
                stop = min(stop, start + (1 << 15) // k)  # so that document and coordinate fit beside the rank
                chunk = values[ends[start] : ends[stop]]
                table = signatures(chunk, np.ones(len(chunk)), sizes[start:stop], k)
                short = (scramble(table) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                part = batch.slice(start, stop - start)
                offsets = np.arange(stop - start + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:4],
                        pa.ListArray.from_arrays(offsets * k, short.ravel()),
                        pa.ListArray.from_arrays(offsets * bands, band_keys(table, bands, rows).ravel()),
                    ],
                    names=["key", "raw", "h1", "h2", "signature", "bands"],
                )
                start = stop

    words = docs.where(F.col(text).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), long_hash(F.col(text)).alias("raw"), words_of(F.col(text)).alias("words")
    )
    shingles = words.where(F.size("words") > 0).select(
        "key", "raw", long_hash("words", salt=1).alias("h1"), long_hash("words", salt=2).alias("h2"),
        shingle_hashes(F.col("words")).alias("shingles"),
    )
    return shingles.mapInArrow(run, "key bigint, raw bigint, h1 bigint, h2 bigint, signature array<int>, bands array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """`id`, `component` (the least id) of all ids in `links` (`a`, `b`).

    Every root hooks to its least neighbour, chains of hooks are shortened, and the links are drawn
    between the new roots, until none is left; each step is written, so that a lost executor costs
    one step.
    """
    edges = written(links.select("a", "b").distinct(), "links")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        hooks = written(
            both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("root"), F.least("a", "b").alias("to")), "hooks"
        )
        while True:
            further = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            moved = written(
                hooks.join(further, "to").select("root", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")), "hooks"
            )
            hooks = moved.select("root", "to")
            if moved.where("moved").isEmpty():
                break
        renamed = hooks.select(F.col("root").alias("component"), "to")
        labels = written(
            labels.join(renamed, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels"
        )
        side_a, side_b = hooks.select(F.col("root").alias("a"), F.col("to").alias("x")), hooks.select(F.col("root").alias("b"), F.col("to").alias("y"))
        edges = written(
            edges.join(side_a, "a").join(side_b, "b").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links"
        )
    return labels


def _agreeing(left: Column, right: Column) -> Column:
    return F.size(F.filter(F.zip_with(left, right, lambda x, y: x == y), lambda same: same))


def _nodes(rowed: DataFrame) -> DataFrame:
    """One row per word sequence: `id`, the least key, the key and text hash of one of its rows, its signature.

    The id is the first hash of the words; where two sequences share it, the others take one of both hashes.
    """
    found = rowed.groupBy("h1", "h2").agg(
        F.min("key").alias("least"), F.min(F.struct("key", "raw")).alias("row"),
        F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands"),
    )
    first = F.row_number().over(Window.partitionBy("h1").orderBy("h2")) == 1
    return found.withColumn("id", F.when(first, F.col("h1")).otherwise(long_hash("h1", "h2", salt=3)))


def _members(nodes: DataFrame) -> DataFrame:
    """`bucket`, `id`, `mates` of nodes that share a band; buckets of the same nodes are one.

    `mates` counts a node's bucket mates over all bands.
    """
    mates = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = mates.groupBy("bucket").agg(
        F.count("*").alias("size"), F.bit_xor(long_hash("id", salt=1)).alias("x"), F.bit_xor(long_hash("id", salt=2)).alias("y")
    ).where("size > 1")
    kept = shared.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket"), (F.count("*") * F.col("size")).alias("weight"))
    members = written(mates.join(kept.select("bucket", "weight"), "bucket"), "members")
    popular = members.groupBy("id").agg(F.sum("weight").alias("mates"))
    return members.join(popular, "id").select("bucket", "id", "mates")


def shingle_sets(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """`id` and `shingles` of nodes (`id`, `row`). Texts are found by key and text hash and read once."""
    wanted = nodes.select("id", F.col("row.key").alias("of_key"), F.col("row.raw").alias("of_raw"))
    texts = docs.where(F.col(text).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), long_hash(F.col(text)).alias("raw"), F.col(text).alias("text")
    )
    # A part of all texts at any size: they are dealt out, but not sorted. Only what is found is split to words.
    met = texts.join(wanted.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("of_key")) & (F.col("raw") == F.col("of_raw")))
    # The work is in the words, not the bytes: as many tasks as the session shuffles with, however small the texts.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.select("id", "text").repartition(tasks, "id").groupBy("id").agg(F.any_value("text").alias("text"))
    # The words are a column of their own: within the lambda over shingles they would be split once a shingle.
    return found.select("id", words_of(F.col("text")).alias("words")).select("id", shingle_hashes(F.col("words")).alias("shingles"))


def _agreeing(left: Column, right: Column) -> Column:
    return F.size(F.filter(F.zip_with(left, right, lambda x, y: x == y), lambda same: same))


def _relabelled(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """`labels` with components renamed by `mapping` (`id`, `component`)."""
    moved = mapping.select(F.col("id").alias("component"), F.col("component").alias("to"))
    kept = [c for c in labels.columns if c != "component"]
    return labels.join(moved, "component", "left").select(*kept, F.coalesce("to", "component").alias("component"))


def rare_pairs(open_nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs `a`, `b` (with components `ca`, `cb`) of different components that may reach the similarity.

    None that does is left out. `open_nodes` has `id` and `component`. With t the similarity, sets of n and m
    need ceil(t / (1 + t) (n + m)) shingles in common, so one of those is among the first n + 1 less that
    many of the first set, by any order of shingles, and among as many of the second. Rare shingles come first.
    """
    share = similarity / (1 + similarity)
    step = math.log(CLASS_RATIO)
    reach = math.ceil(-math.log(similarity) / step) + 1
    tokens = open_nodes.join(sets, "id").select("id", "component", F.explode("shingles").alias("token"))
    per_component = tokens.groupBy("token", "component").agg(F.count("*").alias("n"))
    # Shingles of one component alone make no pair; the largest component of a shingle is not met with itself.
    frequent = per_component.groupBy("token").agg(
        F.sum("n").alias("frequency"), F.max_by("component", F.struct("n", "component")).alias("largest"),
        (F.count("*") > 1).alias("mixed"),
    )
    entry = F.struct("frequency", "token", "mixed", (F.col("component") == F.col("largest")).alias("large"))
    ordered = tokens.join(frequent, "token").groupBy("id", "component").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    ordered = ordered.withColumn("n", F.size("entries"))

    def needed(n: str, m: str) -> str:
        return f"cast(ceil({share!r}D * ({n} + {m}) - 1e-9) as int)"

    size_class, least = f"cast(floor(ln(n) / {step!r}D + 1e-9) as int)", f"cast(floor(exp(c * {step!r}D) * 0.9999) as int)"
    # Partners at least as large, by class, and how many of the first shingles can be the first in common.
    longer = (
        f"transform(sequence({size_class}, {size_class} + {reach}), c -> named_struct('low', {size_class}, 'high', c, "
        f"'first', n + 1 - {needed('n', f'greatest(n, {least})')}))"
    )
    shorter = (
        f"transform(sequence(greatest(0, {size_class} - {reach}), {size_class}), c -> named_struct('low', c, 'high', {size_class}, "
        f"'first', n + 1 - {needed('n', f'greatest({least}, cast(ceil({similarity!r}D * n - 1e-9) as int))')}))"
    )
    head = F.expr(f"slice(entries, 1, greatest(1, n + 1 - cast(ceil({similarity!r}D * n - 1e-9) as int)))")
    spread = ordered.select("id", "component", "n", F.posexplode(head).alias("place", "e")).where("e.mixed").select(
        "id", "component", "n", "place", "e.token", "e.large"
    )

    def side(classes: str, parts: str, name: str) -> DataFrame:
        met = spread.withColumn("k", F.explode(F.filter(F.expr(classes), lambda k: k["first"] > F.col("place"))))
        return met.select(
            F.col("token").alias(f"t_{name}"), F.col("k.low").alias(f"l_{name}"), F.col("k.high").alias(f"h_{name}"),
            F.explode(F.expr(parts)).alias(f"p_{name}"), F.col("id").alias(f"id_{name}"), F.col("component").alias(f"c_{name}"),
            F.col("n").alias(f"n_{name}"), F.col("place").alias(f"at_{name}"),
        )

    low, high = side(longer, "if(large, array(1), array(0))", "x"), side(shorter, "if(large, array(0), array(0, 1))", "y")
    same = (F.col("t_x") == F.col("t_y")) & (F.col("l_x") == F.col("l_y")) & (F.col("h_x") == F.col("h_y")) & (F.col("p_x") == F.col("p_y"))
    once = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") < F.col("id_y")))
    left = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    possible = left >= F.expr(needed("n_x", "n_y"))
    met = low.join(high, same & (F.col("c_x") != F.col("c_y")) & once & possible)
    return met.select(
        F.col("id_x").alias("a"), F.col("id_y").alias("b"), F.col("c_x").alias("ca"), F.col("c_y").alias("cb")
    ).distinct()


def _labels(docs: DataFrame, nodes: DataFrame, key: str, text: str, similarity: float, least_agreeing: int) -> DataFrame:
    """`id`, `component` of the nodes that share a band with another."""
    live = written(_members(nodes), "ranked-members")
    labels = live.select("id").distinct().withColumn("component", F.col("id"))
    mated = nodes.join(live.select("id").distinct(), "id", "left_semi")
    signs = written(mated.select("id", "row", "signature"), "mated-nodes")
    sets = written(shingle_sets(docs, signs, key, text), "shingles")
    live = live.withColumns({"component": F.col("id"), "open": F.lit(True)})

    def agreeing(pairs: DataFrame) -> DataFrame:
        left = signs.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
        right = signs.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
        met = pairs.join(left, "a").join(right, "b")
        return met.where(_agreeing(F.col("sa"), F.col("sb")) >= least_agreeing).select(*pairs.columns)

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        jaccard = common / (F.size("sa") + F.size("sb") - common)
        return pairs.join(left, "a").join(right, "b").where(jaccard >= similarity).select(F.col("ca").alias("a"), F.col("cb").alias("b"))

    while True:
        # One centre a bucket, combined before the shuffle; a crowded bucket is one key of a join that AQE splits.
        centres = written(
            live.where("open").groupBy("bucket").agg(
                F.max_by(F.struct("id", "component"), F.struct("mates", "id")).alias("c"), F.count("*").alias("n")
            ).where("n > 1").select("bucket", F.col("c.id").alias("centre"), F.col("c.component").alias("of")),
            "centres",
        )
        met = live.where("open").join(centres, "bucket").where(F.col("component") != F.col("of"))
        ordered = F.col("id") < F.col("centre")
        pairs = met.select(
            F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"),
            F.when(ordered, F.col("component")).otherwise(F.col("of")).alias("ca"),
            F.when(ordered, F.col("of")).otherwise(F.col("component")).alias("cb"),
        ).distinct()
        pairs = written(agreeing(pairs), "pairs")
        links = written(verified(pairs), "verified")
        found, compared = links.count(), pairs.count()
        if found:
            mapping = components(links)
            labels = written(_relabelled(labels, mapping), "labels")
            live = _relabelled(live, mapping)
            centres = _relabelled(centres.select("bucket", F.col("of").alias("component")), mapping)
        else:
            centres = centres.select("bucket", F.col("of").alias("component"))
        mixed = live.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("bucket")
        used = centres.select("bucket", F.col("component").alias("used"))
        live = written(
            live.join(mixed, "bucket").join(used, "bucket", "left").select(
                "bucket", "id", "mates", "component",
                (F.col("open") & ~F.coalesce(F.col("component") == F.col("used"), F.lit(False))).alias("open"),
            ),
            "mixed-buckets",
        )
        if found <= LEAST_LINKED * compared or live.isEmpty():
            break
    if not live.isEmpty():
        pairs = written(rare_pairs(live.select("id", "component").distinct(), sets, similarity), "pairs")
        links = written(verified(pairs), "verified")
        if not links.isEmpty():
            labels = _relabelled(labels, components(links))
    return labels


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """`key`, `class_id`, `is_first`, `raw`: one row per row of `docs` with the least key of its class.

    Two texts are linked if their sets of five-word shingles have a Jaccard similarity of at least
    `similarity`; a class is what links connect. Words are lower-case runs of letters and digits. Texts of
    fewer than five words are one shingle. Null texts and texts without a word are each alone (class_id is
    their own key). Rows that repeat a key are placed by their texts; a class of null keys only has a hash for
    its id. `is_first` marks the rows that are alike (key and text) and stand for their class; `raw` is the
    hash of the text. The key must be an integer. Other columns are not read; an empty table gives an empty one.
    Recall of pairs at the threshold is that of the bands, 1 - (1 - similarity^rows)^bands: every pair that
    shares a band is in one component or joined exactly.
    """
    k = bands * rows
    least_agreeing = max(rows, math.floor(k * similarity - DEVIATIONS * math.sqrt(k * similarity * (1 - similarity))))
    rowed = written(signed(docs, key, text, bands, rows), "signatures")
    nodes = written(_nodes(rowed), "nodes")
    labels = written(_labels(docs, nodes, key, text, similarity, least_agreeing), "components")
    small = nodes.select("id", "h1", "h2", "least", "row")
    joined = small.join(labels, "id").select("component", "id", "least", "row")
    rank = F.struct(F.col("least").isNull().alias("keyless"), "least", "id", F.col("row"))
    firsts = joined.groupBy("component").agg(F.min(rank).alias("f"))
    placed_in = joined.join(firsts, "component").select("id", F.coalesce("f.least", "f.id").alias("class"), F.col("f.row").alias("first"))
    classes = small.join(placed_in, "id", "left").select(
        F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.coalesce("class", "least", "id").alias("class_id"),
        F.when(F.col("class").isNull(), F.col("row")).otherwise(F.col("first")).alias("first"),
    )
    placed = rowed.select("key", "raw", "h1", "h2").join(classes, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")))
    is_first = F.struct("key", "raw").eqNullSafe(F.col("first"))
    wordless = docs.where(_wordless(F.col(text))).select(
        F.col(key).cast("bigint").alias("key"), F.col(key).cast("bigint").alias("class_id"), F.lit(True).alias("is_first"),
        F.lit(None).cast("bigint").alias("raw"),
    )
    every = placed.select("key", "class_id", is_first.alias("is_first"), "raw").unionByName(wordless)
    return every.withColumnRenamed("key", key)


def _wordless(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"[\p{L}\p{M}\p{N}]"), F.lit(False))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of `docs`, with all their columns, that are the first of their class: one of each.

    Rows without a word are each alone and stay. Of rows that repeat key and text one stays.
    """
    firsts = near_duplicates(docs, key, text, **settings).where(F.col("is_first") & F.col("raw").isNotNull())
    # Rows alike in key and text are counted, so that only those are thinned out.
    firsts = firsts.groupBy(F.col(key).alias("of_key"), F.col("raw").alias("of_raw")).agg(F.count("*").alias("copies"))
    # The user's row is one column meanwhile, whatever its columns are called.
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row")).select(
        "row", F.col("row")[key].cast("bigint").alias("key"), F.col("row")[text].alias("text")
    )
    worded = rows.where(~_wordless(F.col("text"))).select("row", "key", long_hash("text").alias("raw"))
    kept = worded.join(firsts, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("raw") == F.col("of_raw")))
    once = kept.where("copies = 1").select("row")
    thinned = kept.where("copies > 1").groupBy("key", "raw").agg(F.any_value("row").alias("row")).select("row")
    alone = rows.where(_wordless(F.col("text"))).select("row")
    return once.unionByName(thinned).unionByName(alone).select("row.*")
