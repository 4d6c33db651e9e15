"""Removal of repeated byte strings by suffix sorting.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier (in a smaller document key, or
earlier in the same document). To find the strings that occur again without sorting the whole corpus in one
place, every window of LENGTH bytes is given to its least hashed gram (its minimizer): equal windows have
equal minimizers, and windows in a row mostly share one, so a text falls into runs.

1. Runs whose minimizer occurs once hold no repeat; the others stay (minimizers are counted with a map-side
   combine).
2. Of runs with equal bytes (their segments) only the first needs a look; all windows of the others have
   an earlier equal.
3. The first segments of a minimizer meet in one task. Their suffixes are sorted in two stages: those
   smaller than their successor directly, all others induced by a scan of the buckets of first bytes.
   Neighbours with a common prefix of LENGTH bytes are equal windows; the earliest of them is kept. A
   minimizer with more than LIMIT different segments (a common phrase in ever new surroundings) is
   split up: its windows are told apart by 128-bit hashes instead, so no task gets more than LIMIT.
4. Back at the documents, all windows of the runs of step 1 go but the kept ones, and covered bytes merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.frames import sliced, written

LENGTH, GRAM = 100, 20
# Windows in a run at most: longer ones (periodic text) are cut, which changes no minimizer.
PIECE = 192
LIMIT = 512
BLOCK_BYTES = 1 << 19
BLOCK_TEXT = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(3)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of `gram` bytes, by joining hashes of runs of 1, 2, 4, … bytes."""
    part, size, out, held = _TABLE[data], 1, None, 0
    while True:
        if gram & size:
            if out is None:
                out = part
            else:
                ahead = part[held:]
                n = min(len(out), len(ahead))
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + ahead[:n]
            held += size
        if size * 2 > gram:
            break
        part = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2
    out = out[: len(data) - gram + 1]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:-rest], values[rest:]) if rest else values


def runs_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, piece: int = PIECE):
    """Runs of windows with one minimizer, of several texts at once: the text's number, the start, the
    number of windows, the minimizer, and whether the minimizer stands in the run more than once (only
    then can the run repeat itself)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, np.zeros(0, np.uint64), np.zeros(0, bool)
    width = length - gram + 1
    hashes = gram_hashes(np.frombuffer(b"".join(texts), np.uint8), gram)
    least = _sliding(hashes, width, np.minimum)
    inside = np.zeros(len(least) + 1, np.int8)  # windows that lie within one text
    own = np.flatnonzero(windows)
    inside[begins[own]] += 1
    np.add.at(inside, np.minimum(begins[own] + windows[own], len(least)), -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    change = np.ones(len(least), bool)
    change[1:] = least[1:] != least[:-1]
    change[begins[own]] = True
    starts = np.flatnonzero(change & inside)
    text = own[np.searchsorted(begins[own], starts, side="right") - 1]
    ends = np.minimum(np.concatenate((starts[1:], [len(least)])), begins[text] + windows[text])
    # A gram is a minimizer if it equals the largest of the minima of the windows that hold it.
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = np.where(inside, least, np.uint64(0))
    places = hashes[_sliding(padded, width, np.maximum) == hashes]
    again = np.unique(places[1:][places[1:] == places[:-1]])
    counts = ends - starts
    if (counts > piece).any():
        parts = -(-counts // piece)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends, text = np.repeat(ends, parts), np.repeat(text, parts)
        starts = np.repeat(starts, parts) + within * piece
        counts = np.minimum(ends - starts, piece)
    values = least[starts]
    return text, starts - begins[text], counts, values, np.isin(values, again)


def two_stage_order(data: np.ndarray, depth: int = LENGTH, upto: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The suffixes of `data` (bytes) in the order of their first `depth` bytes.

    With `upto` (firsts, lasts) only those that start in these ranges, and the few after each range that
    they are induced from: up to the next suffix that is sorted directly.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # Smaller than its successor: the next different byte is larger. The last suffix is larger than none.
    differs = np.flatnonzero(data[1:] != data[:-1])
    following = np.searchsorted(differs, np.arange(n))
    rises = np.zeros(n, bool)
    inner = following < len(differs)
    at = differs[following[inner]]
    rises[inner] = data[at + 1] > data[at]
    text, wanted = data.tobytes(), np.ones(n, bool)
    if upto is not None:
        places = np.append(np.flatnonzero(rises), n - 1)
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, upto[0], 1)
        np.add.at(marks, places[np.searchsorted(places[:-1], upto[1])] + 1, -1)
        wanted = np.cumsum(marks[:-1]) > 0
    direct = sorted(np.flatnonzero(rises & wanted).tolist(), key=lambda p: text[p : p + depth])
    direct = np.array(direct, np.int64)
    chars = data[direct] if len(direct) else np.zeros(0, np.uint8)
    low, high = np.searchsorted(chars, np.arange(256), side="left"), np.searchsorted(chars, np.arange(256), side="right")
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[n - 1]:
        pending[data[n - 1]].append(np.array([n - 1]))  # induced by the empty suffix, which is the least
    out = []
    for char in range(256):
        if not pending[char] and low[char] == high[char]:
            continue
        induced = np.concatenate(pending[char]) if pending[char] else np.zeros(0, np.int64)
        bucket = [induced]
        while len(induced):  # suffixes that repeat the byte before an induced one come next
            induced = induced[induced > 0] - 1
            induced = induced[(data[induced] == char) & wanted[induced]]
            bucket.append(induced)
        bucket.append(direct[low[char] : high[char]])
        found = np.concatenate(bucket)
        out.append(found)
        before = found[found > 0] - 1
        before = before[(data[before] > char) & wanted[before]]
        kinds = data[before]
        order = np.argsort(kinds, kind="stable")
        before, kinds = before[order], kinds[order]
        cuts = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        for part in np.split(before, cuts):
            if len(part):
                pending[data[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each suffix of `order` but the first: the common prefix with the one before, up to `depth`,
    in whole words of 8 bytes (and `depth` itself)."""
    padded = np.concatenate((data, np.zeros(depth + 8, np.uint8)))
    words = np.zeros(len(data) + depth, np.uint64)
    for n in range(8):
        words = (words << np.uint64(8)) | padded[n : n + len(words)].astype(np.uint64)
    out = np.zeros(max(0, len(order) - 1), np.int64)
    alive = np.arange(len(out))
    for offset in [*range(0, depth - 7, 8), depth - 8]:
        same = words[order[alive] + offset] == words[order[alive + 1] + offset]
        alive = alive[same]
        out[alive] = offset + 8
    return out


def kept_windows(
    segments: list[bytes], keys: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int = LENGTH
) -> Iterator[tuple[int, int, int]]:
    """(segment, first, end) of the windows of `segments` that have no earlier equal among them.

    Segment n holds counts[n] windows and begins at starts[n] of document keys[n].
    """
    # Bytes move up by one so that 0 parts the segments; 255 is no byte of UTF-8.
    data = np.frombuffer(b"\xff".join(segments), np.uint8) + np.uint8(1)
    sizes = np.array([len(s) for s in segments])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    owner = np.repeat(np.arange(len(segments)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = begins[owner] + within
    number = np.full(len(data), -1)
    number[place] = np.arange(len(place))
    order = two_stage_order(data, length, (begins, begins + counts - 1))
    order = order[number[order] >= 0]
    equal = common_prefixes(data, order, length) >= length
    group = np.concatenate(([0], np.cumsum(~equal)))
    window = number[order]
    key, start = keys[owner[window]], starts[owner[window]] + within[window]
    sort = np.lexsort((start, key, group))
    group, key, start, window = group[sort], key[sort], start[sort], window[sort]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    leader = np.flatnonzero(first)[np.cumsum(first) - 1]
    keep = np.zeros(len(place), bool)
    keep[window] = (key == key[leader]) & (start == start[leader])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], keep.astype(np.int8), [0]))))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        while a < b:  # a range of kept windows may go on in the next segment
            segment = int(owner[a])
            end = min(b, a + int(counts[segment] - within[a]))
            yield segment, int(within[a]), int(within[a]) + end - a
            a = end


def _key(key: str, text: Column) -> Column:
    """The document's place in the order; rows without a key come last, by a hash of their text."""
    last = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 3)
    return F.coalesce(F.col(key).cast("bigint"), last)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Keys and texts in groups of about BLOCK_TEXT bytes."""
    keys, texts, size = [], [], 0
    for batch in sliced(batches, "text"):
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys.append(key)
            texts.append(data)
            size += len(data)
            if size >= BLOCK_TEXT:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest

    for keys, texts in _blocks(batches):
        text, starts, counts, values, again = runs_of(texts)
        ends = starts + counts + LENGTH - 1
        hashes = [xxh3_64_intdigest(texts[t][a:b]) for t, a, b in zip(text.tolist(), starts.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(values.view(np.int64)), pa.array(np.array(hashes, np.uint64).view(np.int64)),
                pa.array(np.array(keys, np.int64)[text]), pa.array(starts << 8 | counts), pa.array(again),
            ],
            names=["gram", "hash", "key", "at", "again"],
        )


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The minimizers alone, as often as they count; twice where a run may repeat itself."""
    for _, texts in _blocks(batches):
        _, _, _, values, again = runs_of(texts)
        grams, place = np.unique(values, return_inverse=True)
        n = np.bincount(place, weights=1.0 + again, minlength=len(grams)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=6)
    for batch in sliced(batches, "text"):
        packed = [pack.compress(data) for data in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["key", "packed", "doc"]
        )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First runs of a document with its text → their segments, or the windows of split minimizers."""
    import zstandard
    from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        columns: tuple[list, ...] = ([], [], [], [], [], [], [])
        offsets, firsts = batch.column(2).offsets.to_pylist(), batch.column(2).values
        fields = [firsts.field(n).to_pylist() for n in range(5)]
        for row, (key, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            data = unpack.decompress(packed)
            for gram, hash_, at, split, again in zip(*(f[offsets[row] : offsets[row + 1]] for f in fields)):
                start, count = at >> 8, at & 255
                piece = data[start : start + count + LENGTH - 1]
                # Of rows with one key and different texts each takes the runs that are its own.
                if xxh3_64_intdigest(piece) != hash_ & 0xFFFFFFFFFFFFFFFF:
                    continue
                if not split:
                    for column, value in zip(columns, (gram, 0, key, start, count, piece, again)):
                        column.append(value)
                    continue
                for n in range(count):
                    digest = xxh3_128_intdigest(piece[n : n + LENGTH])
                    signed = [(x & 0xFFFFFFFFFFFFFFFF) - ((x >> 63 & 1) << 64) for x in (digest, digest >> 64)]
                    for column, value in zip(columns, (*signed, key, start + n, 1, None, False)):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
        names = ["gram", "hash", "key", "start", "count", "segment", "again"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _sort_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of their minimizers → the windows to keep. Minimizers are sorted together in
    blocks of about BLOCK_BYTES; no minimizer is cut. A segment that is alone with its minimizer, which
    stands in it once, has nothing equal and is kept as it is."""
    block: list[tuple] = []
    group: list[tuple] = []
    lone: list[tuple] = []
    size = 0

    def rows_of(found) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["key", "first", "end", "check"]
        )

    def sort_block() -> pa.RecordBatch:
        _, keys, starts, counts, segments, _ = zip(*block)
        found = kept_windows(list(segments), np.array(keys), np.array(starts), np.array(counts))
        return rows_of([(keys[s], starts[s] + a, starts[s] + b, crc32(segments[s][a : a + LENGTH])) for s, a, b in found])

    def close_group() -> None:
        nonlocal size
        if len(group) == 1 and not group[0][5]:
            _, key, start, count, segment, _ = group[0]
            lone.append((key, start, start + count, crc32(segment[:LENGTH])))
        else:
            block.extend(group)
            size += sum(len(row[4]) for row in group)
        group.clear()

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in range(6))):
            if group and row[0] != group[0][0]:
                close_group()
                if size >= BLOCK_BYTES:
                    yield sort_block()
                    block.clear()
                    size = 0
                if len(lone) >= 10_000:
                    yield rows_of(lone)
                    lone.clear()
            group.append(row)
    if group:
        close_group()
    if block:
        yield sort_block()
    if lone:
        yield rows_of(lone)


def _covered(size: int, firsts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `size` places lie in one of the ranges."""
    marks = np.zeros(size + 1, np.int32)
    np.add.at(marks, firsts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]) > 0


def _removed(data: bytes, at: np.ndarray, hashes: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which bytes go. `kept` has the columns first, end and check; a first of -1 says that the key
    stands on several rows, of which each takes only what is its own."""
    from xxhash import xxh3_64_intdigest

    firsts, counts = at >> 8, at & 255
    repeated = kept[0] < 0
    if repeated.any():
        kept = kept[:, ~repeated]
        mine = [
            xxh3_64_intdigest(data[a : a + n + LENGTH - 1]) == h & 0xFFFFFFFFFFFFFFFF
            for a, n, h in zip(firsts.tolist(), counts.tolist(), hashes.tolist())
        ]
        firsts, counts = firsts[mine], counts[mine]
        valid = [c < 0 or crc32(data[a : a + LENGTH]) == c for a, c in zip(kept[0].tolist(), kept[2].tolist())]
        kept = kept[:, valid]
    windows = max(0, len(data) - LENGTH + 1)
    fits = kept[1] <= windows
    going = _covered(windows, firsts, firsts + counts) & ~_covered(windows, kept[0][fits], kept[1][fits])
    edges = np.flatnonzero(np.diff(going.astype(np.int8), prepend=0, append=0))
    return _covered(len(data), edges[::2], edges[1::2] + LENGTH - 1)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        runs, windows = batch.column(2), batch.column(3)
        of_runs, of_windows = runs.offsets.to_pylist(), windows.offsets.to_pylist()
        at, hashes = (runs.values.field(n).to_numpy(zero_copy_only=False) for n in range(2))
        kept = np.stack([windows.values.field(n).to_numpy(zero_copy_only=False) for n in range(3)])
        for row, packed in enumerate(batch.column(1).to_pylist()):
            data = unpack.decompress(packed)
            a, b = of_runs[row], of_runs[row + 1]
            rest, removed, spans = data, 0, 0
            if a < b:
                gone = _removed(data, at[a:b], hashes[a:b], kept[:, of_windows[row] : of_windows[row + 1]])
                removed = int(np.count_nonzero(gone))
                if removed:
                    rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
            for column, value in zip(out, (len(data), removed, spans, hashlib.sha256(rest).hexdigest(), rest)):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))],
            names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, `kept` of every text, one row per row.

    Texts are UTF-8 bytes, a null text is empty; texts under LENGTH bytes lose nothing. The key must be an
    integer; null keys come after all others, in order of a hash of their texts. Rows that repeat key and
    text count as one document, rows with equal keys and different texts as the same place in the order.
    Overlapping strings count, and strings are judged on the input. An empty table gives an empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(_key(key, whole).alias("key"), whole.cast("binary").alias("text"))
    runs = rows.mapInArrow(_find_runs, "gram bigint, hash bigint, key bigint, at bigint, again boolean")
    counted = rows.select("key", "text").mapInArrow(_count_grams, "gram bigint, n bigint")
    repeated = counted.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    candidates = written(runs.join(repeated, "gram"), "repeat-candidates")
    first = F.min(F.struct("key", "at", "again")).alias("first")
    firsts = written(
        candidates.groupBy("gram", "hash").agg(first).select("gram", "hash", "first.key", "first.at", "first.again"),
        "repeat-firsts",
    )
    crowded = firsts.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > LIMIT).select("gram", F.lit(True).alias("split"))
    listed = (
        firsts.join(crowded, "gram", "left")
        .groupBy("key")
        .agg(F.collect_list(F.struct("gram", "hash", "at", F.coalesce("split", F.lit(False)).alias("split"), "again")).alias("firsts"))
    )
    texts = docs.select(_key(key, whole).alias("key"), whole.cast("binary").alias("text"), F.col(key).cast("bigint").alias("doc"))
    texts = texts.mapInArrow(_compress, "key bigint, packed binary, doc bigint")
    segments = written(
        texts.select("key", "packed").join(listed, "key").mapInArrow(
            _segments, "gram bigint, hash bigint, key bigint, start bigint, count int, segment binary, again boolean"
        ),
        "repeat-segments",
    )
    together = segments.where(F.col("segment").isNotNull()).select("gram", "key", "start", "count", "segment", "again")
    sorted_kept = together.repartition("gram").sortWithinPartitions("gram").mapInArrow(
        _sort_segments, "key bigint, first bigint, end bigint, check bigint"
    )
    split_kept = (
        segments.where(F.col("segment").isNull())
        .groupBy("gram", "hash")
        .agg(F.min(F.struct("key", "start")).alias("w"))
        .select("w.key", F.col("w.start").alias("first"), (F.col("w.start") + 1).alias("end"), F.lit(-1).cast("bigint").alias("check"))
    )
    # Keys that stand on several rows are marked, as their lists belong to different texts.
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    marks = shared.select("key", *[F.lit(-1).cast("bigint").alias(c) for c in ("first", "end", "check")])
    kept = sorted_kept.unionByName(split_kept).unionByName(marks).groupBy("key").agg(F.collect_list(F.struct("first", "end", "check")).alias("kept"))
    going = candidates.groupBy("key").agg(F.collect_list(F.struct("at", "hash")).alias("runs"))
    joined = texts.join(going, "key", "left").join(kept, "key", "left").select("doc", "packed", "runs", "kept")
    nothing = [F.coalesce(c, F.array().cast(t)) for c, t in (("runs", "array<struct<at:bigint,hash:bigint>>"), ("kept", "array<struct<first:bigint,end:bigint,check:bigint>>"))]
    joined = joined.select("doc", "packed", nothing[0].alias("runs"), nothing[1].alias("kept"))
    removed = joined.mapInArrow(
        _remove, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
    return removed.withColumnRenamed("doc", key)
