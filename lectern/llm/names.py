"""Joining names by edit distance: tries descended with rows of the dynamic programme, in shards by length.

Distance is optimal string alignment: insertions, deletions, substitutions and exchanges of two adjacent code points, no
substring edited twice. Equal names meet as one, with what is asked of their rows already summed up.

Shards. Names of one length n are a shard; within it they are dealt out by ``2 * limit + 1`` even segments. An edit touches
at most two segments (an exchange over a border), so of a pair within ``limit`` edits one segment is left whole, and stands
in the other name with a shift that its edits allow. So a name is sent to its segments' keys, the other side to the keys of
all its substrings that can be such a segment of a name of any length in reach, and pairs meet under (length, segment,
code points). A pair that meets under several keys counts under the first. Keys of more than ``PIECE`` names
or ``ASKED`` askers are cut into pieces of either side, each of which meets all pieces of the other; so no task holds a hot key.

Tries. A task sorts the names of its keys; the common prefixes of neighbours are the trie, whose first level are the keys. The other side's
rows descend it together, one level a step: a row of the programme, of the ``limit + 1`` diagonals that the two lengths leave open, is worked
out once for each node and asker, so names share it along their prefixes. The row before the last is kept for exchanges. An asker
leaves a node where all cells of its row, with the edits that the rest needs at least, exceed the limit.

Cases: null and empty names take no part; null ids count in numbers, but not as the smallest, and their text for a checksum is
''; rows that repeat count as often as they stand; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored

LIMIT = 2
#: Names of a key that one task holds at most.
PIECE = 4000
#: Rows of askers of a key that one task holds at most.
ASKED = 50_000
#: Askers that descend together.
ASKERS = 1024
_FAR = 99


def misspelt(name: Column, number: Column) -> Column:
    """``name`` with the code points at h mod (L - 1) and the next exchanged, if the crc32 h of ``number`` is even and L at least 2."""
    h, n = F.crc32(F.coalesce(number.cast("string"), F.lit(""))), F.char_length(name)
    at = (h % F.greatest(n - 1, F.lit(1))).cast("int")
    turned = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 3, n))
    return F.when((h % 2 == 0) & (n >= 2), turned).otherwise(name)


def diagonals(gap: int, limit: int) -> range:
    """Diagonals (name's position less asker's) that a pair whose lengths differ by ``gap`` can use within ``limit`` edits."""
    return range(-((limit - gap) // 2), (limit + gap) // 2 + 1)


def _segments(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of a name of ``n`` code points; the last ones are longer."""
    size, longer = F.floor(n / parts).cast("int"), parts - n % parts
    start = i * size + F.greatest(F.lit(i) - longer, F.lit(0))
    return start.cast("int"), (size + F.when(F.lit(i) >= longer, 1).otherwise(0)).cast("int")


def name_keys(names: DataFrame, limit: int) -> DataFrame:
    """Each row of ``names`` (name, n, ..) once for each of its segments, with the key (n, seg, part)."""
    parts = 2 * limit + 1
    made = []
    for i in range(parts):
        start, size = _segments(F.col("n"), i, parts)
        made.append(F.struct(F.lit(i).alias("seg"), F.substring(F.col("name"), start + 1, size).alias("part")))
    return names.withColumn("_k", F.explode(F.array(*made))).select("*", "_k.seg", "_k.part").drop("_k")


def asker_keys(askers: DataFrame, limit: int) -> DataFrame:
    """Each row of ``askers`` (asked, m) once for each key under which a name within ``limit`` may stand."""
    parts, made = 2 * limit + 1, []
    for gap in range(-limit, limit + 1):
        n = F.col("m") + gap
        for i in range(parts):
            start, size = _segments(n, i, parts)
            for shift in diagonals(gap, limit):
                at = start - shift  # where the name's segment stands in the asker
                fits = (n > 0) & (at >= 0) & (at + size <= F.col("m"))
                made.append(F.when(fits, F.struct(n.cast("int").alias("n"), F.lit(i).alias("seg"), F.substring(F.col("asked"), at + 1, size).alias("part"))))
    keys = F.array_distinct(F.filter(F.array(*made), lambda k: k.isNotNull()))
    return askers.withColumn("_k", F.explode(keys)).select("asked", "m", "_k.*")


def _codes(texts: list[str], width: int) -> np.ndarray:
    """A row of code points for each text, filled up with zeros."""
    out = np.zeros((len(texts), width), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.repeat(np.arange(len(texts)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def trie(keys: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """First rows of the nodes of each level: level 0 has the keys, level t the prefixes of t code points. Rows are sorted by key and code points."""
    if not len(keys):
        return [np.zeros(0, np.int64)] * (codes.shape[1] + 1)
    differ = np.concatenate([(keys[1:] != keys[:-1])[:, None], codes[1:] != codes[:-1], np.ones((len(keys) - 1, 1), bool)], axis=1)
    shared = np.concatenate([[0], np.argmax(differ, axis=1)])  # levels shared with the row before
    return [np.flatnonzero(shared <= t) for t in range(codes.shape[1] + 1)]


def descend(codes: np.ndarray, levels: list[np.ndarray], roots: np.ndarray, asked: np.ndarray, m: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asker, name, distance) of all pairs within ``limit``.

    ``codes`` has names of one length under the trie ``levels``; row i of ``asked`` has an asker of ``m`` code points that starts at node ``roots[i]`` of level 0.
    """
    n = codes.shape[1]
    ks = diagonals(n - m, limit)
    rest = np.array([abs(n - m - k) for k in ks], np.int16)
    nodes, who = roots, np.arange(len(roots))
    # cell c of a row at level t: name's prefix of t against asker's prefix of t - k
    row = np.stack([np.full(len(who), -k if k <= 0 <= m + k else _FAR, np.int16) for k in ks], axis=1)
    row[row + rest > limit] = _FAR
    before = np.full_like(row, _FAR)
    wide = np.concatenate([np.zeros((len(asked), 1), np.uint32), asked], axis=1)  # position i holds code point i, from 1
    for t in range(1, n + 1):
        above, here = levels[t - 1], levels[t]
        low = np.searchsorted(here, above[nodes])
        high = np.where(nodes + 1 < len(above), np.searchsorted(here, above[np.minimum(nodes + 1, len(above) - 1)]), len(here))
        times = high - low
        parent = np.repeat(np.arange(len(nodes)), times)
        nodes = np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(parent))
        who = who[parent]
        last, earlier = row[parent], before[parent]
        char = codes[here[nodes], t - 1]
        previous = codes[here[nodes], t - 2] if t > 1 else np.zeros(len(nodes), np.uint32)
        row = np.full_like(last, _FAR)
        for c in range(len(ks) - 1, -1, -1):
            i = t - ks[c]
            if not 0 <= i <= m:
                continue
            best = np.full(len(nodes), _FAR, np.int16)
            if i > 0:
                mine = wide[who, i]
                best = last[:, c] + (mine != char)
                if i > 1 and t > 1:
                    swap = (mine == previous) & (wide[who, i - 1] == char)
                    best = np.where(swap, np.minimum(best, earlier[:, c] + 1), best)
                if c + 1 < len(ks):
                    best = np.minimum(best, row[:, c + 1] + 1)
            if c > 0:
                best = np.minimum(best, last[:, c - 1] + 1)
            row[:, c] = np.where(best + rest[c] > limit, _FAR, best)
        live = np.flatnonzero(row.min(axis=1, initial=_FAR) < _FAR)
        nodes, who, row, before = nodes[live], who[live], row[live], last[live]
        if not len(live):
            break
    end = list(ks).index(n - m) if n - m in ks else 0
    found = np.flatnonzero(row[:, end] <= limit) if len(nodes) else np.zeros(0, np.int64)
    return who[found], levels[n][nodes[found]] if len(found) else found, row[found, end]


def _first_key(names: np.ndarray, asked: np.ndarray, m: int, seg: np.ndarray, limit: int) -> np.ndarray:
    """Whether no earlier segment of the name than ``seg`` stands in the asker, too."""
    n, parts = names.shape[1], 2 * limit + 1
    first = np.ones(len(seg), bool)
    size, longer = n // parts, parts - n % parts
    for i in range(parts - 1):
        start, width = i * size + max(i - longer, 0), size + (i >= longer)
        for shift in diagonals(n - m, limit):
            at = start - shift
            if at >= 0 and at + width <= m:
                first &= ~((names[:, start : start + width] == asked[:, at : at + width]).all(axis=1) & (seg > i))
    return first


def _matched(rows: pd.DataFrame, limit: int) -> Iterator[pd.DataFrame]:
    """All pairs of the keys in ``rows`` (n, seg, part, piece, m, name); names have m = 0. Rows: asked, distance, at (the name's row)."""
    for n, of in rows.groupby("n", sort=False):
        names, askers = of[of.m == 0], of[of.m > 0]
        if not len(names) or not len(askers):
            continue
        names = names.sort_values(["seg", "part", "piece", "name"])
        key = ["seg", "part", "piece"]
        ids = pd.MultiIndex.from_frame(names[key]).factorize()
        codes = _codes(names.name.tolist(), n)
        levels = trie(ids[0], codes)
        roots = ids[1].get_indexer(pd.MultiIndex.from_frame(askers[key]))
        askers, roots = askers[roots >= 0], roots[roots >= 0]
        for m, some in askers.assign(root=roots).groupby("m", sort=False):
            for at in range(0, len(some), ASKERS):
                few = some.iloc[at : at + ASKERS]
                asked = _codes(few.name.tolist(), m)
                who, which, distance = descend(codes, levels, few.root.to_numpy(), asked, m, limit)
                own = _first_key(codes[which], asked[who], m, few.seg.to_numpy()[who], limit)
                who, which, distance = who[own], which[own], distance[own]
                yield pd.DataFrame({"asked": few.name.to_numpy(dtype=object)[who], "distance": distance.astype(np.int32), "at": names.index.to_numpy()[which]})


def pairs(names: DataFrame, askers: DataFrame, limit: int = LIMIT, piece: int = PIECE, n_parts: int | None = None) -> DataFrame:
    """(asked, distance, name, and the further columns of ``names``) of all pairs of distinct names within ``limit``.

    ``names`` has a column name and ``askers`` a column asked; both are distinct, and neither null nor empty.
    """
    spark = names.sparkSession
    further = [c for c in names.columns if c != "name"]
    key = ["n", "seg", "part"]
    dealt = name_keys(names.withColumn("n", F.char_length("name")), limit)
    wanted = asker_keys(askers.withColumn("m", F.char_length("asked")), limit)
    # keys of too many names or askers are cut into pieces of either, and all pieces of one side meet all of the other
    counted = dealt.select(*key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(wanted.select(*key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    counted = counted.groupBy(*key).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter((F.col("a") > piece) | (F.col("b") > ASKED))
    sizes = stored(counted.select(*key, F.ceil(F.col("a") / piece).cast("int").alias("a"), F.ceil(F.col("b") / ASKED).cast("int").alias("b")), "name-keys")
    if sizes.isEmpty():
        dealt, wanted = dealt.withColumn("piece", F.lit(0)), wanted.withColumn("piece", F.lit(0))
    else:
        own = lambda name, n: F.pmod(F.xxhash64(name), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)))
        every = lambda n: F.sequence(F.lit(0), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) - 1)
        at = lambda a, b: (a * F.greatest(F.coalesce("b", F.lit(1)), F.lit(1)) + b).cast("int")
        dealt = dealt.join(sizes, key, "left").withColumn("_other", F.explode(every(F.col("b")))).withColumn("piece", at(own("name", F.col("a")), F.col("_other"))).drop("a", "b", "_other")
        wanted = wanted.join(sizes, key, "left").withColumn("_other", F.explode(every(F.col("a")))).withColumn("piece", at(F.col("_other"), own("asked", F.col("b")))).drop("a", "b", "_other")
    kinds = {f.name: f.dataType for f in names.schema}
    both = dealt.select(*key, "piece", F.lit(0).alias("m"), "name", *further).unionByName(wanted.select(*key, "piece", "m", F.col("asked").alias("name"), *[F.lit(None).cast(kinds[c]).alias(c) for c in further]))
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(n_parts, *key, "piece").sortWithinPartitions(*key, "piece")
    out = names.select(F.lit("").alias("asked"), F.lit(0).alias("distance"), "name", *further).schema

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        form = to_arrow_schema(out)
        for table in _by_key(batches, [*key, "piece"]):
            frame = table.select([*key, "piece", "m", "name"]).to_pandas()
            for found in _matched(frame, limit):
                taken = table.select(["name", *further]).take(pa.array(found["at"].to_numpy()))
                columns = [pa.array(found.asked, pa.string()), pa.array(found.distance.to_numpy(), pa.int32()), *taken.columns]
                yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, form, strict=True)], schema=form).to_batches()

    return both.mapInArrow(match, out)


def _by_key(batches: Iterator[pa.RecordBatch], key: list[str], least: int = 50_000) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows that cut no key, of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held)
        last = [table[k][-1].as_py() for k in key]
        keys = table.select(key).to_pandas()
        same = np.logical_and.reduce([keys[k].to_numpy() == v for k, v in zip(key, last, strict=True)])
        cut = len(same) - int(same.sum())
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def join(clients: DataFrame, vendors: DataFrame, limit: int = LIMIT, piece: int = PIECE) -> DataFrame:
    """(vendor_id, distance, n_clients, first_client_id, clients_crc) for each vendor and exact distance with a pair."""
    crc = F.crc32(F.coalesce(F.col("client_id").cast("string"), F.lit("")))
    names = clients.filter("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n_clients"), F.min("client_id").alias("first_client_id"), F.sum(crc).alias("clients_crc"))
    asking = vendors.filter("name <> ''").select("vendor_id", misspelt(F.col("name"), F.col("vendor_id")).alias("asked"))
    found = pairs(stored(names, "names"), stored(asking.select("asked").distinct(), "askers"), limit, piece)
    sums = [F.sum("n_clients").alias("n_clients"), F.min("first_client_id").alias("first_client_id"), F.sum("clients_crc").alias("clients_crc")]
    by_name = found.groupBy("asked", "distance").agg(*sums)
    per_vendor = asking.join(by_name, "asked").groupBy("vendor_id", "distance").agg(*sums)
    return per_vendor.select("vendor_id", F.col("distance").cast("int").alias("distance"), "n_clients", "first_client_id", "clients_crc")
