"""Operator 3, n-gram Jaccard join by prefix trees.

1. Rows with equal n-gram sets are one class, known by the set's 128-bit digest; its smallest id stands for it.
2. The n-grams have one global order: those of common cells of a fixed-size count sketch last, then by hash. Of two sets
   that are similar enough, the first few n-grams in that order (the share that may differ, and one) have one in common.
   Each such n-gram that two classes share gives a group: the classes that have it, named by the smallest of them.
3. Within a group only sets that may have a similar one go on. Each set has a parity bitmap, which changes by at most a
   bit for each n-gram that two sets don't share: bitmaps that differ by more than a similar pair's sets may rule it out.
   What is left of a group falls into candidate families.
4. A family's sets are put into a prefix tree, the group's most shared n-grams first. A set is looked up before it is put
   in: the walk carries the overlap so far, shared by all sets below a node, and leaves out what is below once the
   lengths that remain can't reach the needed overlap, or once all there is linked to the set already.
   At first each set goes to its first family only; then families that still hold several components are joined again,
   with what is connected taken as known. A family of over ``GROUP_GRAMS`` n-grams is dealt into blocks, each with its
   smallest set; in the second round those apart from its first component, in parts, meet every block.
5. Links, a spanning few for each group, are joined to components.

Hashes are 64 bits of a word n-gram; no text is compared by less than all its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, discard, documents, mixed, narrow, saved, steps, words_of
from millrace.llm.components import components

SHINGLE, PERCENT = 4, 85
#: Cells of the count sketch; a cell is common that has so many standard deviations, and so many counts, over the mean.
CELL_BITS, SURE, LEAST_COMMON = 18, 6, 16
#: N-grams that a block of a family holds, about, and bytes of bitmaps of a group up to which it is sifted.
GROUP_GRAMS, SIFT_BYTES = 1 << 20, 16 << 20
#: Rows that are taken out of an Arrow batch at once.
PART = 256


def gram_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text with fewer words has one of all its words, one without words none."""
    words = words_of(texts, LOWER)
    grams, whole = words.grams(size), words.runs(size)
    out = []
    for a, b in zip(words.first, words.first[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a:b][whole[a:b]]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words.hash[a:b]:
                h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a = mixed(grams + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
        b = mixed(grams ^ np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def common_cells(rows: DataFrame, size: int) -> np.ndarray:
    """Which cells of the sketch are common: flags for 2**CELL_BITS cells, however large the table."""
    cells = 1 << CELL_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(cells, np.int64)
        for batch in steps(batches):
            every = np.concatenate([*gram_sets(batch.column("text"), size), np.zeros(0, np.uint64)])
            count += np.bincount((every & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], ["cell", "n"])

    counted = saved(rows.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    mean = (counted.agg(F.sum("n")).first()[0] or 0) / cells
    flags = np.zeros(cells, bool)
    most = mean + SURE * mean**0.5 + LEAST_COMMON
    flags[[r.cell for r in counted.where(F.col("n") > most).select("cell").collect()]] = True
    discard(counted)
    return flags


def in_order(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    late = common[(grams & np.uint64(len(common) - 1)).astype(np.int64)]
    return np.concatenate([grams[~late], grams[late]])


class Node:
    __slots__ = ("label", "below", "ends", "least", "most", "some", "uniform")

    def __init__(self, label: np.ndarray):
        self.label = label
        self.below: dict[int, Node] = {}
        self.ends: list[int] = []
        self.least, self.most, self.some, self.uniform = 1 << 60, 0, -1, True


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def tree_join(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[int]:
    """For each set the first of those (by position) that similar ones connect it to within this group.

    Sets with the same ``known`` label are connected already and aren't compared.
    """
    forest = Forest(len(sets))
    seen: dict[int, int] = {}
    for i, label in enumerate(known or ()):
        forest.union(seen.setdefault(label, i), i)
    sizes = [len(s) for s in sets]
    every = np.concatenate(sets)
    grams, codes, counts = np.unique(every, return_inverse=True, return_counts=True)
    order = np.empty(len(grams), np.int64)
    order[np.lexsort((grams, -counts))] = np.arange(len(grams))
    ranked = np.split(order[codes.reshape(-1)], np.cumsum(sizes)[:-1])
    root = Node(np.zeros(0, np.int64))
    has = np.zeros(len(grams), bool)
    for i in sorted(range(len(sets)), key=lambda i: sizes[i]):
        x = np.sort(ranked[i])
        has[x] = True
        _look(root, x, i, has, sizes, percent, forest)
        has[x] = False
        _put(root, x, i, forest)
    return [forest.find(i) for i in range(len(sets))]


def _look(root: Node, x: np.ndarray, i: int, has: np.ndarray, sizes: list[int], percent: int, forest: Forest) -> None:
    n = len(x)
    stack = [(root, 0, 0)]
    while stack:
        node, overlap, depth = stack.pop()
        if node.some < 0 or 100 * node.most < percent * n or (node.uniform and forest.find(node.some) == forest.find(i)):
            continue
        if len(node.label):
            overlap += int(has[node.label].sum())
            depth += len(node.label)
            left = n - int(np.searchsorted(x, node.label[-1], "right"))
            shortest = max(node.least, -(-percent * n // 100))
            if (100 + percent) * (overlap + min(left, node.most - depth)) < percent * (n + shortest):
                continue
        for j in node.ends:
            if (100 + percent) * overlap >= percent * (n + sizes[j]):
                forest.union(i, j)
        stack.extend((c, overlap, depth) for c in node.below.values())


def _put(root: Node, x: np.ndarray, i: int, forest: Forest) -> None:
    node, at, n = root, 0, len(x)
    while True:
        node.least, node.most = min(node.least, n), max(node.most, n)
        if node.some < 0:
            node.some = i
        elif node.uniform and forest.find(node.some) != forest.find(i):
            node.uniform = False
        if at == n:
            node.ends.append(i)
            return
        child = node.below.get(int(x[at]))
        if child is None:
            child = node.below[int(x[at])] = Node(x[at:])
            node, at = child, n
            continue
        k = min(len(child.label), n - at)
        differ = np.flatnonzero(child.label[:k] != x[at : at + k])
        same = int(differ[0]) if len(differ) else k
        if same < len(child.label):  # split: what both share goes above
            above = Node(child.label[:same])
            above.least, above.most, above.some, above.uniform = child.least, child.most, child.some, child.uniform
            child.label = child.label[same:]
            above.below[int(child.label[0])] = child
            node.below[int(x[at])] = above
            child = above
        node, at = child, at + same


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes over a power of two of at least 2n bits, as 64-bit words; halves xor to the next smaller one."""
    bits = max(64, 1 << (2 * len(grams) - 1).bit_length())
    parity = np.bincount((mixed(grams) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def families(maps: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """For each set the smallest position in its family: sets that chains of bitmaps that could be of similar sets join."""
    n = len(maps)
    out = np.arange(n)
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    width = np.array([len(m) for m in maps])
    for w in set(width.tolist()):  # rows of that width and the next larger one, at width w, and where each row is
        own = np.flatnonzero((width == w) | (width == 2 * w))
        where = np.full(n, -1)
        where[own] = np.arange(len(own))
        folded[w] = np.stack([maps[i] if width[i] == w else maps[i][:w] ^ maps[i][w:] for i in own]), where
    apart = np.ones(n, bool)
    for start in range(n):
        if not apart[start]:
            continue
        apart[start], queue = False, [start]
        while queue and apart.any():
            i = queue.pop()
            rest = np.flatnonzero(apart & (100 * sizes >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes))
            for w in {int(width[i]), int(width[i]) // 2, int(width[i]) * 2}:
                there = rest[width[rest] == w]
                if not len(there):
                    continue
                rows, where = folded[min(w, width[i])]
                differ = np.bitwise_count(rows[where[there]] ^ rows[where[i]]).sum(1)
                # 100 * (s - d) / 2 >= percent * (s + d) / 2, with s the sum of the sizes and d what isn't shared
                near = there[(100 + percent) * differ.astype(np.int64) <= (100 - percent) * (sizes[there] + sizes[i])]
                apart[near] = False
                out[near] = start
                queue.extend(near.tolist())
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], values: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each run of equal keys, over the ends of batches."""
    key, held = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, PART):  # few rows at once as Python objects: sets can be long
            part = batch.slice(at, PART)
            for row in zip(*(part.column(c).to_pylist() for c in (*keys, *values))):
                if row[: len(keys)] != key:
                    if held:
                        yield key, held
                    key, held = row[: len(keys)], []
                held.append(row[len(keys) :])
    if held:
        yield key, held


def _sifted(members: DataFrame, percent: int) -> DataFrame:
    """members: grp, id, n, map; grp, fam and id of those that have a possible partner in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, fam, kept = [], [], []
        for (g,), held in _runs(batches, ("grp",), ("id", "n", "map")):
            held.sort()
            if len(held) < 2:
                continue
            root = families([np.frombuffer(m, np.uint64) for _, _, m in held], np.array([n for _, n, _ in held], np.int64), percent)
            many = np.bincount(root)[root] > 1
            for i in np.flatnonzero(many):
                grp.append(g)
                fam.append(held[root[i]][0])
                kept.append(held[i][0])
            if len(kept) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (grp, fam, kept)], ["grp", "fam", "id"])
                grp, fam, kept = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (grp, fam, kept)], ["grp", "fam", "id"])

    return members.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "grp long, fam long, id long")


def _links(places: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """places: grp, fam, block, id, known; links (a, b) that connect the similar sets of each place.

    Each text meets its places once; its set is made there and sent to each place.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            made = [s.tobytes() for s in gram_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("places"), pa.array(made, pa.binary())], ["id", "places", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _runs(batches, ("grp", "fam", "block"), ("id", "known", "grams")):
            held = sorted(set(held))
            if len(held) < 2:
                continue
            ids = [i for i, _, _ in held]
            roots = tree_join([np.frombuffer(g, np.uint64) for _, _, g in held], percent, [k for _, k, _ in held])
            a, b = zip(*((ids[i], ids[r]) for i, r in enumerate(roots)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    gathered = places.groupBy("id").agg(F.collect_list(F.struct("grp", "fam", "block", "known")).alias("places"))
    with_sets = rows.join(gathered.hint("merge"), "id").select("id", "text", "places").mapInArrow(sets, "id long, places array<struct<grp:long,fam:long,block:int,known:long>>, grams binary")
    spread = with_sets.select("id", F.inline("places"), "grams").repartition("grp", "fam", "block").sortWithinPartitions("grp", "fam", "block")
    out = saved(spread.mapInArrow(run, "a long, b long").where("a <> b").distinct(), "found")
    return out


def _spread(n: str, total: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(total) / F.lit(GROUP_GRAMS)).cast("int")).alias(n)


def linked(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``key``, n_shingles (set size) and component_id (smallest key that links reach) of every row.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets. A null text, or one without words, has an
    empty set and no link: its component is its own key. A null key has a null component and links nothing. Rows that
    repeat a key are one document with several texts: their links count for the key, n_shingles is each row's own. An
    empty table gives an empty one; only the two named columns are read.
    """
    spark = df.sparkSession
    rows = narrow(df, id=key, text=text).withColumn("id", F.col("id").cast("long"))
    bits = np.packbits(common_cells(rows, size)).tobytes()

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in steps(batches):
            sets = gram_sets(batch.column("text"), size)
            marks = [digest(s) for s in sets]
            heads = [in_order(s, late)[: prefix_length(len(s), percent)].view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            head = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*heads, np.zeros(0, np.int64)]), pa.int64()))
            maps = pa.array([bitmap(s).tobytes() if len(s) else b"" for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()), maps, head], ["id", "n", "a", "b", "map", "head"])

    shaped = saved(rows.mapInArrow(shape, "id long, n long, a long, b long, map binary, head array<long>"), "shapes")
    full = shaped.where("id is not null and n > 0")
    # saved, so that each side of the joins on it is dealt by itself and a hot class or n-gram can be split
    classes = saved(full.groupBy("a", "b", "n").agg(F.min("id").alias("rep")), "reps")
    of = saved(shaped.select("id", "n", "a", "b").join(classes, ["a", "b", "n"], "left").select("id", "n", "rep"), "classes")
    # a class's first row stands for it; head and bitmap are the same for the whole class
    first = full.join(classes.withColumnRenamed("rep", "id"), ["a", "b", "n", "id"])
    maps = saved(first.select("id", "n", "map").dropDuplicates(["id", "n", "map"]), "maps")
    heads = saved(first.select("id", F.explode("head").alias("gram")), "heads")
    discard(shaped, classes)
    shared = saved(heads.groupBy("gram").agg(F.min("id").alias("grp"), F.max("id").alias("top")).where("grp <> top").select("gram", "grp"), "shared")
    members = saved(heads.join(shared, "gram").select("grp", "id").distinct(), "members")
    discard(heads, shared)
    mapped = members.join(maps, "id")
    weight = mapped.groupBy("grp").agg(F.sum(F.length("map")).alias("bytes"))
    large = saved(weight.where(F.col("bytes") > SIFT_BYTES).select("grp"), "large")
    kept = _sifted(mapped.join(large, "grp", "left_anti"), percent).unionAll(members.join(large, "grp").select("grp", F.col("grp").alias("fam"), "id"))
    kept = saved(kept.join(maps.groupBy("id").agg(F.max("n").alias("n")), "id").select("grp", "fam", "id", "n"), "families")
    # the texts that go on are taken out once; merged at any size, so that what a small table needs tells what a large one will
    discard(large, members, maps)
    candidates = saved(rows.join(kept.select("id").distinct().hint("merge"), "id"), "candidates")

    home = F.pmod(F.xxhash64("grp", "fam", "id"), F.col("blocks")).cast("int")
    own = ["grp", "fam"]
    # round 1: each set in the first of its families, a family's smallest set in each of its blocks
    at_first = kept.groupBy("id").agg(F.min(F.struct("grp", "fam", "n")).alias("x")).select("x.grp", "x.fam", "id", "x.n")
    at_first = at_first.unionByName(kept.where("id = fam")).distinct()
    blocks = at_first.groupBy(own).agg(F.sum("n").alias("total")).select(*own, _spread("blocks", "total"))
    placed = at_first.join(blocks, own).withColumn("block", F.explode(F.when(F.col("id") == F.col("fam"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home))))
    links = _links(placed.select(*own, "block", "id", F.col("id").alias("known")), candidates, size, percent)
    # round 2: families that hold several components; those apart from the family's first one, in parts, meet each block
    first_links, joined = links, components(links)
    state = kept.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("known", F.coalesce("component", "id"))
    whole = state.groupBy(own).agg(F.min("known").alias("low"), F.max("known").alias("high"), F.sum("n").alias("total")).where("low <> high")
    whole = saved(whole.select(*own, "low", _spread("blocks", "total")), "apart")
    apart = saved(state.join(whole, own).select(*own, "id", "n", "known", "blocks", (F.col("known") == F.col("low")).alias("old")), "again")
    parts = apart.where("not old").groupBy(own).agg(F.sum("n").alias("total")).select(*own, _spread("parts", "total"))
    state = apart.join(parts, own).withColumns({"home": home, "part": F.pmod(F.xxhash64("id", "fam"), F.col("parts")).cast("int")})
    at_home = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p * F.col("blocks") + F.col("home"))
    as_part = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.col("part") * F.col("blocks") + b)
    again = state.withColumn("block", F.explode(F.when(F.col("old"), at_home).otherwise(F.array_union(at_home, as_part))))
    more_links = _links(again.select(*own, "block", "id", "known"), candidates, size, percent)
    discard(candidates, kept, joined, whole, apart)
    links = first_links.unionAll(more_links)
    # rows that repeat a key with other texts tie their classes together
    tied = of.join(of.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("id"), "id", "left_semi").where("rep is not null").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    roots = components(links.unionAll(tied))
    discard(first_links, more_links)
    out = of.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     grams AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN ws ELSE ws[i:i + 3] END AS gram
               FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
     sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
     shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
     links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
     reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
