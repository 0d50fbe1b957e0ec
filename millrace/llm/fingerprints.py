"""Operator 8, document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A text is a set of paragraph digests, of its lines cut at the ends of sentences. Its fingerprint is a sketch of ``CELLS``
cells (count, xor of digests, xor of their checks), in which every digest is in three, one in each third; the number of
digests and a digest of the text stand before them. Two versions are compared by subtracting the cells of their
fingerprints, which leaves the digests that only one of them has. Peeling goes by thirds: each cell of the third that
holds a single digest gives it up, and it goes from its two other cells. Where cells are left after ``PASSES``, or the
cells show that the difference is too large for them, both sketches are made again, sized by the difference that the
cells let expect, and twice as large each time that they fail again. The likeness is the Jaccard similarity that the
recovered difference gives.

Fingerprints are made, subtracted and peeled within their rows. In larger sketches cells are rows, grouped by document and
cell; documents are dealt once and all groupings stay within that dealing, so peeling shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, documents, narrow, saved

#: Cells of a fingerprint's third (a digest's three places are bits of a long, so 21 at most), and passes of peeling.
THIRD, PASSES = 16, 12
#: Of a larger sketch: cells of a third for each digest that is expected to differ, and how many times as many at each retry.
LOAD, GROWTH = 0.7, 2
#: Digests for each cell of a fingerprint beyond which peeling isn't tried.
MOST_LOAD = 0.8
#: Pairs that are to be tried again, up to which their keys are broadcast.
BROADCAST = 100_000
#: Rows of a bucket, about; quantiles at which ids are cut, and the most even parts between them.
ROWS, CUTS, FINE = 2000, 64, 1 << 14

_SENTENCE = r"\n+|(?<=[.!?])[ \t]+"
_CHECK = 0x5BD1E995
_KEYS = ["bucket", "place"]
_CELL = "struct<n:int,d:bigint,c:bigint>"


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; what is all spaces is none."""
    parts = F.filter(F.split(text, _SENTENCE), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    """32 bits that tell a digest from a xor of several."""
    return F.xxhash64(digest, F.lit(_CHECK)).bitwiseAND(F.lit(0xFFFFFFFF))


def _place(digest: Column, third: Column, k: int) -> Column:
    """A digest's cell in the ``k``-th third."""
    return F.pmod(F.xxhash64(digest, F.lit(k)), third) + third * F.lit(k)


def bound(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _mask(digest: Column) -> Column:
    """A digest's three places in a fingerprint, as bits."""
    one, third = F.lit(1).cast("long"), F.lit(THIRD).cast("long")
    bits = [F.call_function("shiftleft", one, _place(digest, third, k).cast("int")) for k in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _is_at(mask: Column, place: Column) -> Column:
    return F.call_function("shiftright", mask, place.cast("int")).bitwiseAND(F.lit(1)) == 1


def _xor(rows: Column, field: str) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x[field]))


def _cell(n: Column, d: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), d.alias("d"), c.alias("c"))


def cells(of: Column) -> Column:
    """The cells of a fingerprint, of an array of distinct digests."""
    placed = F.transform(of, lambda d: F.struct(d.alias("d"), _check(d).alias("c"), _mask(d).alias("m")))
    places = F.sequence(F.lit(0), F.lit(3 * THIRD - 1))
    at = lambda rows, i: bound(F.filter(rows, lambda p: _is_at(p["m"], i)), lambda own: _cell(F.size(own), _xor(own, "d"), _xor(own, "c")))
    return bound(placed, lambda rows: F.transform(places, lambda i: at(rows, i)))


def _hexed(x: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(x), width, "0"))


def packed(text: Column, of: Column, made: Column) -> Column:
    """The fingerprint's two parts: a digest of the text with the number of digests, and the cells as bytes."""
    shown = F.transform(made, lambda x: F.concat(_hexed(x["n"].cast("long"), 4), _hexed(x["d"], 16), _hexed(x["c"], 8)))
    return F.struct(F.concat_ws(":", _hexed(F.xxhash64(text), 16), F.lower(F.hex(F.size(of)))).alias("head"), F.unhex(F.array_join(shown, "")).alias("cells"))


def written(parts: Column) -> Column:
    """The fingerprint as it is reported, with the cells in hex: count (4 digits), xor (16) and check (8) of each."""
    return F.concat_ws(":", parts["head"], F.lower(F.hex(parts["cells"])))


def less(x: Column, y: Column) -> Column:
    """Cells of one fingerprint less those of another."""
    return F.zip_with(x, y, lambda a, b: _cell(a["n"] - b["n"], a["d"].bitwiseXOR(b["d"]), a["c"].bitwiseXOR(b["c"])))


def expected(apart: Column, x: Column, y: Column) -> Column:
    """How many digests only one of two texts has, about, from subtracted cells and both numbers of digests.

    A third's counts have the variance of as many random throws of one, beside what the difference in numbers gives.
    """
    squares = F.aggregate(apart, F.lit(0.0), lambda a, z: a + z["n"] * z["n"]) / 3
    return F.greatest(F.abs(x - y).cast("double"), (squares - (x - y) * (x - y) / F.lit(float(THIRD))) / (1 - 1 / max(2, THIRD)))


def peeled_cells(apart: Column, passes: int) -> Column:
    """found (the digests that only one of two texts has) and whole (whether no cell is left) of subtracted cells."""

    def step(state: Column, k: Column) -> Column:
        third = F.slice(state["cells"], k * THIRD + 1, F.lit(THIRD))
        single = F.filter(third, lambda x: (F.abs(x["n"]) == 1) & (x["c"] == _check(x["d"])))
        single = F.transform(single, lambda x: F.struct(x["n"].alias("n"), x["d"].alias("d"), x["c"].alias("c"), _mask(x["d"]).alias("m")))

        def taken(own: Column) -> Column:
            def left(x: Column, i: Column) -> Column:
                here = F.filter(own, lambda s: _is_at(s["m"], i))
                return bound(here, lambda h: _cell(x["n"] - F.aggregate(h, F.lit(0), lambda a, s: a + s["n"]), x["d"].bitwiseXOR(_xor(h, "d")), x["c"].bitwiseXOR(_xor(h, "c"))))

            held = F.when(F.size(own) == 0, state["cells"]).otherwise(F.transform(state["cells"], left)).cast(f"array<{_CELL}>")
            return F.struct(held.alias("cells"), (state["found"] + F.size(own)).cast("int").alias("found"))

        return bound(single, taken)

    start = F.struct(apart.cast(f"array<{_CELL}>").alias("cells"), F.lit(0).alias("found"))
    turns = F.array(*[F.lit(i % 3) for i in range(passes)])
    whole = lambda x: ~F.exists(x["cells"], lambda z: (z["n"] != 0) | (z["d"] != 0) | (z["c"] != 0))
    return F.aggregate(turns, start, step, lambda x: F.struct(x["found"].alias("found"), whole(x).alias("whole")))


def _row(cell: Column, n: Column, digest: Column, check: Column) -> Column:
    return F.struct(cell.cast("long").alias("cell"), n.cast("long").alias("n"), digest.alias("d"), check.alias("c"))


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the same place put together; those without anything go. Place -1 holds the count of what was found."""
    out = rows.groupBy(*keys, "third", "cell").agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"))
    return out.where("cell = -1 or n <> 0 or d <> 0 or c <> 0")


def subtracted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys, third, n (1: the first version's, -1: the second's), d (digest). The cells of the first sketch less the second."""
    d, third = F.col("d"), F.col("third")
    places = F.array(*[_row(_place(d, third, k), F.col("n"), d, _check(d)) for k in range(3)])
    return _summed(rows.select(*keys, "third", F.inline(places)), keys)


def peeled(made: DataFrame, keys: list[str], passes: int = PASSES) -> DataFrame:
    """keys, found (the digests that only one version has) and left (cells that couldn't be told) of subtracted cells."""
    for step in range(passes):
        k = step % 3
        third, n, d, c = F.col("third"), F.col("n"), F.col("d"), F.col("c")
        single = (F.col("cell") >= third * k) & (F.col("cell") < third * (k + 1)) & (F.abs(n) == 1) & (c == _check(d))
        nothing = F.lit(0).cast("long")
        out = F.array(_row(F.lit(-1), F.lit(1), nothing, nothing), *[_row(_place(d, third, j), -n, d, c) for j in range(3) if j != k])
        made = _summed(made.select(*keys, "third", F.inline(F.when(single, out).otherwise(F.array(_row(F.col("cell"), n, d, c))))), keys)
    return made.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("cell") < 0, F.col("n"))), F.lit(0)).alias("found"), F.count(F.when(F.col("cell") >= 0, 1)).alias("left"))


def differing(pairs: DataFrame, keys: list[str], growth: int = 1, passes: int = PASSES) -> DataFrame:
    """pairs: keys, x and y (arrays of distinct digests), dealt by some of the keys, and ``third``, if sketches aren't to be sized by both numbers.

    keys, found and left of each pair that differs.
    """
    sign = lambda n: lambda d: F.struct(F.lit(n).alias("n"), d.alias("d"))
    third = F.col("third") if "third" in pairs.columns else F.greatest(F.lit(THIRD), F.size("x") + F.size("y"))
    rows = pairs.select(*keys, (third.cast("long") * growth).alias("third"), F.inline(F.concat(F.transform("x", sign(1)), F.transform("y", sign(-1)))))
    return peeled(subtracted(rows, keys), keys, passes)


def _buckets(rows: DataFrame) -> Column:
    """A number that grows with (id, row) and is the same for some ``ROWS`` rows; null ids are below all others.

    Ids are cut at ``CUTS`` quantiles, and evenly between them, so there are at most ``CUTS * FINE`` buckets, and ``FINE`` of null ids.
    """
    held = rows.agg(F.count("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    if not held.n:
        low = [0.0, 1.0]
    else:
        marks = rows.where("id is not null").select(F.col("id").cast("double").alias("id")).approxQuantile("id", [i / CUTS for i in range(1, CUTS)], 0.01) if held.n > ROWS else []
        low = sorted({float(held.low), *marks, float(held.high) + 1})
    fine = max(1, min(FINE, -(-held.n // (ROWS * (len(low) - 1)))))
    edges = F.array(*[F.lit(x) for x in low])
    at = F.least(F.size(F.filter(edges, lambda x: x <= F.col("id"))), F.lit(len(low) - 1))
    start, stop = F.element_at(edges, at), F.element_at(edges, at + 1)
    within = F.least(F.floor((F.col("id") - start) / (stop - start) * fine), F.lit(fine - 1))
    nulls = F.shiftright("row", 54) - F.lit(512)  # of the hash, from -1024 to -1
    return F.when(F.col("id").isNull(), nulls).otherwise(at * F.lit(FINE) + within).cast("long")


def followed(rows: DataFrame) -> DataFrame:
    """rows: id, row, text; those with bucket, place and ``after``, the next text by descending id (then row), the first one's after the last.

    Texts are shuffled once, by bucket. The first row of each bucket is sent, as a ghost, to the bucket before it as well;
    for that the buckets' first keys are broadcast, of which there are at most ``(CUTS + 1) * FINE``. A single row follows itself.
    """
    dealt = rows.withColumn("bucket", _buckets(rows))
    first = saved(dealt.groupBy("bucket").agg(F.max(F.struct("id", "row")).alias("head")), "heads")
    order = Window.orderBy(F.col("bucket").desc())
    every = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ghosts = first.select(F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(every)).alias("to"), F.col("head.id").alias("gid"), F.col("head.row").alias("grow"))
    copied = rows.join(F.broadcast(ghosts), F.col("id").eqNullSafe(F.col("gid")) & (F.col("row") == F.col("grow"))).select("id", "row", "text", F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    within = Window.partitionBy("bucket").orderBy("ghost", F.col("id").desc_nulls_last(), F.col("row").desc())
    both = dealt.withColumn("ghost", F.lit(False)).unionByName(copied)
    return both.withColumns({"after": F.lead("text").over(within), "place": F.row_number().over(within)}).where("not ghost")


def edited(text: Column, after: Column) -> Column:
    """The text with its last half of code points replaced by as many (or all) from the start of the next."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))


def compared(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The likenesses are those of a row's fingerprint to the edited text's and to the next row's. A null text is empty. Two
    texts without a paragraph are alike (1), one with and one without aren't (0). Rows are in order of descending key, null
    keys last, equal keys by a hash of their texts, so that of repeated rows one follows the other. An empty table gives an
    empty one; only the two named columns are read.
    """
    rows = narrow(df, id=key, text=text).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    both = followed(rows).select(*_KEYS, "id", "text", "after").withColumn("edited", edited(F.col("text"), F.col("after")))
    both = both.withColumns({"a": digests(F.col("text")), "b": digests(F.col("edited")), "c": digests(F.col("after"))})
    both = both.withColumns({f"{x}_cells": cells(F.col(x)) for x in "abc"})

    def tried(y: str) -> Column:
        """What the fingerprints themselves give: how many digests differ, whether all were found, or else how many are expected."""
        much = lambda z: expected(z, F.size("a"), F.size(y))
        nothing = F.struct(F.lit(0).alias("found"), F.lit(False).alias("whole"))
        got = lambda z: F.when(much(z) <= MOST_LOAD * 3 * THIRD, peeled_cells(z, PASSES)).otherwise(nothing)
        return bound(less(F.col("a_cells"), F.col(f"{y}_cells")), lambda z: F.struct(got(z).alias("got"), much(z).alias("much")))

    both = both.withColumns({"by_b": tried("b"), "by_c": tried("c")})
    again = {y: ~F.col(f"by_{y}.got.whole") for y in "bc"}
    made = saved(
        both.select(
            *_KEYS, "id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), packed(F.col("text"), F.col("a"), F.col("a_cells")).alias("own"),
            packed(F.col("edited"), F.col("b"), F.col("b_cells")).alias("other"), *[F.size(x).alias(f"n_{x}") for x in "abc"], *[F.when(again[y], F.lit(None)).otherwise(F.col(f"by_{y}.got.found")).alias(f"found_{y}") for y in "bc"],
            *[F.col(f"by_{y}.much").alias(f"much_{y}") for y in "bc"], F.when(again["b"] | again["c"], F.col("a")).alias("a"), *[F.when(again[y], F.col(y)).alias(y) for y in "bc"],
        ),
        "fingerprints",
    )
    keys = [*_KEYS, "pair"]
    third = lambda y: F.greatest(F.lit(THIRD), F.ceil(F.col(f"much_{y}") * LOAD)).cast("long").alias("third")
    pair = lambda i, y: F.when(F.col(y).isNotNull(), F.struct(F.lit(i).alias("pair"), F.col("a").alias("x"), F.col(y).alias("y"), third(y)))
    pairs = made.where("a is not null").select(*_KEYS, F.inline(F.filter(F.array(pair(0, "b"), pair(1, "c")), lambda x: x.isNotNull())))
    found, growth, kept = None, 1, None
    while True:
        # dealt by the whole key; the groupings by key and cell that follow find their rows together
        got = saved(differing(pairs.repartition(*_KEYS), keys, growth), "peeled")
        whole = got.where("left = 0").select(*keys, "found")
        found = whole if found is None else found.unionAll(whole)
        failed = got.where("left > 0").select(*keys)
        many = failed.count()
        if not many:
            break
        # what failed is taken out: each round is of its own size, not of the first one's
        left = saved(pairs.join(F.broadcast(failed) if many <= BROADCAST else failed.hint("merge"), keys), "failed")
        if kept is not None:
            discard(kept)
        pairs, kept, growth = left, left, growth * GROWTH
    counts = found.groupBy(*_KEYS).agg(*[F.sum(F.when(F.col("pair") == i, F.col("found"))).alias(f"more_{y}") for i, y in enumerate("bc")])

    def likeness(y: str) -> Column:
        total, apart = F.col("n_a") + F.col(f"n_{y}"), F.coalesce(f"found_{y}", f"more_{y}", F.lit(0))
        return F.when(total == 0, F.lit(1.0)).otherwise((total - apart) / (total + apart))

    kept = made.select(*_KEYS, "id", "n_chars", "edited_sha256", "own", "other", "n_a", "n_b", "n_c", "found_b", "found_c", F.col("a").isNotNull().alias("again"))
    # only what was tried again meets what that gave, by a merge at any size
    nothing = F.lit(None).cast("long")
    out = kept.where("not again").withColumns({"more_b": nothing, "more_c": nothing}).unionByName(kept.where("again").join(counts.hint("merge"), _KEYS, "left"))
    shown = [written(F.col(x)).alias(name) for x, name in (("own", "fingerprint"), ("other", "edited_fingerprint"))]
    return out.select(F.col("id").alias(key), "n_chars", "edited_sha256", *shown, likeness("b").alias("near_edited"), likeness("c").alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))
