"""Source-tree hygiene: file classes, copies, references and files that nothing refers to.

files: path, size, content (null unless it is text to be read), digest, is_changed. The class of a file is one ordered
chain, and what refers to what is read of every readable file, generated and vendored ones included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.usage import ratio
from millrace.operators.findings import top_per_group

JUNK, IGNORED, UNREAD, GENERATED, VENDORED, TARGET = range(6)
#: Sizes and counts from which something is reported.
COPY_BYTES, NEAR_COPY_BYTES, MANY_LINES, MANY_COMMENTS, MANY_FOLDERS = 200, 800, 700, 10, 4


def classified(files: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """With name parts and ``class``, one of the numbers above; findings are about TARGET files."""
    path, content = F.col("path"), F.col("content")
    readable = content.isNotNull() & (F.length(content) > 0)
    kind = (
        F.when(T.is_junk(path), JUNK).when(T.is_ignored(path, ignore), IGNORED).when(~F.coalesce(readable, F.lit(False)), UNREAD)
        .when(T.has_mark(content) | T.is_minified(content), GENERATED).when(T.is_vendored(path), VENDORED).otherwise(TARGET)
    )
    parts = {"suffix": T.suffix_of(path), "stem": T.stem_of(path), "area": T.area_of(path), "folder": T.folder_of(path)}
    return files.withColumns(parts).withColumn("class", kind)


def is_source() -> Column:
    return F.col("suffix").isin(T.SOURCE_SUFFIXES)


def is_target() -> Column:
    return (F.col("class") == TARGET) & is_source()


def features(files: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Everything that the operators below need of a file, made in one reading of its content, which goes.

    norm: a digest of the normal form of larger source files; lines and dead_run of source files; runs: begins as a
    script; named: the paths (refs) and file stems (bare) that it names.
    """
    held = classified(files, ignore)
    content, source = F.col("content"), is_target()
    imported = F.filter(T.imports_of(content), lambda x: F.instr(x, "/") > 0)
    norms = lambda t: F.array_distinct(F.transform(F.array_distinct(F.concat(imported, T.path_tokens(t))), T.normal_reference))
    both = T.bound(T.naming_tokens(content), lambda t: F.struct(F.filter(norms(t), lambda x: x.isNotNull()).alias("refs"), F.array_distinct(T.file_stems(t)).alias("bare")))
    normal = T.normal_source(content)
    made = {
        "norm": F.when(source & (F.col("size") >= NEAR_COPY_BYTES), T.bound(normal, lambda x: F.when(x != "", F.sha1(F.encode(x, "utf-8"))))),
        "lines": F.when(source, T.line_count(content)), "dead_run": F.when(source, T.dead_code_run(content)), "runs": source & content.startswith("#!"),
        "named": F.when(F.col("class") >= GENERATED, both),
    }
    return held.withColumns(made).drop("content")


def references(found: DataFrame, more: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(stem, norm) of paths that files refer to, and the stems that they name by file name. ``more``: further path tokens."""
    norm = found.select(F.explode("named.refs").alias("norm"))
    if more:
        norm = norm.unionAll(found.sparkSession.createDataFrame([(m,) for m in more], "token string").select(T.normal_reference(F.col("token"))))
    norm = norm.where("norm is not null")
    return norm.select(F.substring_index("norm", "/", -1).alias("stem"), "norm").distinct(), found.select(F.explode("named.bare").alias("stem")).distinct()


def resolves(bare_path: Column, norm: Column) -> Column:
    """Whether a reference names a path (without suffix): one is the other's end, by whole folders."""
    return (bare_path == norm) | bare_path.endswith(F.concat(F.lit("/"), norm)) | norm.endswith(F.concat(F.lit("/"), bare_path))


def unreferenced(found: DataFrame, refs: DataFrame, bare: DataFrame) -> DataFrame:
    """path and whether it is a script, of source files that nothing refers to. Filters go first: what is run by name never meets the joins.

    The joins are anti joins on the stem, which keeps them hash or merge joins; whether a reference resolves is a residual.
    """
    path = F.col("path")
    own = found.where(is_target()).where(~(T.is_test(path) | T.is_config(F.col("stem")) | F.col("runs") | F.col("is_changed")))
    own = own.select("path", "stem", F.regexp_replace(path, r"(?<=.)\.[^./]*$", "").alias("whole"))
    left = own.alias("o").join(bare.alias("b"), F.col("o.stem") == F.col("b.stem"), "left_anti")
    left = left.alias("o").join(refs.alias("r"), (F.col("o.stem") == F.col("r.stem")) & resolves(F.col("o.whole"), F.col("r.norm")), "left_anti")
    return left.select("path", T.is_script_area(F.col("path")).alias("is_script"))


def _copied(found: DataFrame, least: int = COPY_BYTES) -> DataFrame:
    return found.where((F.col("class") == TARGET) & (F.col("size") >= least))


def copies(found: DataFrame, least: int = COPY_BYTES) -> DataFrame:
    """digest, n, size, first (path) and whether the first is a document, of files with equal bytes."""
    own = _copied(found, least).select("digest", "path", "size", "suffix")
    groups = own.groupBy("digest").agg(F.count("*").alias("n"), F.min_by("size", "path").alias("size"), F.min("path").alias("first"), F.min_by("suffix", "path").alias("suffix")).where("n > 1")
    return groups.withColumn("is_doc", F.col("suffix").isin(T.DOC_SUFFIXES)).drop("suffix")


def near_copies(found: DataFrame, exact: DataFrame) -> DataFrame:
    """suffix, norm, n and first (path) of source files of one suffix with the same normal form, unless all of them are in groups of exact copies."""
    own = found.where("norm is not null").select("path", "digest", "suffix", "norm")
    marked = own.join(exact.select("digest", F.lit(True).alias("is_exact")), "digest", "left")
    groups = marked.groupBy("suffix", "norm").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("is_exact", F.lit(False))).alias("all_exact"), F.min("path").alias("first"))
    return groups.where("n > 1 and not all_exact").drop("all_exact")


def members(found: DataFrame, few: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """first and paths, the first ``most`` of each group in ``few`` (a handful of groups: keys, first). Cut before the shuffle."""
    own = (_copied(found) if keys == ["digest"] else found.where("norm is not null")).select(*keys, "path")
    top = top_per_group(own.join(F.broadcast(few.select(*keys, "first")), keys), keys, [F.col("path")], most)
    return top.groupBy("first").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def scattered(found: DataFrame, least: int = MANY_FOLDERS) -> DataFrame:
    """Stems of source files in ``least`` folders or more."""
    return found.where(is_target()).groupBy("stem").agg(F.count_distinct("folder").alias("folders")).where(F.col("folders") >= least)


def notable(found: DataFrame) -> DataFrame:
    """path, lines and dead_run of source files that are very long or have a long run of commented-out lines."""
    return found.where(f"lines >= {MANY_LINES} or dead_run >= {MANY_COMMENTS}").select("path", "lines", "dead_run")


def inventory(found: DataFrame) -> DataFrame:
    """One row: counts and bytes over all files."""
    return found.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("class") == JUNK).alias("junk"),
        F.coalesce(F.sum(F.when(F.col("class") == JUNK, F.col("size"))), F.lit(0)).alias("junk_bytes"), F.count_if(F.col("class") == GENERATED).alias("excluded_generated"),
        F.count_if(is_target()).alias("scanned_source"), F.max("size").alias("largest_bytes"),
    )


def largest(classed: DataFrame) -> DataFrame:
    """path and size of the largest file, the first by path where several are."""
    return classed.select("path", "size").orderBy(F.col("size").desc(), "path").limit(1)


def size_by_area(classed: DataFrame, n: int) -> DataFrame:
    return classed.groupBy("area").agg(F.sum("size").alias("bytes")).orderBy(F.col("bytes").desc(), "area").limit(n)


def health_score(junk: Column, orphans: Column, groups: Column, reclaimable: Column, total: Column) -> Column:
    """100 less penalties for junk (copies count here too), files that nothing refers to, copies, and bytes to be saved."""
    #: The most that a penalty takes, and what one of its kind takes.
    taken = [F.least(F.lit(float(most)), rate * what) for most, rate, what in ((30, 4, junk), (18, 1.5, orphans), (16, 3, groups), (12, 100, ratio(reclaimable, total)))]
    return F.bround(F.greatest(F.lit(0.0), F.lit(100.0) - sum(taken[1:], taken[0])), 1)
