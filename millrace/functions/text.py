"""Paths, file classes, normal forms and line statistics as column expressions."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File kinds by suffix.
SOURCE_SUFFIXES = ".ts .tsx .js .jsx .mjs .cjs .py .go .rs .css .scss".split()
DOC_SUFFIXES = ".md .mdx .txt .rst".split()
DATA_SUFFIXES = ".json .yml .yaml .toml .sql".split()
SCRIPT_SUFFIXES = ".ts .tsx .js .jsx .mjs .cjs".split()

#: Suffixes that a reference may leave out.
REFERENCE_SUFFIXES = ".ts .tsx .js .jsx .mjs .cjs .css .scss .json".split()

#: Files that shouldn't be kept, and folders that aren't walked.
JUNK_NAMES = ".DS_Store Thumbs.db npm-debug.log yarn-error.log .env.local.bak".split()
JUNK_SUFFIXES = ".orig .rej .bak .tmp .swp .pyc .log".split()
JUNK_FOLDERS = "node_modules .git .next dist build coverage .turbo .cache out .venv __pycache__".split()

#: Paths that no finding is about.
IGNORED_NAMES = (
    "*.lock *-lock.json package-lock.json yarn.lock pnpm-lock.yaml *.min.js *.min.css *.map *.snap *.svg *.ico *.png *.jpg *.jpeg "
    "*.gif *.webp *.woff* *.ttf *.pdf *.mp4 *.mov *.zip *.gz CHANGELOG* *.generated.* *.gen.ts *.d.ts"
).split()
IGNORED_FOLDERS = "vendor third_party third-party .vendor generated __generated__ .generated".split()
VENDORED_FOLDERS = ".claude/skills .claude/plugins .cursor".split()

#: Files that are run or found by name, not imported.
ENTRY_STEMS = (
    "page layout route loading error not-found template middleware next.config tailwind.config vitest.config playwright.config "
    "postcss.config eslint.config jest.config index main globals instrumentation opengraph-image sitemap robots manifest head "
    "default global-error setup conftest"
).split()
TEST_PARTS = ".test. .spec. .stories. .bench. .e2e. _test.".split()
TEST_FOLDERS = "tests test __tests__ e2e cypress .storybook".split()
SCRIPT_FOLDERS = "scripts .claude bin tools tasks .github".split()

#: What generated files say of themselves.
GENERATED_MARKS = ("@generated", "do not edit", "auto-generated", "autogenerated", "code generated", "this file is generated", "generated by")

HEAD_CHARS, SAMPLE_CHARS = 1500, 4000
LONG_LINE, MEAN_LINE = 2000, 350

_LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: A commented-out line of code, an import, a token.
_CODE_COMMENT = r"(?U)^\s*(//|#)\s*[\w{}()\[\];=<>.\"'`]"
IMPORT = r"""(?:from\s+|require\(\s*|import\(\s*|import\s+)['"]([^'"]+)['"]"""
TOKEN = r"[A-Za-z0-9_\-./@]+"
#: A character that is in no token.
_OUT = r"[^A-Za-z0-9_\-./@]"


def any_of(parts: list[str]) -> str:
    return "|".join(re.escape(p) for p in parts)


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def area_of(path: Column) -> Column:
    """The first folder, `.` for a file at the top."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")


def folder_of(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def suffix_of(path: Column) -> Column:
    """Lower case, with its dot; empty for none or for a name that only begins with one."""
    return F.lower(F.regexp_extract(name_of(path), r"[^.]\.*(\.[^.]+)$", 1))


def stem_of(path: Column) -> Column:
    """The name up to its last dot, all of it if there is none."""
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def in_folder(path: Column, folders: list[str]) -> Column:
    return F.concat(F.lit("/"), path).rlike(f"/(?:{any_of(folders)})/")


def glob_regex(globs: list[str]) -> str:
    """One expression for shell patterns, for a whole string."""
    return "^(?:" + "|".join(_java(fnmatch.translate(g)) for g in globs) + ")$"


def _java(translated: str) -> str:
    return re.sub(r"\\[Zz]$", "", translated)


def is_junk(path: Column) -> Column:
    return name_of(path).isin(JUNK_NAMES) | suffix_of(path).isin(JUNK_SUFFIXES)


def is_ignored(path: Column, more: list[str] | None = None) -> Column:
    out = in_folder(path, IGNORED_FOLDERS) | name_of(path).rlike(glob_regex(IGNORED_NAMES))
    if more:
        out = out | name_of(path).rlike(glob_regex(more)) | path.rlike(glob_regex(more))
    return out


def is_vendored(path: Column) -> Column:
    return in_folder(path, VENDORED_FOLDERS)


def is_test(path: Column) -> Column:
    return name_of(path).rlike(any_of(TEST_PARTS)) | in_folder(path, TEST_FOLDERS)


def is_config(stem: Column) -> Column:
    return stem.isin(ENTRY_STEMS) | stem.endswith(".config") | stem.startswith(".")


def is_script_area(path: Column) -> Column:
    return in_folder(path, SCRIPT_FOLDERS)


def has_mark(text: Column, marks: tuple[str, ...] = GENERATED_MARKS) -> Column:
    """Whether the head of a text says one of the marks."""
    return F.lower(F.substring(text, 1, HEAD_CHARS)).rlike(any_of(list(marks)))


def bound(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(text: Column) -> Column:
    """Lines as Python splits them, without an empty one at the end."""
    return bound(F.split(text, _LINE_ENDS), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def longest_line(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(lines_of(text), F.length)), F.lit(0))


def _mean(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / F.greatest(F.lit(1), F.size(lines))


def mean_line(text: Column) -> Column:
    """Characters of the lines by their number; a text without lines counts as one line."""
    return bound(lines_of(text), _mean)


def is_minified(text: Column) -> Column:
    head = F.substring(text, 1, SAMPLE_CHARS)
    long = bound(lines_of(head), lambda x: F.exists(x, lambda y: F.length(y) > LONG_LINE) | (_mean(x) > MEAN_LINE))
    return (F.length(head) > 0) & long


def digest_of(content: Column) -> Column:
    """The digest of a file's bytes; of a text, those of its UTF-8."""
    return F.sha1(content)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def longest_run(items: Column, inside) -> Column:  # noqa: ANN001
    """The most items in a row for which ``inside`` holds."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(inside(x), a.run + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(a.best, run).alias("best"))

    return F.aggregate(items, start, step, lambda a: a.best)


def dead_code_run(text: Column) -> Column:
    return longest_run(lines_of(text), lambda x: x.rlike(_CODE_COMMENT) & ~x.rlike(r"(?U)^\s*\*"))


def normal_source(text: Column) -> Column:
    """The lines that carry structure: no blanks, comments or imports; spaces collapsed, lower case, order kept."""
    strip = F.transform(lines_of(text), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    kept = F.filter(strip, lambda x: (x != "") & ~x.rlike(r"^(//|#|\*|/\*|import |export \{|from )"))
    return F.array_join(F.transform(kept, lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", " "))), "\n")


def normal_command(command: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(command, r"(?U)\s+", " ")), 1, 160)


def imports_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IMPORT), F.lit(1))


def naming_tokens(text: Column) -> Column:
    """The tokens of those lines that name a path or a script file; the others, which are most, aren't taken apart."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.instr(x, "/") > 0) | ((F.instr(x, ".") > 0) & x.rlike(any_of(SCRIPT_SUFFIXES))))
    return F.split(F.array_join(lines, "\n"), rf"{_OUT}+")


def path_tokens(tokens: Column) -> Column:
    """The tokens that have a slash."""
    return F.filter(tokens, lambda t: F.instr(t, "/") > 0)


def file_stems(tokens: Column) -> Column:
    """The stems of tokens without a slash that name a script file."""
    named = F.filter(tokens, lambda t: (F.instr(t, ".") > 0) & (F.instr(t, "/") == 0) & t.rlike(rf"(?:{any_of(SCRIPT_SUFFIXES)})$"))
    return F.transform(named, lambda t: F.regexp_replace(t, rf"(?:{any_of(SCRIPT_SUFFIXES)})$", ""))


def normal_reference(token: Column) -> Column:
    """A path-like token, trimmed, without leading dots, @ and slashes and without a known suffix; null where it has no slash or nothing is left."""
    token = F.trim(token)
    bare = F.regexp_replace(token, r"^(?:\./|\.\./)+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "^@+", ""), "^/+", "")
    bare = F.regexp_replace(bare, rf"(?:{any_of(REFERENCE_SUFFIXES)})$", "")
    return F.when(F.instr(token, "/") > 0, bound(bare, lambda x: F.when(x != "", x)))
