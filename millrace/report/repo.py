"""The repository report: inventory, copies, orphans, findings, health."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import repo as R
from millrace.operators import rules
from millrace.sources import files


@dataclass
class Scan:
    """What the operators find in a tree, each a DataFrame."""

    files: DataFrame
    copies: DataFrame
    near: DataFrame
    orphans: DataFrame

    def findings(self) -> DataFrame:
        return rules.repo_findings(self.files, self.copies, self.near, self.orphans)

    def summary(self) -> DataFrame:
        return rules.summary(self.files, self.copies, self.orphans)


def scanned(found: DataFrame, references: list[str] | None = None) -> Scan:
    """found: ``repo.features`` of a tree, held by the caller, as each part reads it."""
    refs, bare = R.references(found, references)
    exact = R.copies(found)
    return Scan(found, exact, R.near_copies(found, exact), R.unreferenced(found, refs, bare))


def scan(tree: DataFrame, ignore: list[str] | None = None, references: list[str] | None = None) -> Scan:
    """The content is read once: what comes of it is held, in memory or on disk, for all that follows."""
    return scanned(R.features(tree, ignore).persist(), references)


def report(spark: SparkSession, repo: str, top: int = 12) -> dict[str, Any]:
    """The report of a local tree. What comes to the driver are counts, findings and the first few paths that they name."""
    found = scan(files.tree(spark, repo), files.ignore_list(repo), files.package_references(repo))
    exact, orphans = found.copies.persist(), found.orphans.persist()
    found = Scan(found.files, exact, R.near_copies(found.files, exact), orphans)
    try:
        counts = found.summary().first().asDict()
        largest = R.largest(found.files).first()
        return {
            "repo": os.path.abspath(repo), "health_score": counts.pop("health_score"), "summary": counts | {"largest_file": largest.path if largest else "-", "largest_bytes": largest["size"] if largest else 0},
            "size_by_area": [{"label": r.area, "bytes": r.bytes} for r in R.size_by_area(found.files, top).collect()],
            "findings": [{k: v for k, v in r.asDict().items() if k != "pos"} for r in found.findings().orderBy(*rules.by_locations()).collect()],
        }
    finally:
        for held in (exact, orphans, found.files):
            held.unpersist()
