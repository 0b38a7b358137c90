"""Recovery of comments from pairs of revisions, and evidence from wikitext, over conversations written as discussion pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import comments, wikitext
from ..sources import utterances
from .registry import register

#: Turns before the newest on a page.
BEFORE = 3


def _comment(text: Column, role: Column, turn: Column) -> Column:
    """A turn as a signed comment: on one line, under a heading, with a time of its own."""
    even = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s=\[\]{}~<>]+", " ")
    when = F.concat(F.lpad((turn % 24).cast("string"), 2, "0"), F.lit(":05, "), (turn % 28 + 1).cast("string"), F.lit(" January 2020 (UTC)"))
    return F.concat(F.lit("== topic ==\n"), F.trim(even), F.lit(" [[User:"), role, F.lit("]] "), when, F.lit("\n"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, role, body, before, after): each turn added to a page of the few turns before it, so that no case is gathered as a whole."""
    u = utterances(spark, sf_dir).withColumn("c", _comment(F.col("text"), F.col("role"), F.col("turn")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.concat(*[F.coalesce(F.lag("c", k).over(w), F.lit("")) for k in range(BEFORE, 0, -1)])
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s=\[\]{}~<>]+", " "))
    return u.select("id", "role", body.alias("body"), before.alias("before"), F.concat(before, "c").alias("after"))


def recover(row) -> dict:
    """One revision: its changes, the page's comments, those that the changes touch, and the comment that the action made."""
    spans = comments.changed_spans(row.before, row.after)
    if spans is None:
        return {"n_comments": 0, "n_spans": 0, "status": "b_unavailable", "same": False, "contamination": "unknown", "identity": None}
    found = comments.comments(row.after)
    after = [(a, b) for kind, _, _, a, b in spans if kind != "delete"]
    allowed = {i for i, _, _ in comments.localized(row.after, found, after)}
    action = {"kind": "creation", "text": row.body, "spans": after, "speaker": row.role, "allowed": allowed}
    status, at, warning = comments.assign(1, comments.edges([action], row.after, found))[0]
    one = found[at] if at is not None else None
    body = one.body(row.after) if one else ""
    return {
        "n_comments": len(found),
        "n_spans": len(spans),
        "status": status if status == "assigned" else warning or status,
        "same": body.strip() == row.body.strip(),
        "contamination": comments.contamination_status(row.after, one, found),
        "identity": comments.identity_mode(body, row.body) if one else None,
    }


@register("revision_recovery")
def revision_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn found again as the comment that its revision added."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"id": r.id, **recover(r)} for r in b.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["id", "n_comments", "n_spans", "status", "same", "contamination", "identity"])

    return revisions(spark, sf_dir).mapInPandas(run, "id string, n_comments long, n_spans long, status string, same boolean, contamination string, identity string")


@register("wikitext_evidence")
def wikitext_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each link of a page, with its place, beside the page's signature evidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                sign, shown = wikitext.signature(r.after), wikitext.visible(r.after)
                common = (sign["status"], sign["user"], sign["time"], len(comments.timestamp_regions(r.after)), len(shown), ",".join(wikitext.structural_flags(r.after)), comments.anchored(r.body, r.after, r.before))
                rows += [(r.id, x["start"], x["end"], x["kind"], x["target"], *common) for x in wikitext.links(r.after)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _EVIDENCE.split(", ")])

    return revisions(spark, sf_dir).mapInPandas(run, _EVIDENCE)


_EVIDENCE = "id string, start long, end long, kind string, target string, signature string, user string, time string, n_regions long, n_visible long, flags string, anchored string"
