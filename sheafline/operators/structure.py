"""Order-dependent document work as joins and windows: notes, anchors, grids, header votes, jobs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.text import value_kind
from sheafline.operators.rounds import stages


def numbered_notes(references: DataFrame) -> DataFrame:
    """Note numbers of a document in the order of first reference.

    Takes ``doc_id, position, note_id``; a document's notes are ranked together.
    """
    first = references.groupBy("doc_id", "note_id").agg(F.min("position").alias("first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "note_id"))).select("doc_id", "note_id", "number")


def nested_notes(notes: DataFrame, references: DataFrame) -> DataFrame:
    """``doc_id, note_id, number, definition`` of each note that is shown, in reading order through notes in notes.

    ``notes`` has ``doc_id, note_id, position, text``; ``references`` has ``doc_id,
    inside`` (the note that holds it, null: the body), ``position, note_id``.  A
    note is read where it is first referred to, before what follows there; blank
    notes are passed over with all that they refer to, and notes that nothing
    read refers to come last, in their own order.  Of several notes of one id the
    first that isn't blank counts.

    A note's place is its path: the positions of the references that lead to it.
    The least path is that of its first visit, since a shorter path is less than
    its own extensions.  Rounds extend the paths that the last round has
    shortened or found, so there are as many as notes lie in one another.
    """
    spark = notes.sparkSession
    with stages(spark) as stage:
        shown = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")) != ""
        ids = notes.groupBy("doc_id", "note_id").agg(F.min("position").alias("position"), F.min_by(F.when(shown, F.col("text")), F.when(shown, F.col("position"))).alias("text"))
        first = stage(ids.where("text is not null"))
        known = references.join(first.select("doc_id", "note_id"), ["doc_id", "note_id"], "left_semi")
        edges = stage(known.groupBy("doc_id", "inside", "note_id").agg(F.min("position").alias("at")))
        path = F.array(F.col("at").cast("long"))
        news = stage(edges.where("inside is null").select("doc_id", "note_id", path.alias("path")))
        best = news
        while not news.isEmpty():
            within = edges.where("inside is not null").withColumnRenamed("note_id", "to").join(news.withColumnRenamed("note_id", "inside"), ["doc_id", "inside"])
            longer = within.groupBy("doc_id", F.col("to").alias("note_id")).agg(F.min(F.concat("path", F.array(F.col("at").cast("long")))).alias("path"))
            old = best.withColumnRenamed("path", "was")
            news = stage(longer.join(old, ["doc_id", "note_id"], "left").where("was is null or path < was").select("doc_id", "note_id", "path"))
            best = stage(best.unionByName(news).groupBy("doc_id", "note_id").agg(F.min("path").alias("path")))
        placed = first.join(best, ["doc_id", "note_id"], "left")
        order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("path"), "position", "note_id")
        return stage(placed.select("doc_id", "note_id", F.row_number().over(order).alias("number"), F.col("text").alias("definition")), keep=True)


def footnote_lines(number: Column, text: Column) -> Column:
    """A note's definition in Markdown: further lines are indented."""
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\r?\n")
    shown = F.transform(lines, lambda line, i: F.when((i == 0) | (line == ""), line).otherwise(F.concat(F.lit("    "), line)))
    return F.concat(F.lit("[^"), number.cast("string"), F.lit("]: "), F.array_join(shown, "\n"))


def claimed_slugs(headings: DataFrame) -> DataFrame:
    """Unique anchors of a document's headings: slug, slug-1, slug-2, ... in reading order.

    Takes ``doc_id, position, slug``.  An anchor that an earlier heading has taken
    is passed over.  Only documents in which a slug reads like another one's
    numbered form need their headings in sequence; a window numbers all others.
    """
    own = headings.select("doc_id", "position", "slug")
    forms = own.select("doc_id", F.regexp_replace("slug", "-[0-9]+$", "").alias("slug"), F.col("slug").alias("form")).where("form <> slug").select("doc_id", "slug").distinct()
    crossed = forms.join(own, ["doc_id", "slug"], "left_semi").select("doc_id").distinct()
    plain = own.join(crossed, "doc_id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("position")) - 1
    numbered = plain.withColumn("nth", nth).select("doc_id", "position", F.when(F.col("nth") == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("nth").cast("string"))).alias("anchor"))

    def in_sequence(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        taken: set[str] = set()
        last: dict[str, int] = {}
        anchors = []
        for slug in rows.column("slug").to_pylist():
            n, anchor = last.get(slug, 0), slug
            while anchor in taken:
                n += 1
                anchor = f"{slug}-{n}"
            last[slug] = n
            taken.add(anchor)
            anchors.append(anchor)
        return rows.select(["doc_id", "position"]).append_column("anchor", pa.array(anchors, pa.string()))

    schema = ", ".join([*(f"{n} {t}" for n, t in own.dtypes if n != "slug"), "anchor string"])
    return numbered.unionByName(own.join(crossed, "doc_id", "left_semi").groupBy("doc_id").applyInArrow(in_sequence, schema))  # one document's headings


def resolved_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links to anchors of the same document, with the heading's position where there is one."""
    return links.join(anchors.select("doc_id", "anchor", F.col("position").alias("target_position")), ["doc_id", "anchor"], "left")


def distinct_assets(assets: DataFrame, budget: int) -> DataFrame:
    """The first of each document's assets per part, while their running size is within budget."""
    one = assets.groupBy("doc_id", "part").agg(F.min_by(F.struct("position", "size"), "position").alias("a")).select("doc_id", "part", "a.*")
    total = F.sum("size").over(Window.partitionBy("doc_id").orderBy("position", "part").rowsBetween(Window.unboundedPreceding, 0))
    return one.withColumn("total", total).withColumn("kept", F.col("total") <= budget)


def covered_grid(origins: DataFrame) -> DataFrame:
    """Every grid position of cells with spans: their origin, and whether they are it."""
    rows = F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("r")
    wide = origins.select("table_id", "row", "col", "col_span", rows)
    return wide.select("table_id", "row", "col", "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("c")).withColumn("origin", (F.col("r") == F.col("row")) & (F.col("c") == F.col("col")))


def header_votes(rows: DataFrame) -> DataFrame:
    """Per column: the header's kind, the body's dominant kind and share, and the vote.

    Takes ``col, row, text`` of a table, row 0 being the candidate.
    A column votes for a header if nine tenths of its body are of one kind other
    than text and the candidate is text.
    """
    kinds = rows.select("col", "row", value_kind(F.col("text")).alias("kind"))
    head = kinds.where("row = 0").select("col", F.col("kind").alias("head_kind"))
    body = kinds.where("row > 0 AND kind <> 'blank'").groupBy("col", "kind").agg(F.count("*").alias("n"))
    most = body.groupBy("col").agg(F.max_by("kind", F.struct("n", "kind")).alias("body_kind"), F.max("n").alias("top"), F.sum("n").alias("all"))
    vote = (F.col("top") * 10 >= F.col("all") * 9) & (F.col("body_kind") != "text") & (F.col("head_kind") == "text")
    return head.join(most, "col").select("col", "head_kind", "body_kind", vote.alias("votes"))


def modal_width(widths: DataFrame) -> DataFrame:
    """The most frequent row width of each table, the wider one of equals."""
    n = widths.groupBy("table_id", "width").agg(F.count("*").alias("n"))
    return n.groupBy("table_id").agg(F.max_by("width", F.struct("n", "width")).alias("width"))


def due_jobs(jobs: DataFrame, now) -> DataFrame:
    """Jobs to claim: queued, due for a retry, or with a lease that has run out, if an attempt is left.

    Takes ``job_id, state, attempt, max_attempts, due_at, lease_until``.  A last
    attempt whose lease has run out fails with ``lease-lost``; other jobs without
    an attempt left are not given.
    """
    expired = (F.col("state") == "running") & (F.col("lease_until") <= now)
    due = (F.col("state") == "queued") | ((F.col("state") == "retry") & (F.col("due_at") <= now)) | expired
    over = F.col("attempt") >= F.col("max_attempts")
    state, attempt = F.when(over, "failed").otherwise("running"), F.when(over, F.col("attempt")).otherwise(F.col("attempt") + 1)
    return jobs.where(due & (expired | ~over)).select("job_id", state.alias("state"), attempt.alias("attempt"), F.when(over, "lease-lost").alias("error_code"))


def overlapping_merges(merges: DataFrame, block: int = 64) -> DataFrame:
    """Pairs of merged rectangles of one sheet that share a cell.

    Takes ``sheet, merge_id, top, left, bottom, right``.  Rectangles meet in the
    blocks of rows they reach, by an equi-join, and each pair counts in its first
    common block.
    """
    reach = F.explode(F.sequence(F.floor(F.col("top") / block), F.floor(F.col("bottom") / block))).alias("block")
    a = merges.select("sheet", F.col("merge_id").alias("a"), F.col("top").alias("t1"), F.col("left").alias("l1"), F.col("bottom").alias("b1"), F.col("right").alias("r1"), reach)
    b = merges.select("sheet", F.col("merge_id").alias("b"), F.col("top").alias("t2"), F.col("left").alias("l2"), F.col("bottom").alias("b2"), F.col("right").alias("r2"), reach)
    meet = a.join(b, ["sheet", "block"]).where("a < b AND t1 <= b2 AND t2 <= b1 AND l1 <= r2 AND l2 <= r1")
    return meet.where(F.col("block") == F.floor(F.greatest("t1", "t2") / block)).select("sheet", "a", "b")


def feature_manifest(objects: DataFrame) -> DataFrame:
    """Counts of each feature of a workbook, zeros left out: takes ``workbook, feature``."""
    return objects.groupBy("workbook", "feature").agg(F.count("*").alias("n"))
