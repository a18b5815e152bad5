"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A document is its sequence of line hashes (blank lines are skipped).  Every
window of ``run_lines`` consecutive lines selects its smallest line hash as its
fingerprint, so two equal windows always select the same one (the guarantee of
winnowing).  Only windows whose fingerprint is selected at a second position are
looked at further: windows with the same fingerprint are joined by the hash of
all their lines, and those that occur earlier are repeats.  Repeated windows that
overlap or touch extend each other both ways to whole runs; every run that occurs
earlier is deleted.  The earlier place is that of the smaller doc_id, then of the
earlier line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, Scratch, join_one


def _windows(hashes: Column, run: int) -> Column:
    """(start, lines, gram, mark, at) of every window; fewer lines, but not none, are one window."""
    n = F.size(hashes)
    width = F.least(n, F.lit(run))

    def one(j: Column) -> Column:
        part = F.slice(hashes, j + 1, width)
        low = F.array_min(part)
        return F.struct(j.alias("start"), width.alias("lines"), F.xxhash64(width, part).alias("gram"), low.alias("mark"),
                        (j + F.array_position(part, low).cast("int")).alias("at"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - width), one)).otherwise(F.array())


def dedup_lines(docs: DataFrame, *, run_lines: int = 2) -> DataFrame:
    """``docs`` with ``text`` freed of repeated runs, and n_lines, n_deleted (columns of these names are replaced).

    Lines end at a line feed and are compared after trimming spaces; blank lines
    neither count nor are deleted.  A line is deleted when it lies in a window of
    ``run_lines`` consecutive lines that occurs earlier, in an earlier document
    or earlier in its own; a document with fewer lines is one window and is
    compared with other such whole documents.  Null texts stay null with 0 lines;
    a document of which all is deleted keeps its row.  Rows with the same doc_id
    and text are one document and get the same result; a null doc_id comes first;
    rows with one doc_id and different texts are ordered by a hash of the text.
    An empty table gives no rows.  No row is dropped and no other column changes.
    """
    scratch = Scratch(docs.sparkSession)
    names = docs.columns
    # The whole row travels as one column, so no name of it meets a name used here.
    rows = docs.select(F.struct(*names).alias("row"), F.col("text").cast("string").alias("text"),
                       F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    lines = F.split("text", "\n", -1)
    filled = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    hashes = F.transform(filled, lambda x: F.xxhash64(x))
    windows = scratch.write(
        rows.where("text is not null").select("id", "th", hashes.alias("h"))
        .select("id", "th", F.explode(_windows(F.col("h"), run_lines)).alias("w"))
        .select("id", "th", "w.*"), "windows")

    # Fingerprints selected at one place only cannot be in a repeated window.  The others are a bitmap, tested where
    # the windows lie; the few windows it lets through by chance are left out by their hash below.
    place = F.struct("id", "th", "at")
    marks = scratch.write(windows.groupBy("mark").agg(F.min(place).alias("x"), F.max(place).alias("y"))
                          .where(~F.col("x").eqNullSafe(F.col("y"))).select("mark"), "marks")
    near = scratch.write(KeyFilter(marks, "mark", scratch).kept(windows, F.col("mark"))
                         .select("id", "th", "start", "lines", "gram"), "near")
    place = F.struct("id", "th", "start")
    grams = scratch.write(
        near.groupBy("gram").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
        .where(~F.col("first").eqNullSafe(F.col("last"))).select("gram", "first", "n"), "grams")
    later = (join_one(near, grams, "gram", "n", near.count()).where(~F.col("first").eqNullSafe(place))
             .select("id", "th", "start", "lines"))
    # Windows of one document that overlap or touch are one run: the union of their lines.
    runs = (later.groupBy("id", "th")
            .agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("lines") - 1))))
                 .alias("gone")))
    runs = scratch.write(runs.select(F.col("id").alias("rid"), F.col("th").alias("rth"), "gone"), "runs")
    scratch.drop(windows, marks, near, grams)

    # Only texts that the bitmap of touched rows lets through travel; all others stay where they lie.
    maybe = KeyFilter(runs.select(F.xxhash64("rid", "rth").alias("key")), "key", scratch).marked(rows, F.xxhash64("id", "th"), "maybe")
    touched = (maybe.where("maybe").drop("maybe")
               .join(runs.hint("merge"), F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left"))
    untouched = maybe.where("not maybe").drop("maybe").select("*", F.lit(None).cast("array<int>").alias("gone"))
    places = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    joined = touched.drop("rid", "rth").withColumn("places", F.when(F.col("gone").isNotNull(), places)).withColumn(
        "parts", F.when(F.col("gone").isNotNull(), lines))
    gone = F.transform("gone", lambda j: F.get(F.col("places"), j))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), gone)
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(F.array_sort(left), lambda i: F.get(F.col("parts"), i)), "\n"))
    columns = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names
               if c not in ("n_lines", "n_deleted")]
    counts = (F.coalesce(F.size(filled), F.lit(0)).cast("long").alias("n_lines"),
              F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"))
    whole = [F.col("row").getField(c).cast("string").alias(c) if c == "text" else F.col("row").getField(c).alias(c)
             for c in names if c not in ("n_lines", "n_deleted")]
    return joined.select(*columns, *counts).unionByName(untouched.select(*whole, *counts))


#: The same result by comparing every window of every document directly ({run} consecutive lines).
ORACLE = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
f AS (SELECT doc_id, [i FOR i IN range(1, len(ls) + 1) IF trim(ls[i]) <> ''] AS pos, ls FROM l),
h AS (SELECT doc_id, pos, ls, [trim(ls[i]) FOR i IN pos] AS fl FROM f),
w AS (SELECT doc_id, s, least({run}, len(fl)) AS k, array_to_string(fl[s + 1:s + least({run}, len(fl))], chr(10)) AS gram
      FROM (SELECT doc_id, fl, unnest(range(0, len(fl) - least({run}, len(fl)) + 1)) AS s FROM h WHERE len(fl) > 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY k, gram ORDER BY doc_id, s) AS nth FROM w),
gone AS (SELECT doc_id, list_distinct(list(j)) AS g
         FROM (SELECT doc_id, unnest(range(s, s + k)) AS j FROM r WHERE nth > 1) GROUP BY doc_id)
SELECT h.doc_id, CASE WHEN h.ls IS NULL THEN NULL ELSE
         array_to_string([ls[i] FOR i IN range(1, len(ls) + 1)
                          IF NOT list_contains([pos[j + 1] FOR j IN coalesce(g, [])], i)], chr(10)) END AS text,
       CAST(coalesce(len(fl), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_deleted
FROM h LEFT JOIN gone USING (doc_id)
"""
