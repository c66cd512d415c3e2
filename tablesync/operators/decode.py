"""Decoding log transcripts and logical tuples to row changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import assignment_ordinal, assignment_value, marker_offset, rotate_target, table_name

OPERATION = r"^### (INSERT INTO|UPDATE|DELETE FROM)\s+(.*)$"


def transcript_changes(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Changes (file, pos, seq, op, tbl, key, values) of transcripts.

    lines: (path, split, line_no, line), one transcript per path, which line_no orders, its splits following each other. catalog: (tbl,
    ordinal, col, pk), broadcast-sized configuration. A block starts at an operation line and ends at the next one, at a position marker or
    with the file. pos is the end of its event: the next marker, or its own marker + 1 for the last block. @N beyond the table's columns is
    dropped. The key is the key columns' values (of the row before, for updates and deletes), or the whole row where the table has no key.
    seq numbers the blocks of a file.

    What lines carry on is found within each split; what a split takes over from those before it (and the marker it ends at, from those
    behind it) comes from one row per split. So a task holds a split of a transcript, not all of it.
    """
    split = Window.partitionBy("path", "split")
    so_far, behind = split.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0), split.orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    op = F.when(F.rlike("line", F.lit(OPERATION)), F.regexp_extract("line", OPERATION, 1))
    marked = lines.withColumn("op_text", op).withColumn("marker", marker_offset(F.col("line"))).withColumn("rotate", rotate_target(F.col("line")))
    section = F.when(F.rlike("line", F.lit(r"^### (SET|WHERE)\s*$")), F.regexp_extract("line", r"^### (SET|WHERE)", 1)).when(F.col("op_text").isNotNull(), F.lit(""))
    marked = marked.withColumn("part", section)
    ops, marks = F.col("op_text").isNotNull().cast("long"), F.col("marker").isNotNull().cast("long")
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    latest = {"marker": "start", "rotate": "file", "part": "section"}
    ends = marked.groupBy("path", "split").agg(F.sum(ops).alias("n_ops"), F.sum(marks).alias("n_marks"), F.min_by("marker", at("marker")).alias("first"), *[F.max_by(c, at(c)).alias(f"last_{c}") for c in latest])
    order = Window.partitionBy("path").orderBy("split")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path").orderBy(F.desc("split")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    over = ends.select(
        F.col("path").alias("o_path"), F.col("split").alias("o_split"), F.coalesce(F.sum("n_ops").over(before), zero).alias("ops_before"), F.coalesce(F.sum("n_marks").over(before), zero).alias("marks_before"),
        F.last("first", ignorenulls=True).over(after).alias("o_end"), *[F.last(f"last_{c}", ignorenulls=True).over(before).alias(f"o_{n}") for c, n in latest.items()],
    )
    local = marked.select("path", "split", "line", "op_text", F.sum(ops).over(so_far).alias("block"), F.sum(marks).over(so_far).alias("markers"), F.last("marker", ignorenulls=True).over(behind).alias("end"), *[F.last(c, ignorenulls=True).over(so_far).alias(n) for c, n in latest.items()])
    met_over = local.join(over, (F.col("path") == F.col("o_path")) & (F.col("split") == F.col("o_split")))
    carried = met_over.select("path", "line", "op_text", (F.col("block") + F.col("ops_before")).alias("block"), (F.col("markers") + F.col("marks_before")).alias("markers"), *[F.coalesce(n, f"o_{n}").alias(n) for n in ("start", "end", "file", "section")]).where("block > 0")
    body, is_op = F.regexp_replace("line", r"^###\s*", ""), F.col("op_text").isNotNull()
    op_name = F.when(F.col("op_text") == "INSERT INTO", "insert").when(F.col("op_text") == "UPDATE", "update").otherwise("delete")
    head = F.struct("markers", "file", op_name.alias("op"), table_name(F.regexp_extract("line", OPERATION, 2)).alias("tbl"), F.coalesce("end", F.col("start") + 1).alias("pos"))
    cell = F.struct("markers", (F.col("section") == "WHERE").alias("old"), assignment_ordinal(body).alias("n"), assignment_value(body)["text"].alias("text"))
    blocks = carried.groupBy("path", F.col("block").alias("seq")).agg(F.max(F.when(is_op, head)).alias("h"), F.collect_list(F.when(F.startswith("line", F.lit("###")) & ~is_op, cell)).alias("cells"))
    cells = F.filter("cells", lambda c: c["n"].isNotNull() & (c["markers"] == F.col("h.markers")))
    return named_changes(blocks.select("path", "seq", "h.file", "h.op", "h.tbl", "h.pos", cells.alias("cells")), catalog)


def named_changes(blocks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Changes (path, file, pos, seq, op, tbl, key, values) of blocks (path, file, pos, seq, op, tbl, cells), by the columns of their table.

    cells: array of (old, n, text), assignments to the n-th column; old: of the row before. catalog as in transcript_changes. Works on streams too.
    """
    columns = catalog.groupBy(F.col("tbl").alias("c_tbl")).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", F.struct("col", "pk")))).alias("columns"), F.max("pk").alias("has_pk"))
    met = blocks.join(F.broadcast(columns), F.col("tbl") == F.col("c_tbl"), "left")
    column = lambda c: F.try_element_at("columns", c["n"])
    keyless = ~F.coalesce("has_pk", F.lit(False))

    def image(keep):
        return F.map_from_entries(F.transform(F.filter("cells", lambda c: column(c).isNotNull() & keep(c)), lambda c: F.struct(column(c)["col"].alias("k"), c["text"].alias("v"))))

    in_key = lambda c: column(c)["pk"] | keyless
    key = F.when(F.col("op") == "insert", image(lambda c: ~c["old"] & in_key(c))).otherwise(image(lambda c: c["old"] & in_key(c)))
    values = F.when(F.col("op") == "delete", F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))).otherwise(image(lambda c: ~c["old"]))
    return met.select("path", "file", F.col("pos").cast("decimal(20,0)").alias("pos"), "seq", "op", "tbl", key.alias("key"), values.alias("values"))


def unknown_relations(tuples: DataFrame, relations: DataFrame) -> DataFrame:
    """Relation ids of tuples that no relation message describes."""
    return tuples.join(relations.select("rel_id").distinct(), "rel_id", "left_anti").select("rel_id").distinct()


def tuple_changes(tuples: DataFrame, relations: DataFrame, unknown: str = "fail") -> DataFrame:
    """Changes (seq, op, tbl, key, values) of decoded tuple columns.

    tuples: (seq, op, rel_id, image 'new' or 'old', ordinal, kind, value), one row per column. relations: (rel_id, tbl, ordinal, col, is_key).
    kind n is NULL, u is absent (not transmitted), anything else is the text. Insert: key from the new image. Update: from the old image
    if that yields one. Delete: from the old. A relation without key columns has the whole row for its key. Other messages are ignored.
    unknown: 'fail' raises an error for a tuple of a relation that relations doesn't hold, 'skip' leaves it out (see unknown_relations).
    """
    if unknown not in ("fail", "skip"):
        raise ValueError(f"unknown mode {unknown}")
    cells = tuples.where(F.col("op").isin("insert", "update", "delete") & (F.col("kind") != "u"))
    rel = relations.select(F.col("rel_id").alias("r_rel"), F.col("tbl"), F.col("ordinal").alias("r_ordinal"), "col", "is_key")
    keyless = relations.groupBy(F.col("rel_id").alias("k_rel")).agg((~F.max("is_key")).alias("keyless"))
    known = cells.join(keyless, F.col("rel_id") == F.col("k_rel"), "left" if unknown == "fail" else "inner")
    told = F.concat(F.lit("unknown relation "), F.col("rel_id").cast("string"))
    known = known.where(F.when(F.col("k_rel").isNotNull(), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    met = known.join(rel, (F.col("rel_id") == F.col("r_rel")) & (F.col("ordinal") == F.col("r_ordinal")))
    entry = F.struct("col", F.when(F.col("kind") != "n", F.col("value")).alias("text"))
    image = lambda cond: F.collect_list(F.when(cond, entry))
    new, old, in_key = F.col("image") == "new", F.col("image") == "old", F.col("is_key") | F.col("keyless")
    rows = met.groupBy("seq", "op", "tbl").agg(image(new).alias("new"), image(new & in_key).alias("new_key"), image(old & in_key).alias("old_key"))
    key = F.when((F.col("op") == "delete") | ((F.col("op") == "update") & (F.size("old_key") > 0)), F.col("old_key")).otherwise(F.col("new_key"))
    return rows.select("seq", "op", "tbl", F.map_from_entries(key).alias("key"), F.map_from_entries("new").alias("values"))
