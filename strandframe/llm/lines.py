"""Line de-duplication: repeated windows of consecutive lines are removed where they come again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandframe.llm.rows import pack, unpack
from strandframe.session import cut_lineage


def _window_keys(lines: str, width: int) -> Column:
    """array<struct<pos, h1, h2>>: two hashes of each window of ``width`` lines with any content."""
    def key(i: Column) -> Column:
        part = [F.get(lines, i + k) for k in range(width)]
        return F.struct(
            i.cast("int").alias("pos"), F.xxhash64(*part).alias("h1"),
            F.xxhash64(F.lit(width), *reversed(part)).alias("h2"),
            (F.concat(*part) != "").alias("full"))

    starts = F.when(F.size(lines) >= width, F.sequence(F.lit(0), F.size(lines) - width)).otherwise(
        F.array().cast("array<int>"))
    return F.filter(F.transform(starts, key), lambda w: w["full"])


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Start positions of windows that came before, as one sorted list per document.

    Columns ``_id``, ``_hash`` (of the text, so that two documents under one id stay apart) and
    ``_starts``. Windows are counted by a partial aggregate on their hash, so a passage in a third
    of all documents is one row per map task; places are then found by a join in which AQE may
    split that passage.
    """
    windows = (
        docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"),
                    F.split(text_col, "\n").alias("_lines"))
        .select("_id", "_hash", F.explode(_window_keys("_lines", width)).alias("_w"))
        .select("_w.h1", "_w.h2", "_id", "_hash", F.col("_w.pos").alias("_pos"))
    )
    place = F.struct("_id", "_hash", "_pos")
    seen = (
        windows.groupBy("h1", "h2").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1").select("h1", "h2", "_first")
    )
    return (
        windows.join(seen, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("_first")))
        .groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("_pos")).alias("_starts"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with later occurrences of repeated ``width``-line windows taken out of the text.

    Lines are the ``\\n``-split pieces, compared exactly; a window of empty lines only is no window.
    Of equal windows the one that is smallest by (id, text hash, position) stays, and every line
    under any other is removed; overlapping windows merge. Adds ``n_lines`` and ``removed_lines``
    (both replace columns of that name). A null text stays null with null counts; texts of fewer
    than ``width`` lines stay; a null id sorts first; rows equal in id and text are one document
    and all lose the same lines.
    """
    keyed = pack(docs, id=F.col(id_col), hash=F.xxhash64(text_col))
    marks = repeated_windows(docs, id_col, text_col, width)
    joined = keyed.join(marks, keyed["id"].eqNullSafe(marks["_id"]) & (keyed["hash"] == marks["_hash"]), "left")
    lines, starts = F.col("lines"), F.col("_starts")

    def gap(k: Column) -> Column:
        """Lines between the end of window k-1 and the start of window k."""
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(starts, k - 1) + width)
        end = F.when(k == F.size(starts), F.size(lines)).otherwise(F.get(starts, k))
        return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), gap))
    cut = joined.select("row", "_starts", F.split(F.col(f"row.`{text_col}`"), "\n").alias("lines")).select(
        "row", "lines", F.when(starts.isNull(), lines).otherwise(kept).alias("kept"))
    size = lambda a: F.when(a.isNotNull(), F.size(a)).cast("long")
    out = unpack(cut, docs.columns, **{
        text_col: F.array_join("kept", "\n"), "n_lines": size(lines), "removed_lines": size(lines) - size(F.col("kept"))})
    return out.select(*[f"`{c}`" for c in docs.columns if c not in ("n_lines", "removed_lines")], "n_lines", "removed_lines")


def line_dedup_stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Cleaned documents with the columns of ``docs``; those whose every line was a repeat are gone."""
    out = cut_lineage(dedup_lines(docs, id_col, text_col, width))
    left = F.col("removed_lines").isNull() | (F.col("removed_lines") == 0) | (F.trim(text_col) != "")
    return out.filter(left).select(*docs.columns)
