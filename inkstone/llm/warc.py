"""Operator 3: Merkle fixity audit of WARC archives.

Records are serialised as WARC/1.0 and laid end to end in archives. A leaf is
the hash of a record's place, offset range and digest; a node is the hash of
its range of places and offsets and of the ordered hashes of up to ``FAN_OUT``
nodes below it, so that a record that is intact but elsewhere shows as well.
Nodes of a level are stored in parts by the top node they lie under. Two
replicas are compared at the roots; on the way down only parts with a differing
root are read, and in these only children of differing nodes are compared, so
replicas that agree cost the comparison of their roots. What differs
at the leaves is told apart afterwards: the same bytes elsewhere, other bytes
under the same id, lost or extra.

Serialising and hashing happen before the first shuffle: what is shuffled is a
digest and a length for each record, never its bytes.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import forget, union_all, written

#: Records of an archive, and children of a node.
ARCHIVE_RECORDS, FAN_OUT = 256, 16
#: Leaves for which a level gets one more stored part, and the least and most parts.
PART_LEAVES, LEAST_PARTS, MOST_PARTS = 1_000_000, 16, 1_024
#: The archive of records without an id; no id has this one.
NULL_IDS = -(1 << 63)
#: The date that records carry; a caller's own would make equal records differ.
DATE = "1970-01-01T00:00:00Z"


def record_bytes(record_id: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.0 resource record as binary; nulls are empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def numbered(rows: DataFrame, group: list[str], order: list[str], size: str | None = None) -> DataFrame:
    """``rows`` with ``seq``, their number from 0 in each group by ``order``, and,
    given ``size``, with ``end``, its sum up to and with each row. A group of any
    size is numbered in parts: rows are dealt by their place, numbered inside
    each part, and moved on by what the group's earlier parts hold."""
    dealt = written(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    size_of = F.col(size) if size else F.lit(0).cast("long")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.sum(size_of).alias("_sum"))
    held = held.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_part").alias("_of"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_sum")))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    out = dealt.withColumn("seq", (F.row_number().over(inside) - 1).cast("long"))
    if size:
        out = out.withColumn("end", F.sum(size_of).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    here = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    out = out.join(held, [*here, F.col("_part") == F.col("_of")]).withColumn("seq", F.col("seq") + F.col("_n"))
    return (out.withColumn("end", F.col("end") + F.col("_sum")) if size else out).drop("_part", "_of", "_n", "_sum", *(f"_{g}" for g in group))


def leaves(
    records: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_records: int = ARCHIVE_RECORDS, order: Column | None = None
) -> DataFrame:
    """archive, seq, record_id, start, end, digest: one row per record.

    An archive holds a range of ids; records lie in the order of ``order`` (any
    expression over ``records``) if given, then of id, then digest, and equal
    records side by side. Records with a null id form the archive ``NULL_IDS``.
    Archives that repeated or null ids make large are numbered in parts. Other
    columns, whatever their names, are not read.
    """
    made = records.select(F.col(id_col).cast("long").alias("record_id"), (order if order is not None else F.lit(0)).alias("first"), record_bytes(F.col(id_col), F.col(url_col), F.col(payload_col)).alias("bytes"))
    made = made.select(
        F.coalesce(F.floor(F.col("record_id") / archive_records).cast("long"), F.lit(NULL_IDS).cast("long")).alias("archive"),
        "record_id",
        "first",
        F.sha2("bytes", 256).alias("digest"),
        F.octet_length("bytes").cast("long").alias("size"),
    )
    made = written(made.withColumn("tie", F.monotonically_increasing_id()))  # equal records may lie in several parts
    placed = numbered(made, ["archive"], ["first", "record_id", "digest", "tie"], "size")
    out = written(placed.select("archive", "seq", "record_id", (F.col("end") - F.col("size")).alias("start"), "end", "digest"))
    forget(made)
    return out


def _part(above: int, fan_out: int, parts: int) -> Column:
    """The stored part of a node, by the node ``above`` levels higher that it lies under."""
    return F.pmod(F.xxhash64("archive", F.expr(f"seq div {fan_out**above}L")), F.lit(parts)).cast("int")


def tree(leaf_rows: DataFrame, levels: int, fan_out: int = FAN_OUT, parts: int = LEAST_PARTS) -> list[DataFrame]:
    """Nodes of each level, the leaves first: archive, seq, start, end, hash,
    part. Each level is written once, in a folder for each part; a part that is
    large is written by several tasks."""

    def stored(nodes: DataFrame, level: int) -> DataFrame:
        return written(nodes.withColumn("part", _part(levels - level, fan_out, parts)).hint("rebalance", "part"), ("part",))

    leaf = F.sha2(F.concat_ws("|", F.lit("leaf"), *(F.col(c).cast("string") for c in ("seq", "start", "end")), "digest"), 256)
    out = [stored(leaf_rows.select("archive", "seq", "start", "end", leaf.alias("hash")), 0)]
    for level in range(1, levels + 1):
        below = out[-1].groupBy("archive", F.expr(f"seq div {fan_out}").alias("up"))
        ordered = F.array_sort(F.collect_list(F.struct("seq", "hash")))  # fan_out hashes at most
        node = below.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"), ordered.alias("hashes"))
        named = F.concat_ws("|", F.lit("node"), *(F.col(c).cast("string") for c in ("first", "last", "start", "end")), F.transform("hashes", lambda x: x["hash"]))
        out.append(stored(node.select("archive", F.col("up").alias("seq"), "start", "end", F.sha2(named, 256).alias("hash")), level))
    return out


def levels_for(records: int, fan_out: int = FAN_OUT) -> int:
    """Levels above the leaves until one node holds ``records`` leaves."""
    levels, reach = 0, 1
    while reach < records:
        levels, reach = levels + 1, reach * fan_out
    return max(1, levels)


def audit(one: DataFrame, other: DataFrame, levels: int, fan_out: int = FAN_OUT) -> DataFrame:
    """(archive, seq, ours, theirs) of every leaf in which two replicas (as
    ``leaves`` gives them) differ; ``ours`` and ``theirs`` are the leaf hashes,
    null where a replica has no such leaf.

    ``levels`` should reach a single root for a usual archive; of a larger one
    all nodes of the top level are compared. Empty replicas are allowed; equal
    ones give an empty table, and nothing below their roots is read.
    """
    parts = min(MOST_PARTS, max(LEAST_PARTS, max(one.count(), other.count()) // PART_LEAVES))
    ours, theirs = tree(one, levels, fan_out, parts), tree(other, levels, fan_out, parts)
    differing, touched = None, []
    for level in range(levels, -1, -1):
        a, b = (side[level] for side in (ours, theirs))
        if differing is not None:
            parents = differing.select("archive", F.col("seq").alias("up"))
            a, b = (x.where(F.col("part").isin(touched)).withColumn("up", F.expr(f"seq div {fan_out}")).join(parents, ["archive", "up"], "left_semi") for x in (a, b))
        a, b = (x.select("archive", "seq", F.col("hash").alias(name)) for x, name in ((a, "ours"), (b, "theirs")))
        above, differing = differing, written(a.join(b, ["archive", "seq"], "full_outer").where("not (ours <=> theirs)"))
        forget(above)
        if level == levels:  # nodes below are in the parts of their top nodes
            touched = [r.part for r in differing.select(_part(0, fan_out, parts).alias("part")).distinct().collect()]  # MOST_PARTS numbers at most
        if not touched:
            break
    for level in (*ours, *theirs):
        forget(level)
    return differing


def _paired(left: DataFrame, right: DataFrame, by: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The k-th left row of an archive and ``by`` with the k-th right one:
    those paired (from the left), and what is left over on either side."""
    key = ["archive", by]
    one, two = (written(numbered(x.withColumnRenamed("seq", "at"), key, ["at"]).withColumnRenamed("seq", "k")) for x in (left, right))
    back = lambda x: x.drop("k").withColumnRenamed("at", "seq")
    same = lambda x, y: [x["archive"] == y["archive"], x[by].eqNullSafe(y[by]), x["k"] == y["k"]]
    return back(one.join(two, same(one, two), "left_semi")), back(one.join(two, same(one, two), "left_anti")), back(two.join(one, same(two, one), "left_anti"))


def compare(one: DataFrame, other: DataFrame, levels: int = 2, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per record of ``one``, and one per record that only ``other``
    has: archive, seq, record_id, start, end, digest, status.

    ``intact``: the same bytes at the same place and offsets. Of the records in
    leaves that ``audit`` found, in each archive and in order: ``moved``, the
    same bytes elsewhere; ``changed``, other bytes under the same id; else
    ``missing`` or, with the place that it has in ``other``, ``extra``.
    Records without an id are of one archive and count as one id.
    """
    found = audit(one, other, levels, fan_out)
    place = ["archive", "seq"]
    ours, theirs = one.join(found.where("ours is not null").select(*place), place, "left_semi"), other.join(found.where("theirs is not null").select(*place), place, "left_semi")
    columns = one.columns
    moved, ours, theirs = _paired(ours.select(columns), theirs.select(columns), "digest")
    changed, ours, theirs = _paired(ours.select(columns), theirs.select(columns), "record_id")
    said = union_all([x.select(*columns).withColumn("status", F.lit(name)) for name, x in (("moved", moved), ("changed", changed), ("missing", ours))])
    intact = one.join(found.select(*place), place, "left_anti").withColumn("status", F.lit("intact"))
    return union_all([intact, said, theirs.select(*columns).withColumn("status", F.lit("extra"))])


def write_archives(records: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_records: int = ARCHIVE_RECORDS) -> None:
    """Write records as files of WARC text, an ordered run of archives in each."""
    made = records.select(F.col(id_col).alias("i"), record_bytes(F.col(id_col), F.col(url_col), F.col(payload_col)).cast("string").alias("value"))
    parts = max(1, -(-records.count() // archive_records))
    # the writer's line end is the last of a record's two
    text = F.left("value", F.length("value") - 2).alias("value")
    made.repartitionByRange(parts, "i").sortWithinPartitions("i").select(text).write.option("lineSep", "\r\n").text(path)


_FIELD = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r?\n")


def records_of(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields in lower case, block) of the records of one archive, by
    their Content-Length. Compressed archives are opened; offsets are then those
    of the plain bytes. A record cut off at the end has what is there of its block."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.GzipFile(fileobj=io.BytesIO(content)).read()
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        line = content.find(b"\n", at)
        fields, end = {}, line + 1
        while line >= 0 and (m := _FIELD.match(content, end)):
            fields[m[1].decode("ascii").lower()] = m[2].decode("utf-8", "replace").strip()
            end = m.end()
        if not fields.get("content-length", "").isdigit():
            at += 5  # no header: look for the next one
            continue
        begin = end + (2 if content[end : end + 2] == b"\r\n" else 1)
        stop = begin + int(fields["content-length"])
        yield at, fields, content[begin:stop]
        at = stop


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id (null unless the id is one of ``record_bytes``), url, payload,
    type, offset: one row per record of the files under ``path``, plain or
    compressed. A file is parsed by one task, so it should be an archive of a
    usual size (under 2 GB)."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for offset, fields, block in records_of(content):
                    number = re.fullmatch(r"<urn:record:(-?[0-9]+)>", fields.get("warc-record-id", ""))
                    rows.append((int(number[1]) if number else None, fields.get("warc-target-uri"), block.decode("utf-8", "replace"), fields.get("warc-type"), offset))
                    if len(rows) >= 1_000:
                        yield _frame_of(rows)
                        rows = []
                yield _frame_of(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(of, "record_id long, url string, payload string, type string, offset long")


def _frame_of(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["record_id", "url", "payload", "type", "offset"])
    return out.assign(record_id=pd.array(out["record_id"].tolist(), "Int64"))
