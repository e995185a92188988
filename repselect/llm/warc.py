"""WARC records of web pages, and a Merkle fixity audit of replicas.

Records lie in files one behind the other. Each file has a tree: a record's leaf hash covers its bytes and its
offset range within the file, each node the ordered hashes of at most ``FANOUT`` children; the roots of the files
are the leaves of the replica's tree. Replicas whose roots agree are equal; otherwise only the children of nodes that
differ are looked at, level by level, down to the records. Behind a lost, added or resized record all later leaves of
its file differ by their offsets, so the records below the nodes that differ are compared as what they are, by page and
hash: a record that only lies elsewhere is no fault.
"""

from __future__ import annotations

import gzip
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from repselect.llm.order import with_prefix
from repselect.session import settled

FANOUT = 8
#: Levels of a file's tree above its leaves, and records of a file.
DEPTH = 3
PER_FILE = FANOUT ** DEPTH
#: Date of the records where the pages don't tell when they were fetched.
DATE = "1970-01-01T00:00:00Z"


def record(url: Column, html: Column, page_id: Column) -> Column:
    """One WARC/1.1 resource record, without the two line ends that part records."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def records(pages: DataFrame) -> DataFrame:
    """``page_id, record`` of each page; null url or html count as empty, a null id is written ``none``."""
    return pages.select("page_id", record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))


def write_warc(pages: DataFrame, path: str) -> None:
    """WARC files of the pages, one a partition, in the given order of rows."""
    records(pages).select("record").write.option("lineSep", "\r\n\r\n").text(path)


def _head(data: bytes) -> tuple[int | None, str]:
    """(Content-Length, target) of a record's head; the length is None if it is missing or no number."""
    fields = {}
    for line in data.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    return int(length) if length.isdigit() else None, fields.get(b"warc-target-uri", b"").decode("utf-8", "replace")


def read_warc(spark, path: str) -> DataFrame:
    """``file, record_offset, url, content, intact`` of every record below ``path``; content is binary.

    A file is read by one task, as the format's files are made of about a gigabyte; names that end in ``.gz``
    are inflated, and their offsets count inflated bytes. Records are found by their Content-Length. Where that
    is missing or no number, the record ends ahead of the next one's first line; such a record and one that the
    file cuts short are not ``intact``.
    """
    import pandas as pd

    def parse(batches):
        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content):
                data, at, out = gzip.decompress(data) if name.endswith(".gz") else data, 0, []
                while at < len(data) and (end := data.find(b"\r\n\r\n", at)) >= 0:
                    length, url = _head(data[at:end])
                    following = data.find(b"\r\n\r\nWARC/1.", end)
                    stop = end + 4 + length if length is not None else following if following >= 0 else len(data)
                    out.append((name, at, url, data[end + 4:stop], length is not None and stop <= len(data)))
                    at = stop + 4
                yield pd.DataFrame(out, columns=["file", "record_offset", "url", "content", "intact"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, record_offset long, url string, content binary, intact boolean")


def _measured(one: Column) -> tuple[Column, Column]:
    return (F.octet_length(one) + 4).cast("long").alias("record_length"), F.sha2(one, 256).alias("record_sha256")


def in_files(rows: DataFrame, *order: str) -> DataFrame:
    """``slot`` and ``record_offset`` of records within their ``warc_file``, in the given order."""
    own = Window.partitionBy("warc_file").orderBy(*order)  # bounded by a file's records
    ahead = F.sum("record_length").over(own.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("slot", F.row_number().over(own) - 1).withColumn("record_offset", F.coalesce(ahead, F.lit(0)).cast("long"))


LAID = ["page_id", "url", "warc_file", "slot", "record_offset", "record_length", "record_sha256"]


def laid_out(pages: DataFrame) -> DataFrame:
    """The columns ``LAID`` of each page, in the order of ``page_id``, url and record hash: ``PER_FILE`` records a
    file, offsets in bytes. Rows equal in all three are equal records, so the layout does not hang on the order of the
    input."""
    rows = pages.select("page_id", "url", *_measured(record(F.col("url"), F.col("html"), F.col("page_id"))))
    placed = with_prefix(rows, ["page_id", "url", "record_sha256"], "record_length").withColumn("warc_file", F.expr(f"rank div {PER_FILE}"))
    return in_files(placed, "rank").select(LAID)


def file_trees(laid: DataFrame) -> DataFrame:
    """``warc_file, levels``: all levels of each file's tree, the records' leaves first, the root last; as a file's
    rows are together already, nothing is shuffled again."""
    leaf = F.sha2(F.concat_ws(":", "record_sha256", "record_offset", F.col("record_offset") + F.col("record_length")), 256)
    files = laid.groupBy("warc_file").agg(F.sort_array(F.collect_list(F.struct("slot", leaf.alias("hash")))).alias("found"))
    up = lambda level: F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / FANOUT).cast("int") - 1), lambda k: F.sha2(F.array_join(F.slice(level, k * FANOUT + 1, FANOUT), ""), 256))
    climbed = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.array(F.col("found.hash")), lambda levels, _: F.concat(levels, F.array(up(F.element_at(levels, -1)))))
    return files.select("warc_file", climbed.alias("levels"))


def parents(level: DataFrame) -> DataFrame:
    """The level above: each node hashes its ordered children, at most ``FANOUT``."""
    children = F.sort_array(F.collect_list(F.struct("node", "hash")))
    grouped = level.groupBy("replica", F.expr(f"node div {FANOUT}").alias("up")).agg(children.alias("children"))
    return grouped.select("replica", F.col("up").alias("node"), F.sha2(F.array_join("children.hash", ""), 256).alias("hash"))


def _differing(level: DataFrame) -> DataFrame:
    same = level.groupBy("node").agg(F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    return same.where("n <> 2 or low <> high").select("node")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """``node``: the nodes at which the lowest levels ``(node, hash)`` of two trees differ or one has none.

    Equal replicas cost one comparison of roots after their trees; a level's nodes are compared only below
    a parent that differs. Two empty trees are equal.
    """
    levels = [settled(first.withColumn("replica", F.lit(0)).unionByName(second.withColumn("replica", F.lit(1))))]
    top = levels[0].agg(F.max("node")).first()[0]
    while top:
        levels.append(parents(levels[-1]))
        if len(levels) == 3:  # 64 times smaller: from here on, cheap to keep
            levels[-1] = settled(levels[-1])
        top //= FANOUT
    bad = _differing(levels.pop())
    while levels:
        below = levels.pop()
        up = F.expr(f"node div {FANOUT}")
        bad = _differing(below.withColumn("up", up).join(bad.withColumnRenamed("node", "up"), "up", "left_semi"))
    return bad


def suspects(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of both layouts below nodes that differ, ``FANOUT`` of them a node."""
    trees = [settled(file_trees(laid)) for laid in (first, second)]
    roots = [t.select(F.col("warc_file").alias("node"), F.element_at(F.element_at("levels", -1), 1).alias("hash")) for t in trees]
    files = audit(*roots).withColumnRenamed("node", "warc_file")
    a, b = (t.join(files, "warc_file", "left_semi").select("warc_file", F.col("levels").alias(name)) for t, name in zip(trees, "ab"))
    node = lambda level, k, side: F.get(F.get(side, F.lit(level)), k)
    differ = lambda level, k: ~F.equal_null(node(level, k, "a"), node(level, k, "b"))
    last = F.greatest(*[F.coalesce(F.size(F.get(x, F.lit(1))), F.lit(0)) for x in "ab"]) - 1
    below = lambda k: [differ(level, F.floor(k / FANOUT ** (level - 1)).cast("int")) for level in range(DEPTH, 0, -1)]
    both = a.join(b, "warc_file", "full").select("warc_file", F.explode(F.filter(F.sequence(F.lit(0), last), lambda k: reduce(Column.__and__, below(k)))).alias("up"))
    both = settled(both)
    return tuple(laid.withColumn("up", F.floor(F.col("slot") / FANOUT).cast("int")).join(both, ["warc_file", "up"], "left_semi").drop("up") for laid in (first, second))


def faults(first: DataFrame, second: DataFrame) -> DataFrame:
    """``LAID`` and ``status`` of the records at fault: ``corrupt`` if the second layout has another record of the same
    page and url instead, ``missing`` if it has none, ``added`` (with the place in the second) if only it has one.

    Records are counted by page, url and hash; of equal ones of which some are lost the last are named, and where a
    page has several records that differ, the first lost ones pass for corrupt.
    """
    page, version = ["page_id", "url"], ["page_id", "url", "record_sha256"]
    marked = [x.select(*LAID, F.lit(side).alias("side")) for side, x in enumerate(suspects(first, second))]
    rows = settled(marked[0].unionByName(marked[1]))
    counts = rows.groupBy(*version).agg(F.sum(1 - F.col("side")).alias("n0"), F.sum("side").alias("n1")).where("n0 <> n1").select(
        *[F.col(c).alias(f"_{c}") for c in version], (F.col("n0") > F.col("n1")).cast("int").alias("_lost"), F.abs(F.col("n0") - F.col("n1")).alias("_many"))
    same = [F.equal_null(F.col(c), F.col(f"_{c}")) for c in version]
    of_side = F.col("side") == 1 - F.col("_lost")
    last = F.row_number().over(Window.partitionBy(*version).orderBy(F.desc("warc_file"), F.desc("slot")))
    odd = rows.join(counts, [*same, of_side]).withColumn("_nth", last).where("_nth <= _many").select(*LAID, "side")
    odd = odd.withColumn("_at", F.row_number().over(Window.partitionBy(*page, "side").orderBy("warc_file", "slot")))
    totals = odd.groupBy(*page).agg(F.least(F.sum(1 - F.col("side")), F.sum("side")).alias("_both")).select(*[F.col(c).alias(f"_{c}") for c in page], "_both")
    told = odd.join(totals, [F.equal_null(F.col(c), F.col(f"_{c}")) for c in page])
    status = F.when(F.col("_at") <= F.col("_both"), "corrupt").when(F.col("side") == 0, "missing").otherwise("added")
    return told.withColumn("status", status).where("side = 0 or status = 'added'").select(*LAID, "status")


def fixity_report(laid: DataFrame, replica: DataFrame) -> DataFrame:
    """``LAID`` without ``slot`` and ``url``, and ``status``, of all records of the first layout, ``ok`` or as ``faults``
    says, and of those that only the second has. Both layouts are read several times: give settled ones."""
    bad = settled(faults(laid, replica))
    lost = bad.where("status <> 'added'").select("warc_file", "slot", "status")
    known = laid.join(lost, ["warc_file", "slot"], "left").select(*LAID, F.coalesce("status", F.lit("ok")).alias("status"))
    return known.unionByName(bad.where("status = 'added'")).drop("slot", "url")


def decayed(html: Column, page_id: Column, every: int = 97) -> Column:
    """``html`` with its last character replaced if ``every`` divides the id; only an ASCII one, so that lengths
    stay."""
    hit = (page_id % every == 0) & (F.octet_length(F.right(html, F.lit(1))) == 1)
    return F.when(hit, F.concat(F.left(html, F.char_length(html) - 1), F.lit("~"))).otherwise(html)


def audit_drill(pages: DataFrame, every: int = 97, lose: int = 389, add: int = 401) -> DataFrame:
    """The fixity report of ``pages`` against a replica of the same files with planted faults: pages whose id ``every``
    divides have decayed; those with a remainder of 5 by ``lose`` are lost; behind those with a remainder of 7 by ``add``
    stands a second record, with an empty body."""
    names = ["page_id", "url"]
    one = record(F.col("url"), F.col("html"), F.col("page_id"))
    other = record(F.col("url"), decayed(F.col("html"), F.col("page_id"), every), F.col("page_id"))
    extra = record(F.col("url"), F.lit(""), F.col("page_id"))
    rows = pages.select(*names, *_measured(one), F.struct(*_measured(other)).alias("other"), F.struct(*_measured(extra)).alias("extra"))
    placed = with_prefix(rows, [*names, "record_sha256"], "record_length").withColumn("warc_file", F.expr(f"rank div {PER_FILE}"))
    placed = settled(placed)
    nth = lambda by, k: F.coalesce(F.pmod("page_id", F.lit(by)) == k, F.lit(False))
    kept = placed.where(~nth(lose, 5)).select(*names, "warc_file", "rank", F.lit(0).alias("behind"), "other.*")
    more = placed.where(nth(add, 7)).select(*names, "warc_file", "rank", F.lit(1).alias("behind"), "extra.*")
    laid = settled(in_files(placed, "rank").select(LAID))
    return fixity_report(laid, settled(in_files(kept.unionByName(more), "rank", "behind").select(LAID)))
