"""Line deduplication: a suffix array over line sequences by distributed prefix doubling.

Method. A document is the sequence of its lines that have a word; lines are named by 128-bit digests. Only lines that
occur twice or more stay: others end every run. Names of runs of one line, in digest order, are doubled:
the name of a run of 2**(k+1) lines is the rank of the pair of names of its halves, by a range-partitioned sort
of the distinct pairs, until no two suffixes have a name in common or the longest sequence is spanned. The last names order
the suffix array; common prefixes of neighbours are found by descending the levels. Neighbours whose common prefix has
``least_lines`` lines or more are in one interval; an interval's first member by (doc_id, row, line) is the original, and
the first ``least_lines`` lines of every other member are deleted. A run that is longer is as many intervals, one for each of its places, so
whole maximal runs go; by default a single repeated line is a run. ``longest_run`` is the longest common prefix of a deleted line with a neighbour.

Names are joined, never positions: distinct pairs are combined before they are exchanged, so a line that
a third of the documents have is one row of a sort. Texts are exchanged only for documents that lose lines.

Defined results. Null text is an empty text: no lines. Lines without words are kept and skipped over. Rows equal in id and
text are one document: both get the same result. A copy that overlaps its original in the same document loses only
the lines beyond the original. A null id comes last in the order. Extra columns are carried by :func:`drop_repeated_runs`; a column
with the name of one of its two own is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACE_RUN, WorkArea, fresh_name, mark_known

_WORD = f"[^{SPACE_RUN[1:-2]}]"


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, seq, pos, line): lines with a word; ``seq`` counts those, ``pos`` all lines."""
    parts = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    parts = F.filter(parts, lambda p: p["line"].rlike(_WORD))
    rows = docs.select(_row_key(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.posexplode(parts).alias("seq", "p"))
    return rows.select("row", "id", "seq", F.col("p.pos").alias("pos"), F.unhex(F.md5(F.col("p.line"))).alias("line"))


def _ranked(distinct: DataFrame, by: list[str], area: WorkArea, name: str) -> DataFrame:
    """Distinct keys with a ``rank`` that follows their order; ranks are increasing, not dense."""
    return area.table(distinct.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), name)


def suffix_names(lines: DataFrame, area: WorkArea, most_levels: int = 40) -> list[DataFrame]:
    """Level k: (row, id, seq, pos, name, full) of every position; ``full``: the 2**k lines all exist. The last level's names order the suffixes."""
    repeated = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line")
    ranks = _ranked(repeated, ["line"], area, "rank-0")
    base = lines.join(ranks, "line").select("row", "id", "seq", "pos", F.col("rank").alias("name"), F.lit(True).alias("full")).dropDuplicates(["row", "seq"])
    levels = [area.table(base, "level-0")]
    for k in range(most_levels):
        ahead = Window.partitionBy("row").orderBy("seq").rangeBetween(1 << k, 1 << k)
        now = levels[-1]
        pair = now.select("row", "id", "seq", "pos", F.col("name").alias("n1"), F.coalesce(F.max("name").over(ahead), F.lit(-1).cast("long")).alias("n2"), (F.col("full") & F.coalesce(F.max("full").over(ahead), F.lit(False))).alias("full"))
        pair = area.table(pair, f"pair-{k}")
        counted = pair.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("n"), F.max("full").alias("more"))
        ranks = _ranked(counted, ["n1", "n2"], area, f"rank-{k + 1}")
        open_ = not ranks.where("n > 1 and more").isEmpty()  # some repeated run may be longer still
        levels.append(area.table(pair.join(ranks.select("n1", "n2", "rank"), ["n1", "n2"]).select("row", "id", "seq", "pos", F.col("rank").alias("name"), "full"), f"level-{k + 1}"))
        area.drop(f"pair-{k}", f"rank-{k}")
        if not open_:
            break
    return levels


def suffix_array(levels: list[DataFrame], area: WorkArea) -> DataFrame:
    """(i, row, id, seq, before, after): suffixes in order, and the lines that each shares with its two neighbours."""
    order = levels[-1].select("row", "id", "seq", "name").orderBy("name", "row", "seq").withColumn("at", F.monotonically_increasing_id())
    order = area.table(order, "order")
    part, spot = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = order.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one number for each partition
    before, offsets = 0, {}
    for r in sizes:
        offsets[r["part"]] = before
        before += r["n"]
    if not offsets:
        return order.select(F.lit(0).cast("long").alias("i"), "row", "id", "seq", F.lit(0).alias("before"), F.lit(0).alias("after"))
    start = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in offsets.items() for x in kv)), part)
    array = area.table(order.select("row", "id", "seq", (start + spot).alias("i")), "array")
    after = array.select(F.col("row").alias("row2"), F.col("seq").alias("seq2"), (F.col("i") - 1).alias("i"))
    pairs = array.select("i", "row", "seq").join(after, "i").withColumn("lcp", F.lit(0))
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k].where("full").select("row", "seq", "name")
        one = names.select("row", (F.col("seq")).alias("s1"), F.col("name").alias("m1"))
        two = names.select(F.col("row").alias("row2"), F.col("seq").alias("s2"), F.col("name").alias("m2"))
        met = pairs.withColumns({"s1": F.col("seq") + F.col("lcp"), "s2": F.col("seq2") + F.col("lcp")}).join(one, ["row", "s1"], "left").join(two, ["row2", "s2"], "left")
        same = F.coalesce(F.col("m1") == F.col("m2"), F.lit(False))
        pairs = area.table(met.select("row", "seq", "row2", "seq2", "i", (F.col("lcp") + F.when(same, 1 << k).otherwise(0)).alias("lcp")), f"lcp-{k}")
        area.drop(f"lcp-{k + 1}")
    shared = pairs.select("i", F.col("lcp").alias("after"))
    shared = shared.join(pairs.select((F.col("i") + 1).alias("i"), F.col("lcp").alias("before")), "i", "full")
    out = array.join(shared, "i", "left").select("i", "row", "id", "seq", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return area.table(out, "suffixes")


_CHUNK_BITS = 12


def last_start(marks: DataFrame, area: WorkArea, level: int = 0) -> DataFrame:
    """(i, start): the greatest non-null ``start`` up to each ``i``. Chunks of 4,096 places are filled each by itself, and what they hand on is filled in the same way."""
    own = Window.partitionBy("chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.withColumn("chunk", F.shiftright("i", _CHUNK_BITS)).withColumn("start", F.max("start").over(own))
    filled = area.table(filled, f"filled-{level}")
    heads = area.table(filled.groupBy("chunk").agg(F.max("start").alias("start")), f"heads-{level}")
    if heads.count() <= 1:
        return filled.select("i", "start")
    carried = last_start(heads.select(F.col("chunk").alias("i"), "start"), area, level + 1)
    carried = carried.select((F.col("i") + 1).alias("chunk"), F.col("start").alias("carried"))
    return filled.join(carried, "chunk", "left").select("i", F.coalesce("start", "carried").alias("start"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = 1, area: WorkArea | None = None) -> DataFrame:
    """(row, pos, lcp) of every line to delete, in runs of ``least_lines`` or more: ``row`` is the document's key, ``pos`` the line's place, ``lcp`` its longest run."""
    if least_lines < 1:
        raise ValueError("least_lines is at least 1")
    area = area or WorkArea(docs.sparkSession, "line-runs")
    lines = area.table(_lines(docs, id_col, text_col), "lines")
    levels = suffix_names(lines, area)
    suffixes = suffix_array(levels, area)
    starts = last_start(suffixes.select("i", F.when(F.col("before") < least_lines, F.col("i")).alias("start")), area)
    members = suffixes.withColumn("lcp", F.greatest("before", "after")).where(F.col("lcp") >= least_lines).join(starts, "i").drop("before", "after", "i")
    members = area.table(members, "members")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("seq").alias("seq"))
    first = area.table(members.groupBy("start").agg(F.min(place).alias("first")), "first")
    later = members.join(first, "start").where(~((F.col("row") == F.col("first.row")) & (F.col("seq") == F.col("first.seq"))))
    own = F.when(F.col("row") == F.col("first.row"), F.greatest("seq", F.col("first.seq") + least_lines)).otherwise(F.col("seq"))
    stop = F.col("seq") + (least_lines - 1)
    spread = later.where(own <= stop).select("row", "lcp", F.explode(F.sequence(own, stop)).alias("seq"))
    gone = spread.groupBy("row", "seq").agg(F.max("lcp").alias("lcp"))
    return area.table(gone.join(levels[0].select("row", "seq", "pos"), ["row", "seq"]).select("row", "pos", "lcp"), "gone")


def _cut(docs: DataFrame, text_col: str, cut: str, count: str) -> DataFrame:
    """``docs`` without the lines whose places are in the array ``cut``, which ``count`` replaces."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=True))
            texts, counts = [], []
            for text, gone in zip(columns[text_col].to_pylist(), columns.pop(cut).to_pylist(), strict=True):
                counts.append(len(gone or ()))
                if gone:
                    wanted = set(gone)
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in wanted)
                texts.append(text)
            columns[text_col] = pa.array(texts, columns[text_col].type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(counts, pa.int32())], names=[*columns, count])

    fields = [f for f in docs.schema.fields if f.name != cut]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(count, T.IntegerType())]))


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = 1, area: WorkArea | None = None) -> DataFrame:
    """``docs`` with later copies of repeated runs of lines cut from the text, and ``removed_lines`` int, ``longest_run`` int."""
    docs = docs.drop("removed_lines", "longest_run")
    gone = repeated_runs(docs, id_col, text_col, least_lines, area)
    names = docs.columns
    flag, key, cut, longest = (fresh_name(names, x) for x in ("maybe", "row_key", "cut", "longest"))
    per = gone.groupBy(F.col("row").alias(key)).agg(F.collect_set("pos").alias(cut), F.max("lcp").alias(longest))  # one document's lines
    marked = mark_known(docs.withColumn(key, _row_key(id_col, text_col)), F.col(key), gone.select(F.col("row").alias("h")), flag)
    sure = marked.where(~F.col(flag)).select(*names, F.lit(0).alias("removed_lines"), F.lit(0).alias("longest_run"))
    other = marked.where(flag).join(per, key, "left").select(*names, F.coalesce(longest, F.lit(0)).alias(longest), cut)
    return sure.unionByName(_cut(other, text_col, cut, "removed_lines").withColumnRenamed(longest, "longest_run").select(*names, "removed_lines", "longest_run"))
