"""Operator 10: removal of repeated line runs, by a suffix array over line-ID sequences.

Only DataFrame and SQL functions. The lines of a document that hold a word are a sequence of line IDs. Distributed prefix doubling
sorts all suffixes of all documents by their first 1, 2, 4 ... lines: the rank of a block of 2^k lines orders it among all blocks of
that length, and comes from the ranks of its halves, by a range sort of the distinct pairs of ranks. Blocks that occur once are
dropped as soon as they are ranked, as no repeated run holds one, so later rounds see repeated text only.

Suffixes that share their first m lines are an interval of the suffix array with a longest common prefix of m lines or more. Where
2^k <= m < 2^(k+1), the ranks of the blocks of 2^k lines at both ends of these lines (they overlap) name the interval. A run of lines
with at least `min_words` words that also occurs earlier (by doc_id, then line) is deleted. Such maximal repeats of any length are
exactly covered by their shortest parts: the shortest run from each line forward and the shortest run up to each line backward that
reach `min_words`. (Take a line of a repeated run. Either its forward run ends inside the repeat, or the backward run from the
repeat's end contains it.) So only intervals of those lengths are looked up, and doubling stops at `min_words` lines, or
earlier, when no block is left that is repeated and shorter than such a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.llm.common import WORD, join_hot, let, saved, table, text_of

MIN_WORDS = 50


def _sequences(docs: DataFrame) -> DataFrame:
    """id, h (the row), p (place among the lines with words), i (line number), w (words), a, b (96 bits of the line's hash)."""
    text = text_of(docs)
    line = lambda x, i: F.struct(
        i.alias("i"), F.regexp_count(x, F.lit(WORD)).alias("w"), F.xxhash64(x).alias("a"), F.hash(x).cast("long").alias("b")
    )
    worded = F.filter(F.transform(F.split(text, "\n", -1), line), lambda s: s["w"] > 0)
    return docs.select(docs["doc_id"].alias("id"), F.xxhash64(text).alias("h"), F.posexplode(worded).alias("p", "s")).select("id", "h", "p", "s.*")


def ranked(rows: DataFrame) -> DataFrame:
    """rows (saved) whose pair (a, b) occurs twice or more, with r in its stead: r orders the pairs as (a, b) does.

    Equal pairs are counted before they are shuffled; the distinct ones are sorted by ranges, where a number that grows with partition and
    place is the rank. Rows meet ranks by a join that takes any share of rows in one pair.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.groupBy("a", "b").agg(F.count("*").alias("__n")).where("__n > 1")
    ranks = saved(pairs.repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b").withColumn("r", F.monotonically_increasing_id()))
    return join_hot(rows, ranks, ["a", "b"], "__n", rows.count()).drop("a", "b", "__n")


def _lengths(rows: DataFrame, min_words: int) -> DataFrame:
    """rows (id, h, p, i, w, r) as blocks of one line: first and last line number (i, j), words in all (w), of the first and of the
    last line (wf, wl); forward, backward: lines of the shortest run of min_words words from the first line on or up to the last
    one, null if the lines that are left do not reach them; end, begin: the last and the first line number of these runs.

    A line is in the forward run of another if fewer than min_words words lie from that one up to it. Runs over a gap count as none.
    """
    own = Window.partitionBy("id", "h")
    placed = rows.withColumn("s", F.sum("w").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.withColumn("s", F.coalesce("s", F.lit(0))).withColumn("c", F.col("s") + F.col("w"))
    ahead, back = own.orderBy("s").rangeBetween(0, min_words - 1), own.orderBy("c").rangeBetween(1 - min_words, 0)
    n, m = F.count("*").over(ahead), F.count("*").over(back)
    forward = F.when((F.sum("w").over(ahead) >= min_words) & (F.max("p").over(ahead) == F.col("p") + n - 1), n.cast("int"))
    backward = F.when((F.sum("w").over(back) >= min_words) & (F.min("p").over(back) == F.col("p") - m + 1), m.cast("int"))
    ends = F.max("i").over(ahead).alias("end"), F.min("i").over(back).alias("begin")
    return placed.select("id", "h", "p", "i", F.col("i").alias("j"), "w", F.col("w").alias("wf"), F.col("w").alias("wl"), "r", forward.alias("forward"), backward.alias("backward"), *ends)


def _intervals(blocks: DataFrame, k: int) -> DataFrame:
    """id, h, m, x, y, first_line, last_line of the shortest runs of 2^k to 2^(k+1) - 1 lines whose blocks of 2^k lines all
    occur twice or more: (m, x, y) names the suffix array's interval, x and y being the ranks of the run's first and last block."""
    size = 1 << k
    own = Window.partitionBy("id", "h").orderBy("p")
    block = F.struct("p", "r", "forward")
    ahead, back = (F.collect_list(block).over(own.rowsBetween(*x)) for x in ((0, size - 1), (1 - size, 0)))
    known = blocks.withColumn("ahead", F.when(F.col("forward").between(size, 2 * size - 1), F.get(ahead, F.col("forward") - size)))
    known = known.withColumn("all_back", F.when(F.col("backward").between(size, 2 * size - 1), back))
    known = known.withColumn("back", F.get("all_back", F.size("all_back") - 1 - F.col("backward") + size)).drop("all_back")
    run = lambda m, x, y, i, j: F.struct(F.col(m).alias("m"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(i).alias("first_line"), F.col(j).alias("last_line"))
    up = F.when(F.col("ahead.p") == F.col("p") + F.col("forward") - size, run("forward", "r", "ahead.r", "i", "end"))
    # a backward run that is the forward run of its first line is listed there
    down = F.when((F.col("back.p") == F.col("p") - F.col("backward") + size) & ~F.col("back.forward").eqNullSafe(F.col("backward")), run("backward", "back.r", "r", "begin", "j"))
    return known.select("id", "h", F.explode(F.filter(F.array(up, down), lambda x: x.isNotNull())).alias("run")).select("id", "h", "run.*")


def _doubled(blocks: DataFrame, k: int, min_words: int) -> DataFrame:
    """From blocks of 2^k lines those of twice as many, with (a, b) the ranks of their halves. Blocks that are too long to be part of
    a shortest run are left out."""
    size = 1 << k
    own = Window.partitionBy("id", "h").orderBy("p")
    later = F.lead(F.struct("p", "j", "w", "wl", "r", "backward", "begin"), size).over(own)
    both = blocks.withColumn("t", later).where(F.col("t.p") == F.col("p") + size)
    both = both.select("id", "h", "p", "i", "t.j", (F.col("w") + F.col("t.w")).alias("w"), "wf", "t.wl", F.col("r").alias("a"), F.col("t.r").alias("b"), "forward", "t.backward", "end", "t.begin")
    return both.where((F.col("w") - F.col("wl") < min_words) | (F.col("w") - F.col("wf") < min_words))


def intervals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, h, m, x, y, first_line, last_line: all shortest runs of min_words words whose blocks are repeated, named by interval."""
    rows = saved(_sequences(docs))
    own = ranked(rows)
    if not rows.where("p = 0").groupBy("id", "h").count().where("count > 1").isEmpty():
        own = own.dropDuplicates(["id", "h", "p"])  # fully equal rows
    blocks, found, k = saved(_lengths(own, min_words)), None, 0
    while True:
        new = _intervals(blocks, k)
        found = new if found is None else found.unionByName(new)
        if 2 << k > min_words:
            return found
        halves = saved(_doubled(blocks, k, min_words))
        if halves.isEmpty():
            return found
        blocks, k = saved(ranked(halves)), k + 1


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, h, spans: per row of docs with deletions, array<struct<first_line,last_line>> of the runs to delete.

    Lines are numbered from 0. Rows of one doc_id are told apart by h, a hash of their text; fully equal rows count as one.
    """
    runs = saved(intervals(docs, min_words))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "first_line")
    name = ["m", "x", "y"]
    firsts = saved(runs.groupBy(*name).agg(F.min(place).alias("origin"), F.max(place).alias("latest"), F.count("*").alias("__n")).where("origin != latest").drop("latest"))
    later = join_hot(runs, firsts, name, "__n", runs.count()).where(place != F.col("origin"))
    return later.groupBy("id", "h").agg(F.collect_set(F.struct("first_line", "last_line")).alias("spans"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated line runs deleted from text, and two columns more: __ql_lines and __ql_removed, the
    number of lines before and the deleted ones (array<int>, ascending).

    A run is a stretch of lines with at least `min_words` words in all; lines without a word are passed over when runs are
    compared and go with a shortest run that surrounds them. The first occurrence, by doc_id (null last), a hash of the text and line,
    stays. Fully equal rows count as one occurrence and stay alike. Null texts stay null; a text may become empty. Other columns
    are untouched.
    """
    found = repeats(docs, min_words).select(F.col("id").alias("__ql_id"), F.col("h").alias("__ql_h"), F.col("spans").alias("__ql_spans"))
    text = text_of(docs)
    same = docs["doc_id"].eqNullSafe(found["__ql_id"]) & (F.xxhash64(text) == found["__ql_h"])
    joined = docs.join(found, same, "left").drop("__ql_id", "__ql_h")
    text = F.coalesce("text", F.lit(""))
    inside = F.array_sort(F.array_distinct(F.flatten(F.transform("__ql_spans", lambda s: F.sequence(s["first_line"], s["last_line"])))))
    gone = F.when(F.col("__ql_spans").isNull(), F.array().cast("array<int>")).otherwise(inside)
    marked = joined.select("*", F.size(F.split(text, "\n", -1)).alias("__ql_lines"), gone.alias("__ql_removed")).drop("__ql_spans")
    # a map look-up keeps long documents from a scan of all deleted lines for every line
    kept = let(F.map_from_arrays("__ql_removed", F.transform("__ql_removed", lambda _: F.lit(True))), lambda m: F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.when(F.try_element_at(m, i).isNull(), x)), lambda x: x.isNotNull()))
    return marked.withColumn("text", F.when(F.size("__ql_removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")))


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("__ql_lines").alias("n_lines"), F.size("__ql_removed").alias("n_removed"), F.array_join("__ql_removed", ",").alias("removed"), "text")


OP10_SQL = rf"""
WITH lines AS (
  SELECT doc_id, line, i, len(regexp_extract_all(line, '{WORD}')) AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents)),
worded AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM lines WHERE w > 0),
runs AS (
  SELECT 0 AS kind, a.doc_id, a.i AS s, b.i AS e FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.i >= a.i
  WHERE b.c - a.c + a.w >= {MIN_WORDS} AND b.c - b.w - a.c + a.w < {MIN_WORDS}
  UNION ALL
  SELECT 1, a.doc_id, a.i, b.i FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.i >= a.i
  WHERE b.c - a.c + a.w >= {MIN_WORDS} AND b.c - a.c < {MIN_WORDS}),
named AS (
  SELECT r.kind, r.doc_id, r.s, r.e, string_agg(l.line, chr(10) ORDER BY l.i) AS name
  FROM runs r JOIN worded l ON l.doc_id = r.doc_id AND l.i BETWEEN r.s AND r.e GROUP BY ALL),
later AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM lines l JOIN later r ON l.doc_id = r.doc_id AND l.i BETWEEN r.s AND r.e)
SELECT l.doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(g.i) AS INT) AS n_removed,
  coalesce(string_agg(CAST(g.i AS VARCHAR), ',' ORDER BY g.i), '') AS removed,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
"""
