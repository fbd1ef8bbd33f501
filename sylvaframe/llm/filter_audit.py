"""Filter interaction audit: what each filter removes, keeps and repeats, in every order of the filters.

A document's failures are a mask with one bit a filter, made of columns in one pass over the
texts. All that the audit reports depends on the mask, the part and two labels only, so the
documents are counted into cells first: at most 4 * 2^filters a part. Each cell is folded over
the array of all orders by higher-order functions: an order gives one struct of counts a step,
weighted with the cell's documents, and the cells of a part are added up element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import small
from .common import SPACE

#: What a step counts, in documents.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: The filters on a document's own text, and the one on equal texts of smaller ids.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, r"[#$%&*|]"
TEXT_FILTERS, REPEAT_FILTER = "ABCD", "E"


def text_failures(docs: DataFrame) -> DataFrame:
    """docs (text, and others) without the text, with A, B, C, D: whether it fails the filter of that letter.

    A: under 100 words. B: under 80 of 100 words are distinct. C: over 10 of 100 characters are one of A-Z. D: it has one of # $ % & * |.
    A text without words fails A alone."""
    split = docs.withColumn("pieces", F.split("text", SPACE))
    # Only the first and the last piece can be empty.
    first, last = F.col("pieces")[0] == "", (F.size("pieces") > 1) & (F.element_at("pieces", -1) == "")
    words = F.size("pieces") - first.cast("int") - last.cast("int")
    distinct = F.size(F.array_distinct("pieces")) - (first | last).cast("int")
    capitals = F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))
    counted = split.withColumns({"n_words": words.cast("long"), "n_distinct": distinct.cast("long"), "n_capitals": capitals.cast("long"), "D": F.col("text").rlike(SYMBOLS)})
    found = {"A": F.col("n_words") < LEAST_WORDS, "B": 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"), "C": 100 * F.col("n_capitals") > MOST_CAPITALS * F.length("text"), "D": F.col("D")}
    return counted.select(*(c for c in docs.columns if c != "text"), *(v.alias(k) for k, v in found.items()))


def mask_of(failures: list[Column]) -> Column:
    """An int with bit k set where the k-th failure holds."""
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(failures)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, good, toxic, n): documents by their failures and labels; bit 4 of mask is a text that a smaller id has.

    Equal texts are counted by digest and id, so a group of copies is added up before it meets in one place, and only counts do."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    masks = text_failures(rows).select("doc_id", "part", "digest", mask_of([F.col(x) for x in TEXT_FILTERS]).alias("mask"))
    is_one = lambda c: F.max(F.coalesce(F.col(c).cast("int") == 1, F.lit(False))).alias(c)
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    known = masks.join(small(marks), "doc_id", "left").withColumns({"good": F.coalesce("quality", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    by_id = known.groupBy("digest", "mask", "part", "good", "toxic", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("doc_id").isNotNull()
    grouped = by_id.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("nameless"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("least"))
    # Few rows a text are left: one for each part and label.
    winner = F.min("least.doc_id").over(Window.partitionBy("digest"))
    both = grouped.withColumn("winner", winner).withColumn("first", F.when(F.col("least.doc_id") == F.col("winner"), F.col("least.n")).otherwise(0) + F.col("nameless"))
    one = lambda mask, n: F.struct(mask.alias("mask"), n.alias("n"))
    split = both.select("part", "good", "toxic", F.explode(F.array(one(F.col("mask"), F.col("first")), one(F.col("mask").bitwiseOR(1 << len(TEXT_FILTERS)), F.col("n") - F.col("first")))).alias("e"))
    return split.select("part", "good", "toxic", "e.*").filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _fold(cell: Column, orders: Column) -> Column:
    """One struct of COUNTS for each order and step: the cell's documents, as they go through the filters in that order."""
    n = cell["n"]
    some = lambda condition: F.when(condition, n).otherwise(F.lit(0).cast("long"))
    kind = "array<struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>"

    def step(state: Column, bit: Column) -> Column:
        fails = cell["mask"].bitwiseAND(bit) != 0
        here = state["alive"] & fails
        counted = F.struct(
            some(state["alive"] & ~fails).alias("kept"), some(here).alias("removed"), some(fails & ~state["alive"]).alias("redundant"),
            some(cell["mask"] == bit).alias("unique_fails"), some(here & cell["good"]).alias("good_lost"), some(here & cell["toxic"]).alias("toxic_lost"),
        )
        return F.struct((state["alive"] & ~fails).alias("alive"), F.concat(state["steps"], F.array(counted)).alias("steps"))

    start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step)["steps"]))


def fold_cells(counted: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, *COUNTS, shapley) from cells (part, mask, good, toxic, n) whose bit k is the filter letters[k]: a row for each part, order and step."""
    ways = list(permutations(range(len(letters))))
    orders = F.array(*(F.array(*(F.lit(1 << k) for k in way)) for way in ways))  # a constant, sent with the plan
    zero = F.array_repeat(F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS)), len(ways) * len(letters))
    add = lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS))
    # At most 4 * 2^len(letters) cells a part.
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    steps = parts.select("part", F.aggregate("cells", zero, lambda total, cell: F.zip_with(total, _fold(cell, orders), add)).alias("steps"))
    bits = F.array(*(F.lit(k) for way in ways for k in way))
    of_filter = lambda k: F.aggregate(F.zip_with("steps", bits, lambda s, b: F.when(b == k, s["removed"]).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    totals = steps.withColumn("totals", F.array(*(of_filter(k) for k in range(len(letters)))))
    rows = totals.select("part", "totals", F.posexplode("steps").alias("at", "s"))
    names, at = F.array(*(F.lit("".join(letters[k] for k in way)) for way in ways)), F.col("at")
    return rows.select("part", F.get(names, F.floor(at / len(letters)).cast("int")).alias("filter_order"), (at % len(letters) + 1).cast("int").alias("step"), "s.*", F.get("totals", F.get(bits, at)).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the filters A to E in all 120 orders.

    A part is a value of part_col; null counts as the empty string. Null texts count as empty. E fails for a text that a row with a smaller id has; rows
    with a null id neither fail it nor make others fail, and rows that repeat an id and its text don't make each other fail. Each row counts. Of several
    labels of an id, 1 counts; ids without any have neither label. An empty table gives no rows."""
    return fold_cells(cells(docs, labels, part_col, id_col, text_col), TEXT_FILTERS + REPEAT_FILTER)


AUDIT_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, CAST(len(words) < 100 AS INT) AS a, CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT) AS b,
    CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) AS c, CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS d, CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS INT) AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
),
cells AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
p AS (SELECT '' AS o UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(o) < 5 AND NOT contains(o, x)),
s AS (SELECT o, step, 1 << (ascii(substr(o, step, 1)) - 65) AS bit, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))) AS before FROM p, (SELECT unnest(range(1, 6)) AS step) WHERE length(o) = 5),
r AS (
  SELECT part, o AS filter_order, step, bit, sum(n) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit = 0) AS kept, sum(n) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit > 0) AS removed,
    sum(n) FILTER (WHERE mask & coalesce(before, 0) > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit > 0) AS good_lost, sum(bad) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit > 0) AS toxic_lost
  FROM cells, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM r
"""
