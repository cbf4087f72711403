"""What each filter removes in every order that a set of filters can be applied in.

The orders form a trie of prefixes; what survives a prefix depends on the set of its filters, not on their order, so that the
trie folds into one state for each set.  The states are visited depth first: each is the persisted survivors of the state before it
less those that the next filter removes, is visited once (memoised by its set), and counts the removals on all edges that leave it.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import dealt_anew, delete_at_exit, drop_written, shared_folder, utf8, written

MOST_FILTERS = 6  # 720 orders, 64 states


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text (null: empty); words are maximal runs of other characters than space and \\t to \\r.

    A: under 50 words; B: under 65 distinct ones in 100, by case; C: over 5 in 100 characters are A-Z; D: holds one of #$%&*|.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(65).cast("long"),
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def with_repeats(rows: DataFrame, text_hash: str, id_col: str, name: str) -> DataFrame:
    """rows with whether an equal text has a smaller id; null ids come after all others, and of equal ids none is smaller.

    Each group's smallest id is an aggregate with partial sums; it comes back by a join on hash and id together, which is as well
    spread as the ids, however large a group of equal texts is.
    """
    least = rows.groupBy(F.col(text_hash).alias("__h")).agg(F.min(id_col).alias("__id")).withColumn("__first", F.lit(True))
    joined = rows.join(least, (F.col(text_hash) == F.col("__h")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    return joined.withColumn(name, F.col("__first").isNull()).drop("__h", "__id", "__first")


def with_marks(rows: DataFrame, id_col: str, marks: DataFrame, marks_id: str, conditions: Mapping[str, Column]) -> DataFrame:
    """rows with a truth value for each condition: whether some row of marks with their id meets it; false without an id."""
    known = marks.groupBy(F.col(marks_id).alias("__id")).agg(*(F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))
    joined = rows.join(dealt_anew(known, "__id"), F.col(id_col) == F.col("__id"), "left").drop("__id")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in conditions})


def audit_filters(rows: DataFrame, part: str, fails: list[str], marks: list[str]) -> DataFrame:
    """One row for each part, order of all filters and step, zeros included; an empty table gives none.

    fails: names of a letter each, of columns that are true where the row fails that filter; marks: columns true for rows whose loss counts.
    Columns: part, filter_order, step, kept (after the step), removed (by it), redundant (failing its filter, removed before), unique_fails (failing no
    other), shapley (what its filter removes, summed over all orders) and, for each mark, <mark>_lost.

    Rows with equal part, outcomes and marks are one row with their number from the start, so that a state holds at most
    2 ** (filters + marks) rows a part, whatever the size of a part.  Nothing but the 600 or so (order, step, state) rows, whose number depends
    on the filters alone, is broadcast.
    """
    if not 1 <= len(fails) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be audited in all orders")
    spark = rows.sparkSession
    bits = {f: 1 << n for n, f in enumerate(fails)}
    failed = reduce(lambda a, b: a + b, (F.when(F.col(f), b).otherwise(0) for f, b in bits.items()))
    kinds = written(rows.select(F.col(part).alias("part"), failed.alias("failed"), *marks).groupBy("part", "failed", *marks).agg(F.count("*").alias("n")), "kinds")
    path = f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    seen: set[int] = set()

    hit = lambda b, m=None: F.coalesce(F.sum(F.when((F.col("failed").bitwiseAND(b) != 0) & (F.col(m) if m else F.lit(True)), F.col("n"))), F.lit(0))
    edges = F.array(*(F.struct(F.lit(f).alias("filter"), hit(b).alias("removed"), *(hit(b, m).alias(f"{m}_lost") for m in marks)) for f, b in bits.items()))

    def visit(state: int, survivors: DataFrame) -> None:
        """Edges of all filters from a state, those of filters that it has taken with zeros: one plan serves all states, and is compiled once."""
        seen.add(state)
        if state + 1 == 1 << len(fails):
            return
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counted = survivors.groupBy("part").agg(F.sum("n").alias("here"), edges.alias("edges"))
        counted.select("part", "here", F.explode("edges").alias("e")).select("part", "here", "e.*").write.parquet(f"{path}/state={state}")
        for b in bits.values():
            if state | b not in seen:
                visit(state | b, survivors.where(F.col("failed").bitwiseAND(b) == 0))
        survivors.unpersist()

    visit(0, kinds)
    drop_written(kinds)
    schema = f"part {kinds.schema['part'].dataType.simpleString()}, here long, filter string, removed long, " + "".join(f"{m}_lost long, " for m in marks) + "state int"
    edges = spark.read.schema(schema).parquet(path)
    # a state that no row of a part reaches has no edge there: all its counts are zero
    n, every = len(fails), (1 << len(fails)) - 1
    orders = []
    for order in itertools.permutations(fails):
        state = 0
        for step, f in enumerate(order, 1):
            orders.append(("".join(order), step, state, f))
            state |= bits[f]
    steps = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, state int, filter string"))
    weight = F.element_at(F.array(*(F.lit(math.factorial(s) * math.factorial(n - 1 - s)).cast("long") for s in range(n))), F.bit_count("state") + 1)
    alone = reduce(lambda c, f: c.when(F.col("filter") == f, every ^ bits[f]), fails, F.when(F.lit(False), 0))
    at = lambda state: F.coalesce(F.max(F.when(F.col("state") == state, F.col("removed"))), F.lit(0))
    totals = edges.groupBy("part", "filter").agg(F.sum(weight * F.col("removed")).alias("shapley"), at(0).alias("failing"), at(alone).alias("unique_fails"))
    found = totals.join(steps, "filter").join(edges, ["part", "state", "filter"], "left")
    lost = [F.coalesce(F.col(f"{m}_lost"), F.lit(0)).alias(f"{m}_lost") for m in marks]
    removed = F.coalesce("removed", F.lit(0))
    kept = F.coalesce(F.col("here") - F.col("removed"), F.lit(0))
    return found.select("part", "filter_order", "step", kept.alias("kept"), removed.alias("removed"), (F.col("failing") - removed).alias("redundant"), "unique_fails", *lost, "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five standard filters over documents by source (null: empty string): those of text_filters, and E, a text that a smaller doc_id has too.

    Marks: good (quality 1) and toxic (toxic 1 in labels).  The text is read once and leaves as a hash of 256 bits and four truth values;
    null and empty texts are equal; rows that share an id are told apart; null ids have no labels.
    """
    text = F.col("text")
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(utf8(text), 256)).alias("hash"), *(c.alias(f) for f, c in text_filters(text).items()))
    rows = with_repeats(written(own, "measured"), "hash", "id", "E").drop("hash")
    rows = with_marks(rows, "id", labels, "doc_id", {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return audit_filters(rows, "part", ["A", "B", "C", "D", "E"], ["good", "toxic"])
