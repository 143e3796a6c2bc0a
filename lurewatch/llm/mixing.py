"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target size; every document of a source then has the same
real number of copies, target / source size.  The whole part is taken at once.
The fractional parts are rounded dependently: two documents meet, and words are
moved at random from one to the other (in expectation nothing changes) until one
of them has a whole copy number.  The other meets the next document.  Each group
of documents so leaves one undecided document at most; these meet again in
larger groups, a reduction tree whose levels are Spark shuffles of ever fewer
rows.  Moves keep the words of a pair constant, so what a source takes differs
from its target by less than its last document.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.joins import is_small, salted_join
from .common import ordered_hash, packed, stored, unpacked, word_count

#: Weights of the sources in the order of their names, repeating. Fixed values of the mix.
WEIGHTS = (5.0, 2.0, 1.0)
#: All targets together, in parts of all sizes; most copies of a document.
SHARE, MOST = 1.5, 2.0
#: Documents that one task rounds at a time, and undecided groups that meet on the next level.
GROUP, FAN_IN = 4096, 256
#: A share this close to a whole number counts as whole.
EPS = 1e-12


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """``(source, _src, source_size, n_docs, target)`` for each source of ``sized``.

    Sources are ranked by code point, NULL last.  Targets are proportional to
    the weights and stop at ``most`` times the source's size; what lies above is
    shared again by weight until no target is above its stop.  Ranking is a range
    sort with offsets per range, the shares are sums: no task holds all sources.
    """
    by_source = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranged = stored(by_source.repartitionByRange(64, F.col("source").asc_nulls_last())
                    .withColumn("_range", F.spark_partition_id()), "mix-sources")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(inside) - 1 + F.col("_before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = stored(ranged.join(F.broadcast(offsets), "_range")
                    .select("source", "source_size", "n_docs", weight.alias("_w"),
                            (F.col("source_size") * F.lit(float(most))).alias("_stop")), "mix-ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.col("_stop") <= F.col("_w") * F.lit(level)
        n, held, left = ranked.agg(
            F.count_if(full), F.sum(F.when(full, F.col("_stop"))), F.sum(F.when(~full, F.col("_w")))).first()
        if n == stopped or not left:
            break
        stopped, level = n, (share * total - (held or 0.0)) / left
    target = F.when(F.lit(bool(left)), F.least(F.col("_w") * F.lit(level), "_stop")).otherwise(F.col("_stop"))
    return ranked.select("source", source_key(F.col("source")).alias("_src"), "source_size", "n_docs",
                         target.alias("target"))


def source_key(source: Column) -> Column:
    """A key that is never NULL, so that the NULL source joins like any other."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _round_group(rows: pa.Table, seed: int) -> pa.Table:
    """Round the shares of one group; at most one stays strictly between 0 and 1."""
    rows = rows.sort_by([("doc_id", "ascending"), ("size", "ascending")])
    first = rows.slice(0, 1).to_pylist()[0]
    key = f"{seed}|{first['_src']}|{first['_level']}|{first['_block']}"
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "little"))
    share, size = rows.column("_share").to_pylist(), rows.column("size").to_pylist()
    held = None
    for i, draw in enumerate(rng.random(len(share)).tolist()):
        if not EPS < share[i] < 1 - EPS:
            share[i] = float(round(share[i]))
            continue
        if held is None:
            held = i
            continue
        p, q, ratio = share[held], share[i], size[held] / size[i]
        up = min(1 - p, q / ratio)            # to the held document
        down = min(p, (1 - q) / ratio)        # from the held document
        step = up if draw * (up + down) < down else -down
        p, q = p + step, q - step * ratio
        p, q = (float(round(x)) if not EPS < x < 1 - EPS else x for x in (p, q))
        share[held], share[i] = p, q
        held = held if 0 < p < 1 else i if 0 < q < 1 else None
    return rows.set_column(rows.schema.get_field_index("_share"), "_share", pa.array(share, pa.float64()))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: int = 7, group: int = GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies`` for every row of ``docs``.

    Size is the number of words.  ``copies`` is the whole part of the source's
    share or one more, so never above ``most``.  Reruns agree on any cluster: the
    draws depend only on ``seed``, the source, and the documents of a group.

    NULL or empty texts have size 0 and no copies, a source whose documents are
    all empty has target 0; the NULL source is a source like any other, after all
    others; NULL ids and repeated rows are rounded as rows of their own; an empty
    table gives no rows; other columns are ignored.
    """
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"),
                               word_count(F.col("text")).alias("size")), "mix-sized")
    targets = stored(source_targets(sized, weights, share, most), "mix-targets")
    most_blocks = max(1, math.ceil((targets.agg(F.max("n_docs")).first()[0] or 0) / group))
    per_source = targets.drop("source")
    keyed = sized.withColumn("_src", source_key(F.col("source")))
    rows = (keyed.join(F.broadcast(per_source), "_src") if is_small(per_source)
            else salted_join(keyed, per_source, "_src", "inner"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.when(F.col("size") > 0, F.floor(ratio)).otherwise(F.lit(0)).cast("long")
    part = F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(F.lit(0.0))
    blocks = F.ceil(F.col("n_docs") / F.lit(group)).cast("long")
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "_src", whole.alias("_whole"),
                       part.alias("_share"), F.lit(0).alias("_level"),
                       ordered_hash(F.col("doc_id"), F.greatest(blocks, F.lit(1).cast("long"))).alias("_block"))
    done, schema = [rows.filter((F.col("_share") <= EPS) | (F.col("_share") >= 1 - EPS))], rows.schema
    rows = rows.filter((F.col("_share") > EPS) & (F.col("_share") < 1 - EPS))
    open_ = (F.col("_share") > 0) & (F.col("_share") < 1)
    while True:
        rows = stored(rows.groupBy("_src", "_block").applyInArrow(
            lambda group_rows: _round_group(group_rows, seed), schema), "mix-level")
        done.append(rows.filter(~open_))
        if most_blocks == 1:
            break
        most_blocks = math.ceil(most_blocks / fan_in)
        rows = rows.filter(open_).withColumn("_level", F.col("_level") + 1).withColumn(
            "_block", F.floor(F.col("_block") / fan_in).cast("long"))
    # One document of a source may be left: it is taken with the probability of its share.
    draw = F.pmod(F.xxhash64(F.lit(seed), "_src", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    done.append(rows.filter(open_).withColumn("_share", (draw < F.col("_share")).cast("double")))
    out = done[0]
    for part_ in done[1:]:
        out = out.unionByName(part_)
    return out.select("doc_id", "size", "source", "source_size", "target",
                      (F.col("_whole") + F.round("_share").cast("long")).alias("copies"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as ``mix`` takes it."""
    mixed = mix(docs, **options)
    key = ["_id", "_src", "_size", "_nth"]

    def keyed(df: DataFrame, size: Column, order: Column, *more) -> DataFrame:
        alike = Window.partitionBy("_id", "_src", "_size").orderBy("_order")
        return df.select(
            F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), source_key(F.col("source")).alias("_src"),
            size.alias("_size"), order.alias("_order"), *more).withColumn("_nth", F.row_number().over(alike))

    copies = keyed(mixed, F.col("size"), -F.col("copies"), "copies").filter("copies > 0").select(*key, "copies")
    rows = keyed(docs, word_count(F.col("text")), F.col("text"), packed(docs.columns))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.join(copies, key).withColumn("_copy", each).select(*unpacked(docs.columns))
