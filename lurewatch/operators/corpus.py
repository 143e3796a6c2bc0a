"""Corpus set operations: union, de-duplication, conflicts, shuffles, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import strings as S

_SEQ_BITS = 54


def union_corpora(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def dedup_keep_first(df: DataFrame, priority: str = "priority", seq: str = "seq",
                     url: str = "url", label: str = "label") -> DataFrame:
    """One row per URL: the label of the smallest (priority, seq).

    Priority (0..255), sequence number (< 2^54) and the 0/1 label are packed in one
    BIGINT so the aggregate is a hash aggregate with map-side combine; a hot URL
    is reduced to one row per map task before the shuffle.
    """
    packed = ((F.col(priority).cast("bigint") * F.lit(1 << _SEQ_BITS) + F.col(seq).cast("bigint"))
              * 2 + F.col(label).cast("bigint"))
    best = df.groupBy(url).agg(F.min(packed).alias("_p"))
    order = F.shiftright("_p", 1)
    return best.select(
        F.col(url).alias("url"),
        F.col("_p").bitwiseAND(F.lit(1)).cast("int").alias("label"),
        F.shiftright(order, _SEQ_BITS).cast("int").alias("priority"),
        order.bitwiseAND(F.lit((1 << _SEQ_BITS) - 1)).alias("seq"))


def dedup_within_label(df: DataFrame) -> DataFrame:
    """Distinct (url, label): a URL may stay under both labels."""
    return df.select("url", "label").distinct()


def label_conflicts(df: DataFrame) -> DataFrame:
    """URLs that occur under both labels, with the row counts of each."""
    return (df.groupBy("url")
            .agg(F.count_if(F.col("label") == 1).alias("n_phishing"),
                 F.count_if(F.col("label") == 0).alias("n_legit"))
            .filter((F.col("n_phishing") > 0) & (F.col("n_legit") > 0)))


def shuffle_key(seed: int, *cols: str) -> Column:
    parts = [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def shuffle_seeded(df: DataFrame, seed: int = 42, by: tuple[str, ...] = ("url", "label")) -> DataFrame:
    """Deterministic random order: a range-partitioned sort on a keyed md5."""
    return df.withColumn("shuffle_key", shuffle_key(seed, *by)).orderBy("shuffle_key")


def shuffled_position(df: DataFrame, seed: int = 42,
                      by: tuple[str, ...] = ("url", "label")) -> DataFrame:
    """1-based position in the shuffled order without a one-task window.

    The first four hex digits of the key give 65 536 even buckets: positions
    inside a bucket come from a window per bucket, offsets from the prefix sum
    of the bucket counts.
    """
    keyed = df.withColumn("shuffle_key", shuffle_key(seed, *by)).withColumn(
        "_bucket", F.substring("shuffle_key", 1, 4))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_bucket", (F.sum("_n").over(
        Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("_n")).alias("_offset"))  # at most 65 536 rows in all
    ties = [c for c in df.columns]
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("shuffle_key", *ties))
    return (keyed.withColumn("_rn", inside).join(F.broadcast(offsets), "_bucket")
            .withColumn("position", (F.col("_rn") + F.col("_offset")).cast("bigint"))
            .drop("_rn", "_offset", "_bucket"))


def cap_per_group(df: DataFrame, caps: dict[str, int], pos: str = "pos") -> DataFrame:
    """Keep the first ``caps[family]`` rows per (brand, family).

    ``pos`` is the 1-based position inside the group that the generators emit, so
    the cap is a plain filter: no window, no shuffle.
    """
    limit = F.lit(None).cast("int")
    for family, n in caps.items():
        limit = F.when(F.col("family") == family, F.lit(n)).otherwise(limit)
    return df.filter(F.col(pos) <= F.coalesce(limit, F.lit(2**31 - 1)))


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per group in ``order``.

    A rank filter on a window lets Spark drop all but the first ``n`` rows of a
    group in every map task before the shuffle, so hot groups stay small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def bare_domains(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Domains of legitimate path-less https URLs, for the variation generator."""
    slashes = S.count_of(F.col("url"), "/")
    rows = df.filter((F.col("label") == 0) & F.col("url").startswith("https://") & (slashes <= 2))
    domain = F.rtrim(F.replace("url", F.lit("https://"), F.lit("")), F.lit("/"))
    out = rows.select(domain.alias("domain")).filter(
        F.col("domain").contains(".") & (F.length("domain") < 50)).distinct()
    return out if cap is None else out.orderBy("domain").limit(cap)


def corpus_stats(df: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Row counts per class and their ratio (one row)."""
    out = df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("label") == 1).alias("n_phishing"),
        F.count_if(F.col("label") == 0).alias("n_legit"))
    out = out.withColumn("ratio", F.round(F.try_divide(
        F.col("n_phishing").cast("double"), F.col("n_legit").cast("double")), 6))
    if existing is not None:
        before = existing.agg(F.count(F.lit(1)).alias("_before"))
        out = out.crossJoin(before).withColumn("n_added", F.col("n_total") - F.col("_before")).drop(
            "_before")
    return out


def split_stratified(df: DataFrame, seed: int = 42, train_permille: int = 800,
                     url: str = "url") -> DataFrame:
    """Add ``is_train`` by a per-label hash bucket: no shuffle, stable per URL."""
    key = F.concat(F.col(url), F.lit("|"), F.col("label").cast("string"), F.lit(f"|{seed}"))
    return df.withColumn("is_train", S.md5_bucket(key, 1000) < train_permille)


def split_exact(df: DataFrame, seed: int = 42, holdout_permille: int = 200, url: str = "url") -> DataFrame:
    """Add ``is_train``; of each label exactly the rounded share of its distinct (url, label) rows is held out.

    The rows with the smallest md5 keys are held out.  The k-th smallest key of each label
    is found by refining a histogram of key prefixes, three hex digits at a time: every
    step counts only what starts like the key sought, and at most 4096 counts a label
    reach the driver.  Labels are few, as for class weights.  Repeated rows go the same way; a
    NULL label is a label of its own; rows with a NULL url are keyed by the empty text.
    """
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col("label").cast("string"), F.lit("")), F.lit(str(seed))))
    keys = df.select(F.col("label").cast("string").alias("label"), key.alias("key")).distinct()
    need = {r["label"]: (r["n"] * holdout_permille + 500) // 1000
            for r in keys.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    last, open_ = {label: "" for label, n in need.items() if not n}, {label: "" for label, n in need.items() if n}

    def of(label, column="label"):
        return F.col(column).eqNullSafe(F.lit(label).cast("string"))

    while open_:
        inside = reduce(lambda a, b: a | b, [of(label) & F.col("key").startswith(at) for label, at in open_.items()])
        width = 3 + len(next(iter(open_.values())))
        counts = (keys.filter(inside).groupBy("label", F.substring("key", 1, width).alias("at"))
                  .agg(F.count(F.lit(1)).alias("n")).orderBy("label", "at").collect())
        for label in list(open_):
            for row in (r for r in counts if r["label"] == label):
                if row["n"] >= need[label]:
                    open_[label] = row["at"]
                    if row["n"] == need[label] or width >= 32:  # the key's whole prefix is held out
                        last[label] = open_.pop(label) + "g"
                    break
                need[label] -= row["n"]
    out = F.lit(False)
    for label, end in last.items():
        out = out | (of(label, "_label") & (F.col("_key") < end))
    return (df.withColumns({"_key": key, "_label": F.col("label").cast("string")})
            .withColumn("is_train", ~out).drop("_key", "_label"))


def class_weights(df: DataFrame) -> DataFrame:
    """``n / (k * n_c)`` per label (k rows)."""
    labels = Window.partitionBy()  # over the counts: the table is read once
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "label", "n_rows", F.sum("n_rows").over(labels).alias("_n"), F.count(F.lit(1)).over(labels).alias("_k"))
    return counts.select(
        "label", "n_rows",
        (F.col("_n").cast("double") / (F.col("_k") * F.col("n_rows"))).alias("weight"))


def with_class_weight(df: DataFrame) -> DataFrame:
    """Rows with their class weight in ``weight``; the weight table has one row per label."""
    return df.join(F.broadcast(class_weights(df).select("label", "weight")), "label")


def sample_capped(df: DataFrame, n: int = 20_000, seed: int = 42,
                  by: tuple[str, ...] = ("url", "label")) -> DataFrame:
    """At most ``n`` rows picked by keyed md5 (top-n per task, then merged)."""
    return df.withColumn("_k", shuffle_key(seed, *by)).orderBy("_k", *by).limit(n).drop("_k")
