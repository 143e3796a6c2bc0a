"""Dictionary and score-table joins.

Every broadcast goes through ``broadcast_if_small``, which looks at no more than
``bound + 1`` rows of the dictionary.  Larger dictionaries are joined by shuffle,
on distinct keys first, and the result is attached with a salted join so that
one popular host cannot fill a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions import strings as S
from ..functions import urls as U

#: Row bound below which a dictionary is broadcast (short strings: a few MB).
BROADCAST_ROWS = 100_000


def is_small(df: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """At most ``bound`` rows; reads ``bound + 1`` rows at most."""
    return df.limit(bound + 1).count() <= bound


def broadcast_if_small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, bound) else df


def hot_keys(keys: DataFrame, key: str, min_rows: int = 100_000) -> DataFrame:
    """Keys holding more than ``min_rows`` rows and more than 1/10 000 of all rows.

    By that definition there are fewer than 10 000 of them, so the result may
    always be broadcast.
    """
    counts = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
            .filter((F.col("_n") > min_rows) & (F.col("_n") > F.col("_total") / 10_000)
                    & F.col(key).isNotNull())
            .select(F.col(key), F.lit(True).alias("_hot")))


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "left",
                salts: int = 64, keys: DataFrame | None = None,
                min_rows: int = 100_000) -> DataFrame:
    """Equi-join where ``small`` has unique keys and ``big`` may be skewed.

    Only hot keys (and NULLs, which match nothing) are spread over ``salts``
    tasks, by a hash of the whole row; only hot rows of ``small`` are repeated.
    ``keys`` may name a cheaper table with the same key column to count.
    """
    hot = F.broadcast(hot_keys(big if keys is None else keys, key, min_rows))
    row_hash = F.pmod(F.xxhash64(*[F.col(n) for n, t in big.dtypes if "map<" not in t]),
                      F.lit(salts))
    spread = F.coalesce("_hot", F.lit(False)) | F.col(key).isNull()
    left = big.join(hot, key, "left").withColumn(
        "_salt", F.when(spread, row_hash).otherwise(F.lit(0).cast("bigint"))).drop("_hot")
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    right = small.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(
            F.array(F.lit(0).cast("bigint"))))).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _attach(df: DataFrame, keyed: DataFrame, key: str, bound: int) -> DataFrame:
    """Left join ``keyed`` (unique ``key``) to ``df`` by broadcast or salted shuffle."""
    if is_small(keyed, bound):
        return df.join(F.broadcast(keyed), key, "left")
    return salted_join(df, keyed, key)


def suffix_match(df: DataFrame, dim: DataFrame, host: str = "host", domain: str = "domain",
                 bound: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``matched_domain``: the longest dictionary domain the host falls under.

    Small dictionaries: one narrow lookup in a broadcast table for each label
    count.  Large ones: the suffixes of each *distinct* host by shuffle.  Either
    way it is an equi-join, never a nested loop.
    """
    if is_small(dim.select(domain).distinct(), bound):
        flagged, counts = _flagged(df, dim, host, domain)
        longest = [F.when(F.col(f"_hit{k}"), F.substring_index(F.col(host), ".", -k)) for k in reversed(counts)]
        return flagged.select(host, *[c for c in df.columns if c != host], F.coalesce(
            *longest, F.lit(None).cast("string")).alias("matched_domain"))
    hosts = df.select(F.col(host).alias("_host")).distinct()
    suffixes = hosts.select("_host", F.explode(U.host_suffixes(F.col("_host"))).alias("_suffix"))
    # Only suffixes with as many labels as some domain; so bare TLDs, the hottest keys,
    # are looked up only if the dictionary has such entries.
    counts = [r[0] for r in dim.select(F.size(F.split(domain, r"\.")).alias("k")).distinct().collect()]
    suffixes = suffixes.filter(F.size(F.split("_suffix", r"\.")).isin(counts))
    d = dim.select(F.col(domain).alias("_suffix")).distinct()
    best = (suffixes.join(d, "_suffix")
            .groupBy("_host").agg(F.max(F.length("_suffix")).alias("_len")))
    best = best.select(
        F.col("_host").alias(host),
        F.expr("substr(_host, length(_host) - _len + 1)").alias("matched_domain"))
    return _attach(df, best, host, bound)


def _flagged(df: DataFrame, dim: DataFrame, host: str, domain: str) -> tuple[DataFrame, list[int]]:
    """``df`` with ``_hit<k>`` for each number of labels k that the dictionary has, and these numbers, rising.

    One narrow broadcast join each: a k-label domain can only equal the last k labels of the host.
    """
    labels = F.size(F.split(domain, r"\."))
    counts = [r["k"] for r in dim.filter(F.col(domain).isNotNull()).select(labels.alias("k")).distinct().orderBy("k").collect()]
    for k in counts:
        part = dim.filter(labels == k).select(F.col(domain).alias("_key"), F.lit(True).alias(f"_hit{k}")).distinct()
        df = df.join(F.broadcast(part), F.substring_index(F.col(host), ".", -k) == F.col("_key"), "left").drop("_key")
    return df, counts


def suffix_semi(df: DataFrame, dim: DataFrame, host: str = "host", domain: str = "domain",
                bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose host equals or falls under a dictionary domain.

    For a broadcast-size dictionary this is one narrow semi-join per label
    count: a k-label domain can only equal the last k labels of the host.
    """
    if not is_small(dim, bound):
        return suffix_match(df, dim, host, domain, bound).filter(
            F.col("matched_domain").isNotNull()).drop("matched_domain")
    flagged, counts = _flagged(df, dim, host, domain)
    hit = F.lit(False)
    for k in counts:
        hit = hit | F.col(f"_hit{k}").isNotNull()
    return flagged.filter(hit).drop(*[f"_hit{k}" for k in counts])


#: Rows of a reputation table that become a set of literals in the expressions.
LITERAL_ROWS = 20_000


def with_reputation(df: DataFrame, whitelist, bound: int = LITERAL_ROWS):
    """``(df, whitelist)`` ready for expressions over ``host_columns`` output.

    ``whitelist`` may be a sequence or a DataFrame with a ``domain`` column.  A
    table of at most ``bound`` rows becomes a sequence, so that the test stays
    a set lookup.  A larger one is joined to the distinct hosts, and its three
    answers travel as columns.  Both give the same rows.
    """
    if not isinstance(whitelist, DataFrame):
        return df, whitelist
    table = whitelist.select(F.lower("domain").alias("domain")).filter("domain <> ''").distinct()
    rows = table.limit(bound + 1).collect()
    if len(rows) <= bound:
        return df, tuple(sorted(r["domain"] for r in rows)) or ("",)
    if df.isStreaming:
        return _listed_on_stream(df, table, bound), U.Listed()
    hosts = df.select("host", "reg_domain").filter(F.col("host").isNotNull()).distinct()
    found = suffix_match(hosts, table, bound=bound)
    for name, key in (("_wl_host", "host"), ("_wl_reg", "reg_domain")):
        own = table.select(F.col("domain").alias(key), F.lit(True).alias(name))
        found = salted_join(found, own, key)
    host, reg, under = U.Listed.COLUMNS
    flags = found.groupBy("host").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in (host, reg)],
                                      F.max(F.col("matched_domain").isNotNull()).alias(under))
    out = _attach(df, flags, "host", bound)
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in U.Listed.COLUMNS}), U.Listed()


def _listed_on_stream(df: DataFrame, table: DataFrame, bound: int) -> DataFrame:
    """The three answers as stream-static joins: rows are neither folded nor aggregated, so no state is kept.

    A domain with k labels equals the last k labels of a host or nothing: one join for each
    k that the table has (hosts have 127 labels at most, tables a handful of counts).
    """
    labels = F.size(F.split("domain", r"\."))
    counts = [r["k"] for r in table.select(labels.alias("k")).distinct().orderBy("k").collect()]
    keys = [(F.col("host"), None), (F.col("reg_domain"), None)] + [(F.substring_index("host", ".", -k), k) for k in counts]
    for i, (key, k) in enumerate(keys):
        part = table if k is None else table.filter(labels == k)
        part = broadcast_if_small(part.select(F.col("domain").alias("_key"), F.lit(True).alias(f"_hit{i}")), bound)
        df = df.join(part, key == F.col("_key"), "left").drop("_key")
    host, reg, under = U.Listed.COLUMNS
    hits = [F.coalesce(F.col(f"_hit{i}"), F.lit(False)) for i in range(len(keys))]
    return df.withColumns({host: hits[0], reg: hits[1], under: reduce(lambda a, b: a | b, hits[2:])}).drop(
        *[f"_hit{i}" for i in range(len(keys))])


def exact_match(df: DataFrame, dim: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``is_known``: host or registered domain is in the dictionary.

    Needs ``add_domain_parts`` columns.
    """
    d = dim.select(F.col("domain").alias("_d"), F.lit(True).alias("_hit")).distinct()
    use_reg = F.col("host").contains(".") & ~F.col("is_ip")
    keyed = df.withColumn("_reg", F.when(use_reg, F.col("reg_domain")))
    if is_small(d, bound):
        a, b = F.broadcast(d), F.broadcast(d)
        out = keyed.join(a.select(F.col("_d").alias("_a"), F.col("_hit").alias("_ha")),
                         F.col("host") == F.col("_a"), "left")
        out = out.join(b.select(F.col("_d").alias("_b"), F.col("_hit").alias("_hb")),
                       F.col("_reg") == F.col("_b"), "left")
    else:
        out = salted_join(keyed, d.select(F.col("_d").alias("host"), F.col("_hit").alias("_ha")),
                          "host")
        out = salted_join(out, d.select(F.col("_d").alias("_reg"), F.col("_hit").alias("_hb")),
                          "_reg")
    return out.withColumn(
        "is_known", F.col("_ha").isNotNull() | F.col("_hb").isNotNull()
    ).drop("_a", "_b", "_ha", "_hb", "_reg")


def membership(df: DataFrame, dim: DataFrame, key: str, how: str = "left_semi",
               bound: int = BROADCAST_ROWS) -> DataFrame:
    """Semi or anti join on one key."""
    d = dim.select(F.col(dim.columns[0]).alias(key)).distinct()
    return df.join(broadcast_if_small(d, bound), key, how)


def tld_trust(df: DataFrame, dim: DataFrame, default: float = 0.5) -> DataFrame:
    """Add ``tld_trust`` from ``dim(tld, trust)``: unknown -> default, no TLD -> 0."""
    joined = df.join(broadcast_if_small(dim.select("tld", "trust")), "tld", "left")
    return joined.withColumn("tld_trust", F.when(F.col("tld") == "", F.lit(0.0)).otherwise(
        F.coalesce("trust", F.lit(default)))).drop("trust")


def brand_contains(df: DataFrame, brands: DataFrame, text: str = "domain_base") -> DataFrame:
    """Every (row, brand) pair where the text contains the brand.

    A row qualifies only if it contains some brand, so the single-pass regex
    goes first and the pair test runs on the survivors.  The brand table has a
    checked size; beyond it the caller gets the same result from the n-grams of
    the text joined on equality.
    """
    b = brands.select("idx", "brand")
    if is_small(b, 1_000):
        rows = b.orderBy("idx").collect()
        table = F.array(*[F.struct(F.lit(r["idx"]).alias("idx"), F.lit(r["brand"]).alias("brand"))
                          for r in rows])
        hits = F.filter(table, lambda x: F.col(text).contains(x["brand"]))
        return (df.filter(F.col(text).rlike(S.any_of([r["brand"] for r in rows])))
                .withColumn("_b", F.explode(hits))
                .withColumns({"idx": F.col("_b.idx"), "brand": F.col("_b.brand")}).drop("_b"))
    lengths = [r[0] for r in b.select(F.length("brand").alias("n")).distinct().collect()]
    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substr(F.col(text), i, F.lit(n)))

    grams = F.array_distinct(F.flatten(F.array(*[pieces(n) for n in lengths])))
    return df.withColumn("brand", F.explode(grams)).join(b, "brand")


def brand_similarity(df: DataFrame, brands: DataFrame, k: int = 2,
                     domain: str = "domain_base") -> DataFrame:
    """(domain, brand, distance) for distinct domains within ``k`` edits.

    Distinct domains only, so popular hosts cost one comparison; the brand
    table is exploded as an array so no nested-loop join is planned.
    """
    b = brands.select("idx", "brand")
    if not is_small(b, LITERAL_BRANDS):
        return _similar_by_deletions(df.select(F.col(domain).alias("domain_base")).distinct(), b, k)
    pairs = (df.select(F.col(domain).alias("domain_base")).distinct()
             .select("domain_base", F.explode(_brand_array(b)).alias("_b"))
             .select("domain_base", F.col("_b.idx").alias("idx"), F.col("_b.brand").alias("brand")))
    close = pairs.filter(F.abs(F.length("domain_base") - F.length("brand")) <= k)
    return close.withColumn("dist", F.levenshtein("domain_base", "brand", k)).filter(
        F.col("dist") >= 0)


#: Brands that become an array of literals.
LITERAL_BRANDS = 10_000


def deletions(text: Column, k: int) -> Column:
    """A text and all it gives by deleting up to ``k`` characters."""
    out = F.array(text)
    for _ in range(k):
        shorter = F.transform(out, lambda t: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))),
            lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1))))
        out = F.array_distinct(F.concat(out, F.flatten(shorter)))
    return out


def _similar_by_deletions(domains: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Brand tables of any size: texts within ``k`` edits share a text with up to ``k`` deletions."""
    longest = b.agg(F.max(F.length("brand"))).first()[0] or 0
    near = domains.filter(F.length("domain_base") <= longest + k)
    left = near.select("domain_base", F.explode(deletions(F.col("domain_base"), k)).alias("_key"))
    right = b.select("idx", "brand", F.explode(deletions(F.col("brand"), k)).alias("_key"))
    pairs = left.join(right, "_key").select("domain_base", "idx", "brand").distinct()
    return pairs.withColumn("dist", F.levenshtein("domain_base", "brand", k)).filter(F.col("dist") >= 0)


def _brand_array(b: DataFrame, bound: int = LITERAL_BRANDS) -> Column:
    rows = b.orderBy("idx").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"brand table larger than {bound} rows; use brand_similarity")
    return F.array(*[F.struct(F.lit(r["idx"]).alias("idx"), F.lit(r["brand"]).alias("brand"))
                     for r in rows])


def nearest_brand(df: DataFrame, brands: DataFrame, domain: str = "domain_base", literal: int = LITERAL_BRANDS) -> DataFrame:
    """Nearest brand per distinct domain, first in list order on ties; a NULL domain has none.

    Tables beyond ``literal`` rows, of any size, give the same rows by ``_nearest_of_many``.
    """
    domains = df.select(F.col(domain).alias("domain_base")).distinct()
    b = brands.select("idx", "brand")
    if not is_small(b, literal):
        return _nearest_of_many(domains, b)
    scored = F.transform(_brand_array(b), lambda x: F.struct(
        F.levenshtein(F.col("domain_base"), x["brand"]).alias("dist"), x["idx"].alias("idx"),
        x["brand"].alias("brand")))
    return _best_of(domains.withColumn("_best", F.when(F.col("domain_base").isNotNull(), F.array_min(scored))))


def _best_of(found: DataFrame) -> DataFrame:
    return found.select("domain_base", F.col("_best.brand").alias("brand"), F.col("_best.dist").alias("dist"))


def _letters(text: str) -> Column:
    """Which of 63 classes of characters occur, as bits: a text has to change once for each class it lacks."""
    return F.expr(f"aggregate(filter(split({text}, ''), c -> c <> ''), 0L, (m, c) -> m | shiftleft(1L, ascii(c) % 63))")


#: Brands of one length that are compared as one array.
BRAND_BLOCK = 2_000


def _nearest_of_many(domains: DataFrame, brands: DataFrame, block: int = BRAND_BLOCK) -> DataFrame:
    """Nearest brands out of a table of any size; brands and domains are compared at rising lower bounds.

    Brands within two edits are found by common deletions.  Domains without one are compared with
    blocks of brands of one length: first of nearly their own length, which gives a distance to beat, then of the other
    lengths that can still beat or tie with it.  In a block, only brands whose letters allow such a distance are compared.
    Blocks are dealt by hash and repeated for slices of the domains, so that no task holds more than a block and no length is hot.
    """
    from ..sources.feeds import work_dir

    spark = domains.sparkSession

    def saved(df: DataFrame, name: str) -> DataFrame:
        path = work_dir(spark, f"nearest-{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    once = saved(brands.filter(F.col("brand").isNotNull()).groupBy("brand").agg(F.min("idx").alias("idx")), "brands")
    # One row for each length of a brand: bounded by the longest name, not by the table.
    blocks = {r["n"]: -(-r["c"] // block) for r in once.groupBy(F.length("brand").alias("n")).agg(
        F.count(F.lit(1)).alias("c")).collect()}
    if not blocks:
        return domains.select("domain_base", F.lit(None).cast("string").alias("brand"), F.lit(None).cast("int").alias("dist"))
    known = domains.filter(F.col("domain_base").isNotNull())
    near = saved(_similar_by_deletions(known, once, 2).groupBy("domain_base").agg(
        F.min(F.struct("dist", "idx", "brand")).alias("_best")), "near")
    slices = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // sum(blocks.values())))
    per_length = F.create_map(*[F.lit(x) for pair in sorted(blocks.items()) for x in pair])
    dealt = F.pmod(F.xxhash64("brand"), F.element_at(per_length, F.col("_n")))
    lists = (once.withColumn("_n", F.length("brand")).withColumn("_k", dealt).withColumn("_letters", _letters("brand"))
             .groupBy("_n", "_k").agg(F.collect_list(F.struct("idx", "brand", "_letters")).alias("_list"))
             .withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))))
    lists = saved(lists, "blocks")

    def compared(rest: DataFrame, wanted: Column) -> DataFrame:
        """``rest`` with the best of what it had and of the brands whose length, ``n``, is ``wanted``."""
        at = (rest.withColumn("_n", F.explode(F.filter(F.lit(sorted(blocks)), lambda n: wanted(n))))
              .withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), (F.element_at(per_length, F.col("_n")) - 1).cast("long"))))
              .withColumns({"_s": F.pmod(F.xxhash64("domain_base"), F.lit(slices)), "_own": _letters("domain_base")}))

        def may(x: Column) -> Column:
            lacks = [F.bit_count(a.bitwiseAND(F.bitwise_not(b))) for a, b in ((F.col("_own"), x["_letters"]), (x["_letters"], F.col("_own")))]
            return F.greatest(*lacks) <= F.coalesce(F.col("_best.dist"), F.lit(2**31 - 1))

        found = F.array_min(F.transform(F.filter("_list", may), lambda x: F.struct(
            F.levenshtein(F.col("domain_base"), x["brand"]).alias("dist"), x["idx"].alias("idx"), x["brand"].alias("brand"))))
        best = at.join(lists, ["_n", "_k", "_s"]).select("domain_base", found.alias("_best"))
        return rest.unionByName(best).groupBy("domain_base").agg(F.min("_best").alias("_best"))

    def gap(n: Column) -> Column:
        return F.abs(n - F.length("domain_base"))

    far = known.join(near.select("domain_base"), "domain_base", "left_anti").withColumn(
        "_best", F.lit(None).cast(near.schema["_best"].dataType))
    far = saved(compared(saved(far, "far"), lambda n: gap(n) <= 1), "first")
    far = compared(far, lambda n: (gap(n) > 1) & (gap(n) <= F.coalesce(F.col("_best.dist"), F.lit(2**31 - 1))))
    return _best_of(near.unionByName(far)).unionByName(domains.filter(F.col("domain_base").isNull()).select(
        "domain_base", F.lit(None).cast("string").alias("brand"), F.lit(None).cast("int").alias("dist")))


def anti_existing(new: DataFrame, existing: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``new`` whose key does not occur in ``existing``.

    Existing keys are made distinct before the shuffle join; a hot key in
    ``new`` is spread by salting, which an anti-join over replicated distinct
    keys allows.
    """
    keys = existing.select(key).distinct()
    if is_small(keys):
        return new.join(F.broadcast(keys), key, "left_anti")
    return salted_join(new, keys, key, "left_anti")


def join_stage2(df: DataFrame, scores: DataFrame, cfg, url: str = "url",
                source: DataFrame | None = None) -> DataFrame:
    """Attach the visual score table to the rows routed to it.

    Rows outside the trigger band get a NULL key: they match nothing and are
    spread evenly.  ``source`` is the plain input, used to count hot URLs.
    """
    from .verdict import combined_risk, needs_stage2

    routed = needs_stage2(combined_risk(F.col("lex_prob"), F.col("rule_score")), cfg.columns())
    per_url = scores.groupBy(F.col("url").alias("_key")).agg(
        F.max_by(F.struct("prob", "ok", "error", "screenshot"), F.col("ok").cast("int")).alias("_s"))
    keyed = df.withColumn("_key", F.when(
        routed & ~F.col("is_malformed") & ~F.col("is_whitelisted") & (F.col("rule_score") < 0.5),
        F.col(url)))
    if is_small(scores):
        out = keyed.join(F.broadcast(per_url), "_key", "left")
    else:
        counted = keyed if source is None else source.select(F.col(url).alias("_key"))
        out = salted_join(keyed, per_url, "_key", keys=counted)
    s = F.col("_s")
    used = F.coalesce(s["ok"] & s["prob"].isNotNull(), F.lit(False))
    return out.withColumns({
        "vis_prob": F.when(used, s["prob"]),
        "vis_used": used,
        "vis_note": F.when(F.coalesce(s["ok"], F.lit(False)),
                           F.lit("Vision model unavailable -> neutral vision score."))
        .otherwise(F.concat(F.lit("Capture failed: "), F.coalesce(s["error"], F.lit("no capture")))),
        "vis_screenshot": s["screenshot"],
    }).drop("_s", "_key")
