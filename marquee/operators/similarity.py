"""Exact per-item top-k over shared features, without all-pairs in hot groups.

Items carry weighted features ``(id, feat, w)``. For a query item ``q`` and a
candidate ``c`` the *dot* is ``sum(w_q(f) * w_c(f))`` over shared features.
Two rankings use it:

* ``overlap`` – unweighted (``w = 1``): order by dot desc, then the
  candidate's ``score`` desc, ``title`` asc, id asc;
* ``cosine`` – order by ``dot / (|q| |c|)`` desc, then id asc.

Joining every pair of items that share a feature costs ``sum(df(f)^2)``; one
feature held by a third of all items makes that quadratic. The plan splits
features by document frequency ``df``:

1. **rare** features (``df <= hot_min_df``) are self-joined on the feature.
   Each group yields at most ``hot_min_df^2`` pairs. The default
   ``hot_min_df="auto"`` picks the largest cut whose rare pairs stay within
   ``DEFAULT_PAIR_BUDGET`` pairs per feature row, so the cost is linear in
   the number of feature rows whatever the df distribution.
2. **hot** features are never expanded into pairs. Every item's hot vector
   ``H(c)`` is enumerated into its non-empty sub-vectors ``A`` (2^|H|-1 of
   them; |H| is small: a handful of genres) and each sub-vector keeps only
   its best ``k + 1`` items in the ranking's within-class order
   (``row_number() <= k+1``, planned as a partial WindowGroupLimit before the
   shuffle, so a hot class is cut map-side). A query enumerates the
   sub-vectors of its own hot vector and looks up those short lists.
3. Items with more than ``max_hot`` hot features (none in a curated
   catalogue, which keeps <= 5 cast, 1 director and a few genres) are looked
   for, and look for others, in bounded posting lists (``postings``): k rows
   per query and shard come out, never the pairs of a hot feature. Whether
   there are any is asked by one small job while the plan is built.

Exactness: take ``c`` in the true top-k of ``q`` with no rare feature shared
with ``q`` and let ``A = H(q) ∩ H(c)`` (with c's weights). If ``c`` were not
among the first ``k+1`` items of list ``A``, the ``k+1`` items ahead of it
share at least ``A`` with ``q`` and rank no lower than ``c`` (same or larger
dot, better tie-break), so at least ``k`` items other than ``q`` beat ``c`` –
a contradiction. Candidates that share a rare feature are all found by step
1. If ``q`` or ``c`` is heavy and ``c`` is not among the best ``k`` of its shard
by hot features, those k rank before it in the result too. Every surviving candidate is then re-scored exactly (rare dot + dot of the
two hot vectors) before the final ``row_number() <= k``.

No side that grows with the items is broadcast: a million of them pass the size
check in their packed files, and would be unpacked in the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.postings import best_by_postings

DEFAULT_HOT_MIN_DF = "auto"
DEFAULT_PAIR_BUDGET = 64  # rare-feature pairs allowed per feature row ("auto")
DEFAULT_MAX_HOT = 10

_HV_TYPE = "array<struct<feat:string,w:bigint>>"


def _subsets(hv: Column) -> Column:
    """All non-empty sub-arrays of ``hv`` (order kept), by bit masks."""
    n = F.size(hv)
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 1)
    return F.transform(
        masks,
        lambda m: F.filter(hv, lambda x, i: m.bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0),
    )


def _feats_of(a: Column) -> Column:
    return F.transform(a, lambda x: x["feat"])


def _hot_dot(hq: Column, hc: Column) -> Column:
    mc = F.map_from_entries(hc)
    return F.aggregate(
        hq,
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.coalesce(F.try_element_at(mc, x["feat"]), F.lit(0).cast("bigint")) * x["w"],
    )


def auto_threshold(df: DataFrame, pair_budget: float = DEFAULT_PAIR_BUDGET) -> Column:
    """Scalar-subquery column: the largest document frequency ``T`` such that
    self-joining every feature with ``df <= T`` yields at most
    ``pair_budget`` pairs per feature row (``sum df^2 <= budget * sum df``).

    Computed from the df histogram (one row per distinct df value, at most
    ``sqrt(2 * rows)`` rows), so the window over it is tiny.
    """
    hist = df.groupBy("df").agg(F.count(F.lit(1)).alias("n_feats"))
    running = Window.orderBy("df").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("df").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = hist.select(
        "df",
        F.sum(F.col("n_feats") * F.col("df") * F.col("df")).over(running).alias("pairs"),
        F.sum(F.col("n_feats") * F.col("df")).over(whole).alias("rows"),
    )
    fits = cum.where(F.col("pairs") <= F.col("rows") * F.lit(float(pair_budget)))
    return fits.agg(F.coalesce(F.max("df"), F.lit(1)).cast("bigint").alias("t")).scalar()


def feature_table(feats: DataFrame, hot_min_df: int | str, pair_budget: float = DEFAULT_PAIR_BUDGET) -> DataFrame:
    """``(id, feat, w, hot)`` with ``hot = df(feat) > hot_min_df``; with
    ``hot_min_df="auto"`` the cut comes from :func:`auto_threshold`."""
    df = feats.groupBy("feat").agg(F.count(F.lit(1)).alias("df"))
    cut = auto_threshold(df, pair_budget) if hot_min_df == "auto" else F.lit(int(hot_min_df))
    hot = df.where(F.col("df") > cut).select("feat", F.lit(True).alias("hot"))
    return feats.join(hot, "feat", "left").withColumn("hot", F.coalesce(F.col("hot"), F.lit(False)))


def topk_shared(
    feats: DataFrame,
    items: DataFrame,
    k: int,
    mode: str = "overlap",
    queries: DataFrame | None = None,
    hot_min_df: int | str = DEFAULT_HOT_MIN_DF,
    max_hot: int = DEFAULT_MAX_HOT,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Top ``k`` candidates per query item.

    ``feats``: distinct ``(id, feat, w)`` with ``w > 0``.
    ``items``: ``(id, score, title)`` for ``overlap``; ``(id)`` for ``cosine``.
    ``queries``: optional ``(id)`` restricting the query side.
    ``carry``: further ``items`` columns copied to the output rows.

    Returns ``(q, c, dot, sim, rank, <candidate attributes>)``; ``sim`` is
    the cosine for ``cosine`` and equals ``dot`` for ``overlap``.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if mode not in ("overlap", "cosine"):
        raise ValueError(f"unknown mode {mode!r}")
    attrs = ["score", "title"] if mode == "overlap" else []
    attrs += [c for c in carry if c not in attrs]
    tagged = feature_table(feats.select("id", "feat", F.col("w").cast("bigint").alias("w")), hot_min_df)

    norms = tagged.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n2"))
    hv = tagged.where("hot").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("feat", "w"))).alias("hv"))
    it = (
        items.select("id", *attrs)
        .join(norms.hint("merge"), "id")
        .join(hv.hint("merge"), "id", "left")
        .withColumn("hv", F.coalesce(F.col("hv"), F.array().cast(_HV_TYPE)))
    )
    qit = it if queries is None else it.join(queries.select("id").hint("merge"), "id", "left_semi")

    cand_cols = ["c", *attrs, "c_n2", "hc"]

    def cand_side(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in ("id", "n2", "hv", *attrs)]
        return df.select(*keep, F.col("id").alias("c"), *attrs, F.col("n2").alias("c_n2"), F.col("hv").alias("hc"))

    # 1. rare features: bounded self-join on the feature; a candidate's row has
    # all that its ranking needs, so no pair is moved to be looked up
    rare = tagged.where(~F.col("hot")).select("id", "feat", "w")
    rq = rare if queries is None else rare.join(queries.select("id").hint("merge"), "id", "left_semi")
    rare_c = (
        rq.select("feat", F.col("id").alias("q"), F.col("w").alias("q_w"))
        .join(cand_side(rare.join(it.hint("merge"), "id")).hint("merge"), "feat")
        .where(F.col("q") != F.col("c"))
        .select("q", (F.col("q_w") * F.col("w")).alias("rare_dot"), *cand_cols)
    )

    # 2. hot features: per sub-vector short lists
    if mode == "overlap":
        list_order = [F.col("score").desc_nulls_last(), F.col("title").asc_nulls_last(), F.col("c")]
    else:
        list_order = [F.col("c_n2").asc(), F.col("c")]
    small = it.where((F.size("hv") >= 1) & (F.size("hv") <= max_hot))
    lists = (
        cand_side(small)
        .withColumn("A", F.explode(_subsets(F.col("hc"))))
        .withColumn("rn", F.row_number().over(Window.partitionBy("A").orderBy(*list_order)))
        .where(F.col("rn") <= k + 1)
        .withColumn("akey", _feats_of(F.col("A")))
        .drop("rn", "A")
    )
    qsub = (
        qit.where((F.size("hv") >= 1) & (F.size("hv") <= max_hot))
        .select(F.col("id").alias("q"), F.explode(_subsets(F.col("hv"))).alias("A"))
        .select("q", _feats_of(F.col("A")).alias("akey"))
    )
    sub_c = qsub.join(lists.hint("merge"), "akey").where(F.col("q") != F.col("c")).select(
        "q", F.lit(0).cast("bigint").alias("rare_dot"), *cand_cols
    )

    # 3. items with many hot features: bounded posting lists, both ways
    hot_items = it.where(F.size("hv") >= 1)
    is_heavy = F.size("hv") > max_hot
    as_query = lambda df: df.select(F.col("id").alias("q"), "n2", "hv")
    as_cand = lambda df: df.select(F.col("id").alias("c"), "n2", "hv", *[a for a in ("score", "title") if mode == "overlap"])
    sources = [rare_c, sub_c]
    heavy = hot_items.where(is_heavy)
    if heavy.limit(1).count():
        count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
        n_heavy, n_hot = count(heavy), count(hot_items)
        q_hot = qit.where(F.size("hv") >= 1)
        direct = best_by_postings(as_query(q_hot.where(is_heavy)), as_cand(hot_items), k, mode, n_heavy, n_hot)
        direct = direct.unionByName(best_by_postings(as_query(q_hot.where(~is_heavy)), as_cand(heavy), k, mode, n_hot, n_heavy))
        # the items are hashed where they are: the many pairs need no sorting
        sources.append(cand_side(direct.withColumnRenamed("c", "id").join(it.hint("shuffle_hash"), "id")).select("q", F.lit(0).cast("bigint").alias("rare_dot"), *cand_cols))

    # the pairs are moved once, by query: grouping, the query's own vector and
    # the ranking all find them there
    pairs = reduce(DataFrame.unionByName, sources)
    cands = pairs.repartition("q").groupBy("q", *cand_cols).agg(F.sum("rare_dot").alias("rare_dot"))
    qattr = qit.select(F.col("id").alias("q"), F.col("n2").alias("q_n2"), F.col("hv").alias("hq"))
    scored = cands.join(qattr.hint("shuffle_hash"), "q").withColumn("dot", F.col("rare_dot") + _hot_dot(F.col("hq"), F.col("hc")))
    if mode == "overlap":
        scored = scored.withColumn("sim", F.col("dot").cast("double"))
        order = [F.col("dot").desc(), F.col("score").desc_nulls_last(), F.col("title").asc_nulls_last(), F.col("c")]
    else:
        scored = scored.withColumn("sim", F.col("dot") / (F.sqrt(F.col("q_n2")) * F.sqrt(F.col("c_n2"))))
        order = [F.col("sim").desc(), F.col("c")]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("q", "c", "dot", "sim", "rank", *attrs)
