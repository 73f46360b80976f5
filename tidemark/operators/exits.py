"""Path-dependent operators: signal cool-down, trailing-stop exits, trade chaining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import constants as C
from tidemark.operators.asof import asof_join


def cool_down(signals: DataFrame, gap: int = C.COOLDOWN_BARS) -> DataFrame:
    """Keep a signal only when it lies more than ``gap`` rows after the last one kept.

    ``signals`` holds the raw signal rows only (ticker, seq). Their row numbers form one array per
    ticker, at most one entry per trading day.
    """
    def keep(kept: Column, seq: Column) -> Column:
        free = (F.size(kept) == 0) | (seq - F.element_at(kept, -1) > gap)
        return F.when(free, F.concat(kept, F.array(seq))).otherwise(kept)

    ordered = signals.groupBy("ticker").agg(F.array_sort(F.collect_list("seq")).alias("_seqs"))
    kept = F.aggregate("_seqs", F.expr("CAST(array() AS ARRAY<INT>)"), keep)
    return ordered.select("ticker", F.explode(kept).alias("seq"))


def chain_trades(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Trades actually taken: an entry counts only after the exit of the trade before it.

    ``candidates`` has ``keys``, ``seq`` and ``exit_seq`` (null while open). One array per key,
    bounded by the number of trading days.
    """
    def take(state: Column, item: Column) -> Column:
        free = item["seq"] > state["busy_until"]
        until = F.coalesce(item["exit_seq"], F.lit(2**31 - 1))
        return F.when(free, F.struct(
            until.alias("busy_until"), F.concat(state["taken"], F.array(item["seq"])).alias("taken")
        )).otherwise(state)

    items = F.array_sort(F.collect_list(F.struct(F.col("seq"), F.col("exit_seq"))))
    start = F.expr("named_struct('busy_until', -1, 'taken', CAST(array() AS ARRAY<INT>))")
    ordered = candidates.groupBy(*keys).agg(items.alias("_items"))
    taken = ordered.select(*keys, F.explode(F.aggregate("_items", start, take)["taken"]).alias("seq"))
    return candidates.join(taken, keys + ["seq"], "left_semi")


def first_exit(
    entries: DataFrame,
    path: DataFrame,
    keys: list[str],
    rule: Column | dict | None = None,
    by: str | None = None,
    first_block: int = 32,
) -> DataFrame:
    """First bar after each entry that hits the trailing stop or another exit rule.

    ``entries``: ticker, seq, price, atr, k and further ``keys`` that identify an entry.
    ``path``: ticker, seq, date, price, atr and the columns ``rule`` reads as ``bar_...``. The stop starts at
    price - k * atr and rises with the highest price since entry less k * atr of the day; a
    missing range counts as the entry's. ``rule`` names another exit reason or is null; with ``by`` it
    is one rule per value of that column of the entries.

    The next bar that a rule ends is the same for all entries before it, so it is looked up. For the stop, bars are
    summed up in blocks of ``first_block`` (see ``_blocks``): an entry reads the rest of its own block, then one row per block, and the
    bars of the one block in which it ends. All factors share the blocks. Nothing is written in between.
    """
    identity = ["ticker", "seq"] + [k for k in keys if k not in ("ticker", "seq")]
    carried = [c for c in entries.columns if c not in identity]
    bars = path.select("ticker", *[F.col(c).alias(f"bar_{c}") for c in ("seq", "date", "price", "atr")]).withColumn(
        "_block", F.floor(F.col("bar_seq") / first_block).cast("int"))
    todo = entries.where("price IS NOT NULL AND k IS NOT NULL").select(
        *identity, *carried, F.col("price").alias("_high"),
        F.coalesce(F.col("price") - F.col("k") * F.col("atr"), F.lit(float("-inf"))).alias("_stop"),
        F.floor(F.col("seq") / first_block).cast("int").alias("_home"))
    if rule is None:
        todo = todo.withColumns({"_rule_seq": F.lit(None).cast("int"), "_rule": F.lit(None).cast("string")})
    else:
        marked = path.select(*[F.col(c).alias(c if c == "ticker" else f"bar_{c}") for c in path.columns])
        if by is None:
            marked = marked.select("ticker", "bar_seq", rule.alias("_rule"))
        else:
            each = F.array(*[F.struct(F.lit(v).alias(by), r.alias("_rule")) for v, r in rule.items()])
            marked = marked.select("ticker", "bar_seq", F.inline(each))
        todo = asof_join(todo, marked.where("_rule IS NOT NULL"), ["ticker"] + ([by] if by else []), "seq", "bar_seq",
                         {"bar_seq": "_rule_seq", "_rule": "_rule"}, strict=True, forward=True)
    state = ["_high", "_stop", "_home", "_rule_seq", "_rule"]

    def walk(met: DataFrame, hit: str) -> DataFrame:
        """Bar by bar from (_high, _stop): what ends the entry first, and where the bars leave it."""
        so_far = Window.partitionBy(*identity).orderBy("bar_seq") \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = met.withColumn("_h", F.greatest("_high", F.max("bar_price").over(so_far)))
        met = met.withColumn("_s", F.greatest("_stop", F.max(
            F.col("_h") - F.col("k") * F.coalesce("bar_atr", "atr")).over(so_far)))
        reason = F.when(F.col("bar_price") <= F.col("_s"), F.lit("TRAILING_STOP")) \
            .when(F.col("bar_seq") == F.col("_rule_seq"), F.col("_rule"))
        end = F.struct(F.col("bar_seq").alias("exit_seq"), F.col("bar_date").alias("exit_date"),
                       F.col("bar_price").alias("exit_price"), reason.alias("exit_reason"), F.col("_s").alias("exit_stop"))
        rest = [c for c in met.columns if c not in identity + ["_h", "_s", "_high", "_stop"] and not c.startswith("bar_")]
        met = met.withColumns({"_hit": end, "_place": F.when(reason.isNotNull(), F.col("bar_seq"))})
        return met.groupBy(*identity).agg(
            *[F.first(c).alias(c) for c in rest], F.min_by("_hit", "_place").alias(hit), F.max("_h").alias("_high"), F.max("_s").alias("_stop"))

    rule_block = F.floor(F.col("_rule_seq") / first_block).cast("int")
    mine = todo.withColumnsRenamed({"ticker": "_t"}).join(
        bars, (F.col("_t") == F.col("ticker")) & (F.col("_home") == F.col("_block")) & (F.col("bar_seq") > F.col("seq")), "left")
    mine = mine.withColumn("ticker", F.col("_t")).drop("_t", "_block")
    at_home = walk(mine, "_near").select(*identity, *carried, *state, "_near")

    blocks = _blocks(bars).withColumnRenamed("ticker", "_t")
    ahead = at_home.join(blocks, F.col("_near").isNull() & (F.col("_t") == F.col("ticker")) & (F.col("_block") > F.col("_home"))
                         & (F.col("_block") <= F.coalesce(rule_block, F.col("_block"))), "left").drop("_t")
    before = Window.partitionBy(*identity).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.withColumn("_h", F.greatest("_high", F.max("_peak").over(before)))
    ahead = ahead.withColumn("_s", F.greatest("_stop", F.max(_lifted("_h")).over(before)))
    ends = F.coalesce(_ends("_h", "_s"), F.lit(False)) | F.coalesce(F.col("_block") == rule_block, F.lit(False))
    found = ahead.withColumn("_end", F.when(ends, F.col("_block"))).groupBy(*identity).agg(
        *[F.first(c).alias(c) for c in [*carried, *state[2:], "_near"]],
        F.min_by(F.struct("_block", "_h", "_s"), "_end").alias("_at"))
    found = found.select(*identity, *carried, *state[2:], "_near", F.col("_at._block").alias("_block"),
                         F.col("_at._h").alias("_high"), F.col("_at._s").alias("_stop"))
    last = walk(found.join(bars, ["ticker", "_block"], "left"), "_far")
    hit = F.coalesce("_near", F.when(F.col("_block").isNotNull(), F.col("_far")))
    return last.select(*identity, *carried, hit.alias("_hit")).select(*identity, *carried, "_hit.*")


def _blocks(bars: DataFrame) -> DataFrame:
    """What an entry of any factor has to know of a block of bars it has not seen the inside of.

    With H and S the highest price and the stop before the block, p(t) a price, r(t) a range, top(t) and least(t) the highest price and the
    least range of the block up to t: the stop after the block is the greatest of S, H - k * least and all top(u) - k * r(u). A bar
    of the block ends the entry if its price is at or under S, under H - k * least(t) for some t, or under top(u) - k * r(u) for some u
    before it. Only lines that no later bar outdoes are kept. A block that lacks a range keeps its bars.
    """
    block = Window.partitionBy("ticker", "_block").orderBy("bar_seq")
    upto = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward, later = block.rowsBetween(Window.currentRow, Window.unboundedFollowing), block.rowsBetween(1, Window.unboundedFollowing)
    seen = bars.withColumns({
        "_top": F.max("bar_price").over(upto), "_least": F.min("bar_atr").over(upto),
        "_low_onward": F.min("bar_price").over(onward), "_low_later": F.min("bar_price").over(later),
        "_least_later": F.min("bar_atr").over(later)})
    not_outdone = lambda c, later: F.coalesce(F.col(c) < F.col(later), F.lit(True))
    fall = F.when(F.col("_top") > F.col("_low_onward"),
                  F.struct(F.col("_low_onward").alias("low"), F.col("_top").alias("p"), F.col("bar_atr").alias("r")))
    lacking = F.count("bar_atr") < F.count(F.lit(1))
    return seen.groupBy("ticker", "_block").agg(
        F.min("bar_price").alias("_low"), F.max("bar_price").alias("_peak"), F.min("bar_atr").alias("_range"),
        F.collect_list(F.when(not_outdone("bar_atr", "_least_later"), F.struct(
            F.col("_top").alias("p"), F.col("bar_atr").alias("r")))).alias("_lifts"),
        F.collect_list(F.when(not_outdone("bar_price", "_low_later"), F.struct(
            F.col("bar_price").alias("p"), F.col("_least").alias("r")))).alias("_drops"),
        # Greatest factor with which the block ends an entry by itself, but for rounding: beyond it, the lines need not be tried.
        F.max(F.when(F.col("_top") > F.col("_low_onward"), F.when(F.col("bar_atr") > 0, (F.col("_top") - F.col("_low_onward")) / F.col("bar_atr"))
                     .otherwise(float("inf"))).when(F.col("bar_atr") <= 0, float("inf")) * 1.000000001).alias("_worst"),
        F.collect_list(F.when(F.col("bar_atr") <= 0, F.struct(F.col("_low_onward").alias("low"), F.col("_top").alias("p"), F.col("bar_atr").alias("r")))
                       .otherwise(fall)).alias("_falls"),
        F.when(lacking, F.sort_array(F.collect_list(F.struct("bar_seq", F.col("bar_price").alias("p"), F.col("bar_atr").alias("r")))))
        .alias("_loose"))


def _folded(high: Column, stop: Column) -> Column:
    """Highest price, stop and whether it was hit, bar by bar over a block that lacks ranges."""
    def step(now: Column, bar: Column) -> Column:
        top = F.greatest(now["h"], bar["p"])
        level = F.greatest(now["s"], top - F.col("k") * F.coalesce(bar["r"], F.col("atr")))
        return F.struct(top.alias("h"), level.alias("s"), (now["hit"] | F.coalesce(bar["p"] <= level, F.lit(False))).alias("hit"))

    return F.aggregate("_loose", F.struct(high.alias("h"), stop.alias("s"), F.lit(False).alias("hit")), step)


def _lifted(high: str) -> Column:
    """Stop that a block's bars alone leave to an entry that comes in with ``high``."""
    k, h = F.col("k"), F.col(high)
    lines = F.array_max(F.transform("_lifts", lambda x: x["p"] - k * x["r"]))
    return F.when(F.col("_loose").isNotNull(), _folded(h, F.lit(float("-inf")))["s"]) \
        .otherwise(F.greatest(h - k * F.col("_range"), lines))


def _ends(high: str, stop: str) -> Column:
    """Whether some bar of a block is at or under the stop of an entry that comes in with ``high`` and ``stop``."""
    k, h, s = F.col("k"), F.col(high), F.col(stop)
    plain = (F.col("_low") <= s) | F.exists("_drops", lambda x: x["p"] <= h - k * x["r"]) \
        | ((k <= F.col("_worst")) & F.exists("_falls", lambda x: x["low"] <= x["p"] - k * x["r"]))
    return F.when(F.col("_loose").isNotNull(), _folded(h, s)["hit"]).otherwise(plain)
