"""Benchmark decontamination by templates: typed placeholders, window hashes, slot consistency.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Tokens of a template window. An item with fewer tokens is one window of its length, down to LEAST_TOKENS.
WINDOW = 8
LEAST_TOKENS = 4
#: Windows of an item that must match one after the other's place; half of them for an item of few windows.
MATCHED_WINDOWS = 6
#: So many tokens of an item one after another as they stand count whatever the slots around them: two windows end to end.
LITERAL_TOKENS = 2 * WINDOW
#: Benchmark windows that are broadcast; a larger benchmark, counted first, is joined by shuffle.
BROADCAST_WINDOWS = 500_000
#: Words that are units of measure and become a placeholder after a number or alone.
UNITS = ("mm cm m km g kg mg l ml s ms min h hz khz mhz ghz w kw v a pa kpa bar j kj cal kcal mol ft in yd mi lb oz "
         "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters "
         "litre litres second seconds minute minutes hour hours day days week weeks month months year years percent "
         "degree degrees celsius fahrenheit dollar dollars euro euros cent cents mile miles inch inches foot feet pound pounds").split()

_TOKEN = r"(?:^|[.!?:;\n][\s\"'(\[]*)?(?:\p{N}+(?:[.,]\p{N}+)*|\p{L}+|[%$€£°])"
_OPENS = r"^[.!?:;\n]"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Words, numbers and unit signs of a text, each with the sentence end before it, if there is one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), 0)


def _value(token: Column) -> Column:
    """The token without the sentence end before it."""
    return F.regexp_extract(token, r"[\p{N}\p{L}%$€£°].*$", 0)


def _template(token: Column, place: Column) -> Column:
    """``<n>``, ``<u>`` or ``<x>`` for a number, a unit or a name, else the word in lower case.

    A name is a word with a capital letter that does not begin a sentence or the text.
    """
    opens = (place == 0) | token.rlike(_OPENS)
    kind = lambda lower, other: F.when(lower.isin(*UNITS), "<u>").otherwise(other)
    plain = _let(F.lower(token), lambda low: kind(low, low))
    full = _let(_value(token), lambda v: F.when(v.rlike(r"^\p{N}"), "<n>").when(v.rlike(r"^[%$€£°]"), "<u>")
                .otherwise(kind(F.lower(v), F.when(v.rlike(r"^\p{Lu}") & ~opens, "<x>").otherwise(F.lower(v)))))
    # Most tokens begin with a to z: no sentence end before them, no number, no name.
    return F.when((token >= "a") & (token < "{"), plain).otherwise(full)


def _literal(token: Column) -> Column:
    """The token as it stands, in lower case."""
    return F.lower(F.when((token >= "a") & (token < "{"), token).otherwise(_value(token)))


def _canonical(docs: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """Key, token values and the hashes of their templates and of themselves of every row with a key."""
    rows = docs.where(docs[key].isNotNull()).select(docs[key].alias(name), tokens(docs[text]).alias("t"))
    return rows.select(name, "t", F.transform("t", lambda t, i: F.xxhash64(_template(t, i))).alias("hash"),
                       F.transform("t", lambda t: F.xxhash64(_literal(t))).alias("literal"))


def _windows(rows: DataFrame, width: int, name: str) -> DataFrame:
    """Key, place, hash of templates (``w``) and of literal tokens (``v``) of every window of ``width`` tokens."""
    of = lambda c: F.xxhash64(*[F.get(c, F.col("pos") + j) for j in range(width)])
    return (rows.where(F.size("hash") >= width)
            .select(name, "hash", "literal", F.explode(F.sequence(F.lit(0), F.size("hash") - width)).alias("pos"))
            .select(name, "pos", of("hash").alias("w"), of("literal").alias("v")))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold a benchmark item or the same question with other numbers, names or units.

    One row per document and item: doc, item, n_windows, first_token, last_token, n_slots, changed, kind
    (``verbatim`` or ``reparameterised``).

    Both sides become templates: numbers, units and names (capitalised inside a sentence) are placeholders,
    other words are lower-cased, punctuation does not count. Windows of 8 tokens are joined by the hash of their
    templates; item windows of which less than half are words, by that of their tokens in lower case. Matches of one document and item whose places
    differ by the same amount belong together. They count when they are at least 6 windows, or half of
    the item's, and when their slots are consistent: one value of the item always stands for
    one value in the document and the other way round. Of a stretch with inconsistent slots, the longest run of
    literally equal tokens counts if it has 16 or more. Of several passages the one with most windows
    is reported, then the first.

    Rows without a key, missing and empty texts match nothing; repeated document keys are one document
    of all its rows' passages; items with fewer than 4 tokens cannot be told from chance and are not
    searched. Other columns are ignored; an empty table on either side gives an empty result.
    """
    left = _canonical(docs, key, text, "doc")
    # The same text under two item ids stays two items.
    items = _canonical(benchmark, item, item_text, "item").withColumn(
        "plain", F.transform("t", lambda t, i: F.when(_template(t, i).startswith("<"), 0).otherwise(1)))
    widths = [r.w for r in items.select(F.least(F.lit(WINDOW), F.size("hash")).alias("w")).where(f"w >= {LEAST_TOKENS}").distinct().orderBy("w").collect()]
    if not widths:
        widths = [WINDOW]
    hits = None
    for width in widths:  # at most 5 different widths
        own = items.where(F.size("hash") >= width) if width == WINDOW else items.where(F.size("hash") == width)
        worded = 2 * F.aggregate(F.slice("plain", F.col("pos") + 1, F.lit(width)), F.lit(0), lambda a, x: a + x) >= width
        windows = (_windows(own, width, "item").join(own.select("item", "plain"), "item")
                   .select("item", F.col("pos").alias("item_pos"), F.when(worded, F.col("w")).otherwise(F.col("v")).alias("w"),
                           F.size("plain").alias("size")).distinct())
        distinct = windows.select("w").distinct()
        if distinct.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
            distinct = F.broadcast(distinct)
        # A window of plain words has one hash for both.
        either = _windows(left, width, "doc").select("doc", "pos", F.explode(F.array_distinct(F.array("w", "v"))).alias("w"))
        found = either.join(distinct, "w", "left_semi").join(windows, "w").withColumn("width", F.lit(width))
        hits = found if hits is None else hits.unionByName(found)

    runs = (hits.withColumn("shift", F.col("pos") - F.col("item_pos"))
            .groupBy("doc", "item", "shift", "width", "size")
            .agg(F.countDistinct("item_pos").alias("n_windows"), F.min("pos").alias("first"), (F.max("pos") + F.first("width") - 1).alias("last"))
            .where(F.col("n_windows") >= F.least(F.lit(MATCHED_WINDOWS), F.ceil((F.col("size") - F.col("width") + 1) / 2))))

    # Slot values of both sides over the stretch that matched.
    placed = (runs.join(left.select("doc", F.col("t").alias("doc_t")), "doc").join(items.select("item", F.col("t").alias("item_t")), "item"))
    at = F.sequence("first", "last")
    pairs = F.filter(F.transform(at, lambda p: F.struct(
        _template(F.get("doc_t", p), p).alias("kind"), F.lower(_value(F.get("doc_t", p))).alias("d"),
        _template(F.get("item_t", p - F.col("shift")), p - F.col("shift")).alias("item_kind"),
        F.lower(_value(F.get("item_t", p - F.col("shift")))).alias("i"))),
        lambda s: s["kind"].startswith("<") & (s["kind"] == s["item_kind"]))

    def longest(run: Column, p: Column) -> Column:
        """Length of the literal run that ends at ``p``, and the longest so far with its last token."""
        n = F.when(_literal(F.get("doc_t", p)) == _literal(F.get("item_t", p - F.col("shift"))), run["n"] + 1).otherwise(0)
        return _let(n, lambda m: F.struct(m.alias("n"), F.greatest(run["best"], m).alias("best"), F.when(m > run["best"], p).otherwise(run["end"]).alias("end")))

    judged = (placed.withColumn("slots", F.array_distinct(pairs))
              .withColumn("consistent", (F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["d"])))))
                          & (F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["i"]))))))
              .withColumn("run", F.when(~F.col("consistent"), F.aggregate(
                  at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("best"), F.lit(-1).alias("end")), longest)))
              .where(F.col("consistent") | (F.col("run.best") >= LITERAL_TOKENS)))
    # An inconsistent stretch is cut down to its longest literal run.
    whole = lambda c, run: F.when(F.col("consistent"), F.col(c)).otherwise(run)
    judged = judged.withColumns({
        "n_windows": whole("n_windows", F.col("run.best") - F.col("width") + 1),
        "first": whole("first", F.col("run.end") - F.col("run.best") + 1), "last": whole("last", F.col("run.end"))})
    judged = (judged.withColumn("slots", whole("slots", F.array_distinct(pairs)))
              .withColumn("changed", F.size(F.filter("slots", lambda s: s["d"] != s["i"]))))
    best = F.max(F.struct("n_windows", (-F.col("first")).alias("order"), F.col("last"), F.size("slots").alias("n_slots"), "changed"))
    return (judged.groupBy("doc", "item").agg(best.alias("b"))
            .select("doc", "item", F.col("b.n_windows").alias("n_windows"), (-F.col("b.order")).alias("first_token"), F.col("b.last").alias("last_token"),
                    F.col("b.n_slots").alias("n_slots"), F.col("b.changed").alias("changed"),
                    F.when(F.col("b.changed") > 0, "reparameterised").otherwise("verbatim").alias("kind")))


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})
