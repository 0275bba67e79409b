"""Matching of target names with listing cards: gates, ensemble, best matches and what is emitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A scorer must exceed GATE for a name to count; means and maxima qualify from LEAST on; pages read per query.
GATE, LEAST, MOST_PAGES = 0.60, 0.70, 30


def target_names(targets: DataFrame) -> DataFrame:
    """A row for each name that a target may go by: its title, then its variants, with their place."""
    return targets.select("row_id", F.posexplode(F.concat(F.array("title"), "names")).alias("name_pos", "target_name"))


def candidates(targets: DataFrame, listings: DataFrame, pages: int = MOST_PAGES) -> DataFrame:
    """Cards of a row's own listing (up to page ``pages``, with a link) against each of the row's names."""
    cards = listings.where((F.col("page_num") <= pages) & F.col("href").isNotNull())
    return cards.join(target_names(targets), "row_id")


def pages_read(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """Listing pages that are read of each row's listing, with the column ``reason`` on the last: why reading stops there.

    ``pages`` has (row_id, page_num, empty_marker, cards, next_page, next_disabled) as captured. Reading
    ends before the cards of a page that shows the empty marker or has no cards, and behind a page
    without a usable link to the next one or the last of ``most`` pages; a page that wasn't captured ends
    it too. One aggregate finds each row's last page, and no listing is gathered.
    """
    stop = (
        F.when(F.coalesce("empty_marker", F.lit(False)), "empty").when(F.coalesce("cards", F.lit(0)) == 0, "no cards").when(~F.coalesce("next_page", F.lit(False)), "no next page")
        .when(F.coalesce("next_disabled", F.lit(False)), "next page disabled").when(F.col("page_num") >= most, "page limit")
    )
    marked = pages.where(F.col("page_num").between(1, most)).withColumn("reason", stop)
    ends = marked.where("reason is not null").groupBy("row_id").agg(F.min(F.struct("page_num", "reason")).alias("_end"))
    numbers = marked.groupBy("row_id").agg(F.collect_set(F.col("page_num").cast("int")).alias("_seen"))  # at most ``most`` numbers
    gap = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(most + 1)), F.col("_seen")))
    bounds = numbers.join(ends, "row_id", "left").select("row_id", (gap - 1).alias("_whole"), "_end")
    last = F.least(F.col("_whole"), F.coalesce(F.col("_end.page_num"), F.col("_whole")))
    read = marked.drop("reason").join(bounds, "row_id").withColumn("_last", last).where("page_num <= _last")
    shown = F.when(F.col("page_num") == F.col("_end.page_num"), F.col("_end.reason")).when(F.col("page_num") == F.col("_last"), "not captured")
    return read.withColumn("reason", shown).where(~F.coalesce(F.col("reason").isin("empty", "no cards"), F.lit(False))).drop("_last", "_whole", "_end")


def passes_gate(*scores: Column) -> Column:
    return F.greatest(*scores) > GATE


def ensemble(pairs: DataFrame, card: list[str], scores: tuple[str, str, str]) -> DataFrame:
    """Per card: avg_score, the largest mean of the three scores, and max_score, the largest of any score,
    over the names that pass the gate; 0 for a card without one. The mean adds in the given order."""
    a, b, c = (F.col(x) for x in scores)
    passed = passes_gate(a, b, c)
    mean = (a + b + c) / 3
    return pairs.groupBy(*card).agg(F.coalesce(F.max(F.when(passed, mean)), F.lit(0.0)).alias("avg_score"), F.coalesce(F.max(F.when(passed, F.greatest(a, b, c))), F.lit(0.0)).alias("max_score"))


def qualified(cards: DataFrame) -> DataFrame:
    return cards.where((F.col("avg_score") > LEAST) | (F.col("max_score") > LEAST))


def best(cards: DataFrame, by: str, key: str, order: list[str]) -> DataFrame:
    """The row of the largest ``by`` of each key, the first in ``order`` of equals. No card is gathered: it is one aggregate."""
    columns = [c for c in cards.columns if c != key]
    first = F.struct((-F.col(by)).alias("_by"), *order)
    return cards.groupBy(key).agg(F.min_by(F.struct(*columns), first).alias("b")).select(key, "b.*")


def emitted(cards: DataFrame, key: str, order: list[str], url: str, parity: bool = False) -> DataFrame:
    """Matches to keep of each key: the best by mean if it reaches LEAST, and the best by maximum if that
    reaches LEAST and has another url. With ``parity`` a maximum of the same url is left out even where
    the mean itself wasn't emitted. Column ``reason`` tells avg or max."""
    columns = [c for c in cards.columns if c != key]
    first = lambda by: F.min_by(F.struct(*columns), F.struct((-F.col(by)).alias("_by"), *order))
    pair = cards.groupBy(key).agg(first("avg_score").alias("a"), first("max_score").alias("m"))  # both in one pass
    same = F.coalesce(F.col(f"m.{url}") == F.col(f"a.{url}"), F.lit(False))
    shadowed = same if parity else same & (F.col("a.avg_score") >= LEAST)
    reasons = F.array(F.when(F.col("a.avg_score") >= LEAST, F.struct("a.*", F.lit("avg").alias("reason"))), F.when((F.col("m.max_score") >= LEAST) & ~shadowed, F.struct("m.*", F.lit("max").alias("reason"))))
    return pair.select(key, F.explode(F.filter(reasons, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def top_by_window(cards: DataFrame, by: str, key: str, order: list[str]) -> DataFrame:
    """Like ``best``, by a window; Spark prunes it to one row a group before the shuffle."""
    window = Window.partitionBy(key).orderBy(F.desc(by), *order)
    return cards.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")
