"""Amount evidence: tolerance joins and component sums.

Items are (row_id, doc, amount, budget_item); page amounts are (doc, page, pos, value,
budget_item). Tolerances are strict and on doubles, so one-cent neighbours may match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.lineage import cut

TOLERANCE = 0.01
#: Same-page components are searched for amounts below this only.
COMPONENT_LIMIT = 10_000


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def nearby(c: Column) -> Column:
    """The cents keys that an amount within TOLERANCE may have."""
    return F.explode(F.sequence(cents(c) - 1, cents(c) + 1))


def payable(items: DataFrame) -> DataFrame:
    """items with an amount to match."""
    return items.filter(F.col("amount").isNotNull() & (F.col("amount") != 0))


def exact_hits(items: DataFrame, page_amounts: DataFrame) -> DataFrame:
    """(row_id, doc, page, pos, value): page amounts within TOLERANCE of the item's.

    An equi-join on document and cents, items standing under three neighbouring keys; the
    tolerance is what is left to test. Neither side is broadcast by assumption.
    """
    keyed = payable(items).select("row_id", "doc", F.col("amount").cast("double").alias("target"), nearby(F.col("amount").cast("double")).alias("cents"))
    values = page_amounts.select("doc", "page", "pos", "value", cents(F.col("value")).alias("cents"))
    return keyed.join(values, ["doc", "cents"]).filter(F.abs(F.col("value") - F.col("target")) < TOLERANCE).select("row_id", "doc", "page", "pos", "value")


def first_exact(items: DataFrame, page_amounts: DataFrame) -> DataFrame:
    """Of each item and page the first position that hits."""
    hits = exact_hits(items, page_amounts)
    return hits.groupBy("row_id", "doc", "page").agg(F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos"))


def component_hits(items: DataFrame, page_amounts: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(row_id, doc, page, size, positions, values): the first component sum of each page.

    Two to four amounts at different places of one page add up to the item's amount; the
    smallest size wins, then the first positions in order. Amounts attributed to another
    budget item stay out (F16). Pages in exclude(row_id, doc, page) don't count.

    Items of a document that ask for the same amount under the same budget item are one goal.
    """
    asked = payable(items).filter(F.col("amount") < COMPONENT_LIMIT).select("row_id", "doc", F.coalesce("budget_item", F.lit(NOBODY)).alias("own"), F.col("amount").cast("double").alias("target"))
    values = page_amounts.select("doc", "page", "pos", "value", F.col("budget_item").alias("owner"))
    goal = ["doc", "own", "target"]
    found = first_sums(asked.select(*goal).distinct(), values, goal, ["page"])
    met = asked.join(found, goal).select("row_id", "doc", "page", "size", "positions", "values")
    return met if exclude is None else met.join(exclude.select("row_id", "doc", "page"), ["row_id", "doc", "page"], "left_anti")


def cross_page_hits(items: DataFrame, page_amounts: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(row_id, doc, size, positions, values): the first sum of 2 to 4 pages' largest amounts; positions are pages.

    Pages in closed(row_id, doc, page) don't count.
    """
    values = largest_per_page(page_amounts).select("doc", F.col("page").alias("pos"), "value", F.lit(None).cast("string").alias("owner"))
    goals = payable(items).select("row_id", "doc", F.lit(NOBODY).alias("own"), F.col("amount").cast("double").alias("target"))
    if closed is not None:
        goals = goals.join(closed.groupBy("row_id").agg(F.collect_set("page").alias("gone")), "row_id", "left")
    return first_sums(goals, values, ["row_id", "doc", "own", "target"], []).select("row_id", "doc", "size", "positions", "values")


def largest_per_page(page_amounts: DataFrame) -> DataFrame:
    """(doc, page, value, pos): the largest amount, the first on ties."""
    best = F.max(F.struct("value", (-F.col("pos")).alias("back"))).alias("best")
    return page_amounts.filter(F.col("value").isNotNull()).groupBy("doc", "page").agg(best).select("doc", "page", F.col("best.value").alias("value"), (-F.col("best.back")).alias("pos"))


#: Stands for a missing budget item, which no amount is attributed to.
NOBODY = "\0"


def placed(values: DataFrame, place: list[str]) -> DataFrame:
    """values(doc, place, pos, value, owner) with how many of their place come before and after, and these ones' least and largest."""
    here = Window.partitionBy("doc", *place)
    up = here.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    down = here.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    told = {f"{f}_{side}": made("value").over(w) for side, w in (("before", up), ("after", down)) for f, made in (("n", F.count), ("low", F.min), ("high", F.max))}
    return values.select("doc", *place, "pos", "value", "owner", *(c.alias(n) for n, c in told.items()))


def pair_sums(values: DataFrame, place: list[str]) -> DataFrame:
    """(doc, place, p1, p2, v1, v2, owner, cents, n_before, n_after, low_after, high_after): the sums of all pairs of a place's values, once for all items; stored.

    values: as placed() has them; n_before is of the first, the rest of the second. A pair belongs to the
    budget item that either value belongs to; one of two budget items is in no sum, so it isn't listed.
    """
    a = values.select("doc", *place, F.col("pos").alias("p1"), F.col("value").alias("v1"), F.col("owner").alias("o1"), "n_before")
    b = values.select("doc", *place, F.col("pos").alias("p2"), F.col("value").alias("v2"), F.col("owner").alias("o2"), "n_after", "low_after", "high_after")
    met = a.join(b, ["doc", *place]).filter((F.col("p1") < F.col("p2")) & F.coalesce(F.col("o1") == F.col("o2"), F.lit(True)))
    return cut(met.select("doc", *place, "p1", "p2", "v1", "v2", F.coalesce("o1", "o2").alias("owner"), cents(F.col("v1") + F.col("v2")).alias("cents"), "n_before", "n_after", "low_after", "high_after"))


#: Places of this many values or fewer list all their sums, against documents of this many asked cents or fewer; others meet in the middle.
LISTED, ASKED = 32, 1024


def first_sums(goals: DataFrame, values: DataFrame, goal: list[str], place: list[str], listed: int = LISTED, most: int = ASKED) -> DataFrame:
    """(goal, place, size, positions, values): of each goal and place the first 2 to 4 values that sum to the target.

    goals: the columns of goal, among them doc, own and target, and perhaps gone, an array of
    positions that don't count; values: doc, place, pos, value, owner. Sums are taken in the
    order of positions, left to right, as doubles; the smallest size, then the first
    positions win.

    A place's values are one row, which meets the cents that its document's goals ask for; its sums are
    listed there, and only those that somebody asks for go on. Places of more than `listed` values, and documents that ask for more than `most`
    cents, go through middle_sums().
    """
    goals = cut(goals)
    one = F.struct("pos", "value", "owner")
    places = cut(values.filter("value IS NOT NULL").groupBy("doc", *place).agg(F.array_sort(F.collect_list(one)).alias("vs")).filter(F.size("vs") > 1))
    # two cents around leave room for how products by 100 are rounded; the tolerance is tested on the sums
    around = F.explode(F.sequence(cents(F.col("target")) - 2, cents(F.col("target")) + 2))
    wanted = cut(goals.select("doc", around.alias("cents")).groupBy("doc").agg(F.collect_set("cents").alias("wanted")))
    long, many = F.size("vs") > listed, F.size("wanted") > 5 * most
    found = listed_sums(goals, places.filter(~long).join(wanted.filter(~many), "doc"), goal, place)
    if places.filter(long).isEmpty() and wanted.filter(many).isEmpty():
        return found
    asking = wanted.select("doc", many.alias("many"))
    rest = places.join(asking, "doc").filter(long | F.col("many")).select("doc", *place, F.explode("vs").alias("v")).select("doc", *place, "v.*")
    return found.unionByName(middle_sums(goals.join(rest.select("doc").distinct(), "doc", "left_semi"), rest, goal, place))


def listed_sums(goals: DataFrame, places: DataFrame, goal: list[str], place: list[str]) -> DataFrame:
    """first_sums() of places(doc, place, vs, wanted): every sum is made once, in its place's row; a third and fourth value may be none."""
    begun = places.select("doc", *place, "vs", "wanted", F.posexplode("vs").alias("i", "a"))
    after = lambda at: F.slice("vs", F.col(at) + 2, F.size("vs"))

    none = F.array(F.lit(None).cast(places.schema["vs"].dataType.elementType))

    def added(rows: DataFrame, before: str, n: str, end: bool) -> DataFrame:
        """rows with each later value as n, its place in vs as _n; where a sum may end, also with none. Values of two budget items are in no sum."""
        options = F.when(F.col(before).isNull(), none).otherwise(F.concat(none, after(before))) if end else after(before)
        met = rows.select("*", F.posexplode(options).alias("_at", n))
        met = met.withColumn(f"_{n}", F.when(F.col(n).isNotNull(), F.col(before) + F.col("_at") + (0 if end else 1))).drop("_at")
        both = F.col("owner").isNull() | F.col(f"{n}.owner").isNull() | (F.col("owner") == F.col(f"{n}.owner"))
        return met.filter(both).withColumn("owner", F.coalesce("owner", f"{n}.owner"))

    rows = added(begun.withColumn("owner", F.col("a.owner")), "i", "b", False)
    rows = added(rows, "_b", "c", True)
    rows = added(rows, "_c", "d", True)
    total = F.col("a.value") + F.col("b.value") + F.coalesce("c.value", F.lit(0.0)) + F.coalesce("d.value", F.lit(0.0))
    parts = F.array_compact(F.array("a", "b", "c", "d"))
    met = rows.select("doc", *place, "wanted", "owner", total.alias("total"), parts.alias("parts")).filter(F.array_contains("wanted", cents(F.col("total"))))
    sums = met.select("doc", *place, "owner", "total", cents(F.col("total")).alias("cents"), F.struct(F.size("parts").alias("size"), F.transform("parts", lambda v: v["pos"]).alias("positions"), F.transform("parts", lambda v: v["value"]).alias("values")).alias("hit"))
    asked = goals.withColumn("cents", F.explode(F.sequence(cents(F.col("target")) - 2, cents(F.col("target")) + 2)))
    near = asked.join(sums, ["doc", "cents"]).filter((F.abs(F.col("total") - F.col("target")) < TOLERANCE) & (F.col("owner").isNull() | (F.col("owner") == F.col("own"))))
    if "gone" in goals.columns:
        near = near.filter(~F.coalesce(F.arrays_overlap("hit.positions", "gone"), F.lit(False)))
    key = [*goal, *place]
    return near.groupBy(*key).agg(F.min("hit").alias("best")).select(*key, "best.size", "best.positions", "best.values")


def middle_sums(goals: DataFrame, values: DataFrame, goal: list[str], place: list[str]) -> DataFrame:
    """first_sums() of places of any number of values.

    All pairs of values are summed once, whatever the number of goals. Twos meet goals on the
    cents of the target. Goals without one go on, at places whose values can reach the target: a
    goal with the last value of a three, or the first pair of a four, meets the pair that is missing on
    its cents. Only what leaves two values, between which the missing sum can lie, is
    listed, and the neighbouring cents stand at the pairs, not at what goals make of them.
    """
    goals, values = cut(goals), cut(placed(values, place))
    pairs = pair_sums(values, place)
    key = [*goal, *place]
    free = lambda owner: F.col(owner).isNull() | (F.col(owner) == F.col("own"))

    def hits(met: DataFrame, n: int) -> DataFrame:
        total = F.col("v1") + F.col("v2")
        for i in range(3, n + 1):
            total = total + F.col(f"v{i}")
        positions = F.array(*(f"p{i}" for i in range(1, n + 1)))
        near = met.filter(F.abs(total - F.col("target")) < TOLERANCE)
        if "gone" in met.columns:
            near = near.filter(~F.coalesce(F.arrays_overlap(positions, "gone"), F.lit(False)))
        shown = near.select(*key, F.struct(F.lit(n).alias("size"), positions.alias("positions"), F.array(*(f"v{i}" for i in range(1, n + 1))).alias("values")).alias("hit"))
        return cut(shown.groupBy(*key).agg(F.min("hit").alias("best")).select(*key, "best.size", "best.positions", "best.values"))

    two = hits(goals.withColumn("cents", nearby(F.col("target"))).join(pairs, ["doc", "cents"]).filter(free("owner")), 2)
    low, high = F.min("value"), F.max("value")
    reach = values.groupBy("doc", *place).agg(F.count(F.lit(1)).alias("n"), F.least(3 * low, 4 * low).alias("low"), F.greatest(3 * high, 4 * high).alias("high")).filter("n > 2")
    able = goals.join(reach, "doc").filter((F.col("target") > F.col("low") - TOLERANCE) & (F.col("target") < F.col("high") + TOLERANCE)).drop("n", "low", "high")
    able = cut(able.join(two.select(*key), key, "left_anti"))

    def missing(begun: DataFrame, had: Column, side: str) -> DataFrame:
        """begun with the cents of the pair that it lacks, where two values of that side may make them."""
        lack = F.col("target") - had
        may = (lack > 2 * F.col(f"low_{side}") - 2 * TOLERANCE) & (lack < 2 * F.col(f"high_{side}") + 2 * TOLERANCE)
        return begun.filter(free("owner") & may).drop("owner", f"low_{side}", f"high_{side}").withColumn("cents", cents(lack))

    def pair(p: str, q: str, at: str) -> DataFrame:
        """The pairs with two values on the other side, or one, as positions and values at p and q, under three neighbouring cents."""
        listed = pairs.filter(at).select("doc", *place, F.col("p1").alias(f"p{p}"), F.col("p2").alias(f"p{q}"), F.col("v1").alias(f"v{p}"), F.col("v2").alias(f"v{q}"), "owner", "cents")
        return listed.withColumn("cents", F.explode(F.sequence(F.col("cents") - 1, F.col("cents") + 1)))

    third = values.filter("n_before > 1").select("doc", *place, F.col("pos").alias("p3"), F.col("value").alias("v3"), "owner", "low_before", "high_before")
    ends = missing(able.join(third, ["doc", *place]), F.col("v3"), "before")
    three = hits(ends.join(pair("1", "2", "n_after > 0"), ["doc", *place, "cents"]).filter((F.col("p2") < F.col("p3")) & free("owner")), 3)
    rest = able.join(three.select(*key), key, "left_anti")
    first = pairs.filter("n_after > 1").select("doc", *place, "p1", "p2", "v1", "v2", "owner", "low_after", "high_after")
    begun = missing(rest.join(first, ["doc", *place]), F.col("v1") + F.col("v2"), "after")
    four = hits(begun.join(pair("3", "4", "n_before > 1"), ["doc", *place, "cents"]).filter((F.col("p2") < F.col("p3")) & free("owner")), 4)
    return two.unionByName(three).unionByName(four)


def first_sum(one: DataFrame, group: tuple[str, ...], pos: str) -> DataFrame:
    """(group, size, positions, values): first_sums() of groups with a target and values of their own: group, target, pos, value."""
    g = list(group)
    own = one.withColumn("doc", F.struct(*g))
    goals = own.select("doc", F.lit(NOBODY).alias("own"), "target").distinct()
    found = first_sums(goals, own.select("doc", F.col(pos).alias("pos"), "value", F.lit(None).cast("string").alias("owner")), ["doc", "own", "target"], [])
    return found.select(*(F.col("doc")[c].alias(c) for c in g), "size", "positions", "values")


def amount_page_scores(items: DataFrame, page_amounts: DataFrame) -> DataFrame:
    """M3: (row_id, doc, page, score, strategy, values): .95 exact, .85 components, else no row."""
    exact = cut(first_exact(items, page_amounts))
    parts = component_hits(items, page_amounts, exclude=exact)
    return exact.select("row_id", "doc", "page", F.lit(0.95).alias("score"), F.lit("exact").alias("strategy"), F.array("value").alias("values")).unionByName(
        parts.select("row_id", "doc", "page", F.lit(0.85).alias("score"), F.lit("component").alias("strategy"), "values")
    )


def amount_candidates(items: DataFrame, page_amounts: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """M4: the best page of each item, none of closed(row_id, doc, page); the lowest page on ties."""
    best = F.max(F.struct("score", (-F.col("page")).alias("back"), "strategy", "values")).alias("best")
    scored = amount_page_scores(items, page_amounts)
    if closed is not None:
        scored = scored.join(closed.select("row_id", "page"), ["row_id", "page"], "left_anti")
    scored = scored.groupBy("row_id", "doc").agg(best)
    return scored.select("row_id", "doc", (-F.col("best.back")).alias("page"), "best.score", "best.strategy", "best.values")


def amount_route(items: DataFrame, page_amounts: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """M5: (row_id, doc, pages, score, strategy, evidence): M4, and where it has nothing the cross-page sum (.80).

    evidence: the amounts that were found, each with its page, in the order of the sum.
    """
    items = cut(items.select("row_id", "doc", "budget_item", "amount"))
    same = cut(amount_candidates(items, page_amounts, closed))
    rest = items.join(same.select("row_id"), "row_id", "left_anti")
    cross = cross_page_hits(rest, page_amounts, closed)
    there = F.transform("values", lambda v: F.struct(F.col("page").cast("int").alias("page"), v.alias("value")))
    across = F.zip_with("positions", "values", lambda p, v: F.struct(p.cast("int").alias("page"), v.alias("value")))
    return same.select("row_id", "doc", F.array("page").alias("pages"), "score", "strategy", there.alias("evidence")).unionByName(
        cross.select("row_id", "doc", F.array_sort("positions").alias("pages"), F.lit(0.80).alias("score"), F.lit("cross-page").alias("strategy"), across.alias("evidence"))
    )


def page_offsets(files: DataFrame) -> DataFrame:
    """files(doc, path, page_count) with the pages before each in its virtual document."""
    earlier = Window.partitionBy("doc").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("page_offset", F.coalesce(F.sum("page_count").over(earlier), F.lit(0)))


#: Pages of a document that are placed together.
STRETCH = 1024


def resolve_pages(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs(doc, page, ...) with path and local page, null beyond the files: offset < page <= offset + count.

    As-of: files and references are put in one order by page, and each reference looks back to
    the last file that begins before it. A document is cut into stretches of STRETCH pages, and
    a file stands in each stretch it reaches, so no document is one key. Files without pages
    hold nothing.
    """
    stretch = lambda page: F.floor(page / STRETCH).cast("long")
    at, end = F.col("page_offset").cast("long"), (F.col("page_offset") + F.col("page_count")).cast("long")
    begin = files.filter("page_count > 0").select(F.col("doc").alias("_doc"), F.explode(F.sequence(stretch(at), stretch(end))).alias("_stretch"), at.alias("_at"), F.struct("path", "page_count", "page_offset").alias("_file"), F.lit(None).cast(refs.schema.simpleString()).alias("_ref"))
    page = F.col("page").cast("long")
    asked = refs.select(F.col("doc").alias("_doc"), stretch(page).alias("_stretch"), page.alias("_at"), F.lit(None).cast(begin.schema["_file"].dataType).alias("_file"), F.struct(*refs.columns).alias("_ref"))
    # the page that a file's offset names is the last of the file before, so references go first on ties
    back = Window.partitionBy("_doc", "_stretch").orderBy("_at", F.col("_ref").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = begin.union(asked).withColumn("_file", F.last("_file", ignorenulls=True).over(back)).filter("_ref IS NOT NULL")
    inside = (F.col("_at") > F.col("_file.page_offset")) & (F.col("_at") <= F.col("_file.page_offset") + F.col("_file.page_count"))
    found = met.withColumn("_file", F.when(inside, F.col("_file")))
    return found.select("_ref.*", F.col("_file.path").alias("path"), (F.col("_ref.page") - F.col("_file.page_offset")).alias("local_page"))
