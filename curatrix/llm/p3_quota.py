"""Problem 3: a sample of distinct images whose categories have given shares.

Images are grouped into strata by the set of categories they may serve. A max-flow from categories to strata tells how
many images each category can get when all are served together, minimums first. These numbers are spread over the strata
in proportion to their images, which gives a fractional two-way table of quotas (category by stratum). It is made integer
by max-flow: every cell becomes its floor or ceiling, every category keeps its total, and every stratum its total rounded
down or up. Within a stratum images are ordered by a random key (a seeded hash of their id) and the first ones are taken,
exactly as many as the stratum's cells ask for.

Only the counts of strata come to the driver (sets of the few categories that really occur). The key that ends a
stratum's quota is found from counts of key ranges, so no stratum is sorted as a whole, and only the range in which the
quota ends is ranked.

Cases: an image belongs to a category if over its rows one has both labels, compared by letters and digits only without
case; null labels, lists and image ids match nothing; an image_id on several rows is one image with the categories of
all of them; ties of the random key go by image_id; a category with fewer images than required takes what there is and
is reported; an empty table gives S = 0 with every category short that has a minimum. Extra columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.plans.stages import materialize

#: The sample is one image in so many, and ranges of the random key that are counted a stratum.
SHARE, RANGES = 10, 1 << 12
SEED = 20240101


def plain(column: Column) -> Column:
    return F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]", "")


def memberships(images: DataFrame, targets: DataFrame) -> DataFrame:
    """(image_id, categories): every distinct image with the sorted secondary labels of targets it belongs to."""
    rules = [(r["secondary_label"], r["p"], r["s"]) for r in targets.select("secondary_label", plain(F.col("primary_label")).alias("p"), plain(F.col("secondary_label")).alias("s")).collect()]
    held = lambda name: F.transform(F.coalesce(F.col(f"mini_rec.{name}"), F.array().cast("array<string>")), plain)
    rows = images.select(F.col("mini_rec.image_id").alias("image_id"), held("image_primary_label").alias("p"), held("image_secondary_label").alias("s")).where("image_id is not null")
    has = lambda name, value: F.coalesce(F.array_contains(name, value), F.lit(False))
    flags = [F.max(has("p", p) & has("s", s)).alias(f"c{i}") for i, (_, p, s) in enumerate(rules)]
    found = rows.groupBy("image_id").agg(F.count("*").alias("rows"), *flags)
    names = F.array(*(F.when(F.col(f"c{i}"), F.lit(name)) for i, (name, _, _) in enumerate(rules))) if rules else F.array().cast("array<string>")
    return found.select("image_id", F.array_sort(F.array_compact(names)).alias("categories"))


def controlled_rounding(table: dict[tuple, float], rows: dict, capacity: dict) -> dict[tuple, int]:
    """Integer cells of a fractional (row, column) table with integer row totals ``rows``.

    Each cell becomes its floor or ceiling, each column total its floor or ceiling, and no column exceeds
    ``capacity``. A fractional table is a feasible flow of this network, so an integer one exists by the integrality of
    flows; columns first get their floors (lower bounds), then rows are filled by augmenting paths.
    """
    low = {k: int(v + 1e-9) for k, v in table.items()}
    spare = {k: int(v > low[k] + 1e-9) for k, v in table.items()}
    left = {r: n - sum(low[k] for k in table if k[0] == r) for r, n in rows.items()}
    total, base = {}, {}
    for (r, c), v in table.items():
        total[c] = total.get(c, 0.0) + v
        base[c] = base.get(c, 0) + low[r, c]
    floor = {c: max(0, int(t + 1e-9) - base[c]) for c, t in total.items()}
    room = {c: max(0, min(capacity[c], int(-(-t // 1)) if t - int(t) > 1e-9 else int(t + 1e-9)) - base[c]) for c, t in total.items()}
    used = {k: 0 for k in table}
    filled = {c: 0 for c in total}
    by_row, by_column = {}, {}
    for r, c in table:
        by_row.setdefault(r, []).append(c)
        by_column.setdefault(c, []).append(r)

    def augment(row, limit) -> bool:
        """One more unit of ``row`` to some column below ``limit``, rerouting other rows' units on the way."""
        came, queue, seen = {}, deque([row]), {row}
        visited = set()
        while queue:
            r = queue.popleft()
            for c in by_row.get(r, ()):
                if c in visited or used[r, c] >= spare[r, c]:
                    continue
                visited.add(c)
                came[c] = r
                if filled[c] < limit[c]:
                    filled[c] += 1
                    while True:
                        r = came[c]
                        used[r, c] = 1
                        if r == row:
                            return True
                        c = came["row", r]
                        used[r, c] = 0
                for other in by_column[c]:
                    if used[other, c] and other not in seen:
                        seen.add(other)
                        came["row", other] = c
                        queue.append(other)
        return False

    for limit in (floor, room):
        for r in left:
            while left[r] > 0 and augment(r, limit):
                left[r] -= 1
    return {k: low[k] + used[k] for k in table}


def flow(demand: dict, capacity: dict, cells: dict[tuple, int]) -> dict[tuple, int]:
    """Integer cells of a (row, column) table that fill the rows as far as any can be filled: augmenting paths from the
    given cells until none is left. No row loses what it has, no row exceeds its demand and no column its capacity."""
    cells = dict(cells)
    by_row, by_column = {}, {}
    for r, c in cells:
        by_row.setdefault(r, []).append(c)
        by_column.setdefault(c, []).append(r)
    need = {r: n - sum(cells[r, c] for c in by_row.get(r, ())) for r, n in demand.items()}
    free = {c: capacity[c] - sum(cells[r, c] for r in rows) for c, rows in by_column.items()}
    for row in demand:
        while need[row] > 0:
            came, queue, end = {row: None}, deque([row]), None
            seen = set()
            while queue and end is None:
                r = queue.popleft()
                for c in by_row.get(r, ()):
                    if c in seen:
                        continue
                    seen.add(c)
                    if free[c] > 0:
                        end = (r, c)
                        break
                    for other in by_column[c]:
                        if other not in came and cells[other, c] > 0:
                            came[other] = (r, c)
                            queue.append(other)
            if end is None:
                break
            r, c = end
            path, amount = [(r, c, None)], min(need[row], free[c])
            while came[r] is not None:
                before, through = came[r]
                amount = min(amount, cells[r, through])
                path.append((before, through, r))
                r = before
            free[c] -= amount
            need[row] -= amount
            for r, c, gives in path:
                cells[r, c] += amount
                if gives is not None:
                    cells[gives, c] -= amount
    return cells


def proportional(rows: dict, capacity: dict, keys: list[tuple], rounds: int = 300) -> dict[tuple, float]:
    """A fractional table with row totals ``rows`` whose columns stay within ``capacity``, as near to each row's
    proportion of its columns as that allows: rows and overfull columns are scaled in turn."""
    table = {k: float(capacity[k[1]]) for k in keys if rows.get(k[0], 0) > 0 and capacity[k[1]] > 0}
    for _ in range(rounds):
        moved = 0.0
        for at, limit, exact in ((1, capacity, False), (0, rows, True)):
            sums = {}
            for k, v in table.items():
                sums[k[at]] = sums.get(k[at], 0.0) + v
            scale = {x: limit[x] / n if n > 0 and (exact or n > limit[x]) else 1.0 for x, n in sums.items()}
            moved = max([moved, *(abs(f - 1) for f in scale.values())]) if not exact else moved
            table = {k: v * scale[k[at]] for k, v in table.items()}
        if moved < 1e-9:
            break
    return table


def plan(strata: dict[tuple, int], targets: list[tuple[str, int, int]], size: int) -> tuple[list[dict], dict[tuple, int]]:
    """(report per category, integer quotas by (category, stratum)) of a sample of ``size``.

    A flow from categories to strata tells how far all categories can be served together: first their minimums, then their
    whole numbers. The numbers so reached are spread over the strata in proportion, rounded, and filled up by the flow where
    rounding left a category short, so a target that can be met is met."""
    report = []
    for name, permille, least in targets:
        available = sum(n for s, n in strata.items() if name in s)
        required = max(least, -(-permille * size // 1000))
        # What the flow reaches when the category is served alone.
        alone = sum(flow({name: required}, strata, {(name, s): 0 for s in strata if name in s}).values())
        report.append({"secondary_label": name, "required": required, "available": available, "short": alone < required, "least": least})
    # The scarcest go first, which matters only where not all can be served.
    order = sorted(report, key=lambda x: (x["available"] - x["required"], x["secondary_label"]))
    keys = [(x["secondary_label"], s) for x in order for s in sorted(strata) if x["secondary_label"] in s]
    cells = flow({x["secondary_label"]: min(x["least"], x["required"]) for x in order}, strata, dict.fromkeys(keys, 0))
    cells = flow({x["secondary_label"]: x["required"] for x in order}, strata, cells)
    rows = {x["secondary_label"]: sum(cells[k] for k in keys if k[0] == x["secondary_label"]) for x in order}
    table = proportional(rows, strata, keys)
    rounded = controlled_rounding(table, {r: n for r, n in rows.items() if n}, strata)
    used = {}
    for (_, s), n in rounded.items():
        used[s] = used.get(s, 0) + n
    # A table that had not settled may overfill a stratum by its last fraction; that is taken back before it is filled up.
    for r, s in sorted(rounded):
        over = used[s] - strata[s]
        if over > 0:
            taken = min(over, rounded[r, s])
            rounded[r, s] -= taken
            used[s] -= taken
    for r in rows:
        extra = sum(n for (x, _), n in rounded.items() if x == r) - rows[r]
        for k in sorted(k for k in rounded if k[0] == r):
            taken = min(max(extra, 0), rounded[k])
            rounded[k] -= taken
            extra -= taken
    cells = flow(rows, strata, dict.fromkeys(keys, 0) | rounded)
    for line in report:
        del line["least"]
        line["sampled"] = sum(n for (c, _), n in cells.items() if c == line["secondary_label"])
        line["met"] = line["sampled"] >= line["required"]
    return report, {k: n for k, n in cells.items() if n}


def _targets(targets: DataFrame) -> list[tuple[str, int, int]]:
    rows = targets.select("secondary_label", F.coalesce("target_permille", F.lit(0)).alias("t"), F.coalesce("min_rows", F.lit(0)).alias("m")).where("secondary_label is not null").collect()
    return sorted((r["secondary_label"], r["t"], r["m"]) for r in rows)


def _planned(images: DataFrame, targets: DataFrame, share: int):
    drawn = materialize(memberships(images, targets), "memberships")
    strata = {tuple(r["categories"]): r["n"] for r in drawn.groupBy("categories").agg(F.count("*").alias("n")).collect()}
    return drawn, *plan(strata, _targets(targets), sum(strata.values()) // share)


def quota_report(images: DataFrame, targets: DataFrame, share: int = SHARE) -> DataFrame:
    """Per category of ``targets``: required and available images, sampled images, and whether the number is met."""
    _, report, _ = _planned(images, targets, share)
    rows = [(x["secondary_label"], x["required"], x["available"], x["sampled"], x["short"], x["met"]) for x in report]
    return images.sparkSession.createDataFrame(rows, "secondary_label string, required long, available long, sampled long, short boolean, met boolean")


def short_categories(images: DataFrame, targets: DataFrame, share: int = SHARE) -> DataFrame:
    return quota_report(images, targets, share).where("short").select("secondary_label")


def quota_sample(images: DataFrame, targets: DataFrame, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """(image_id, secondary_label): the drawn images and the category each is drawn for."""
    spark = images.sparkSession
    drawn, _, cells = _planned(images, targets, share)
    ranges, at = [], {}
    for (category, stratum), n in sorted(cells.items()):
        if n:
            first = at.get(stratum, 0)
            ranges.append((list(stratum), category, first, first + n))
            at[stratum] = first + n
    quotas = spark.createDataFrame(ranges, "categories array<string>, secondary_label string, first long, after long")
    wanted = F.broadcast(spark.createDataFrame([(list(s), n) for s, n in at.items()], "categories array<string>, wanted long"))
    keyed = drawn.join(wanted, "categories").withColumn("key", F.xxhash64(F.lit(seed), "image_id")).withColumn("range", F.shiftright("key", 52).cast("int"))
    counted = keyed.groupBy("categories", "wanted", "range").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("categories").orderBy("range")
    before = counted.select("categories", "range", "wanted", (F.sum("n").over(upto) - F.col("n")).alias("before")).where("before < wanted")
    rank = F.row_number().over(Window.partitionBy("categories", "range").orderBy("key", "image_id"))
    placed = keyed.drop("wanted").join(before, ["categories", "range"]).withColumn("place", F.col("before") + rank - 1).where("place < wanted")
    return placed.join(F.broadcast(quotas), "categories").where("place >= first and place < after").select("image_id", "secondary_label")
