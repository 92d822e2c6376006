"""Grouping of an article's images by caption, quotas by category, and assembly of group records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import caption_or_null
from curatrix.plans.stages import materialize

# Secondary labels of clinical images, and of microscopy, that may be used where the caller names no others.
CLINICAL = (
    "x-ray radiography", "optical coherence tomography", "endoscopy", "intraoral imaging", "angiography", "procedural image", "skull", "patient photo", "functional magnetic resonance", "magnetic resonance", "eye", "mammography",
    "electrocardiography", "clinical imaging", "skin lesion", "ultrasound", "specimen", "computerized tomography", "laryngoscopy", "teeth", "intraoperative image", "surgical procedure", "brain",
)
MICROSCOPY = ("light microscopy",)


def allowed_categories(primary: Column, secondary: Column, clinical: tuple[str, ...] = CLINICAL, microscopy: tuple[str, ...] = MICROSCOPY, key=lambda c: F.lower(F.trim(c))) -> Column:
    """Categories an image may stand for: clinical secondary labels of clinical images, and those of micrographs."""
    keys = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), key)
    p, s = keys(primary), keys(secondary)
    has = lambda a, x: F.coalesce(F.array_contains(a, key(F.lit(x))), F.lit(False))
    pairs = [("clinical imaging", x) for x in clinical] + [("microscopy", x) for x in microscopy]
    return F.array_compact(F.array(*(F.when(has(p, a) & has(s, x), F.lit(x)) for a, x in pairs)))


def groups(images: DataFrame, categories: Column, most: int = 6, key: str = "mini_rec") -> DataFrame:
    """Groups of 1 to ``most`` allowed images of one article with one caption: article, caption, image_ids (sorted), k and
    the union of their categories. A group is cut off at one image more than allowed, so a caption that a third of all
    images share (of one article) is counted but not collected."""
    rows = images.select(F.col(f"{key}.article_accession_id").alias("article"), caption_or_null(F.col(f"{key}.caption")).alias("caption"), F.col(f"{key}.image_id").alias("image_id"), categories.alias("categories"))
    rows = rows.where("caption is not null and article is not null and image_id is not null and size(categories) > 0")
    one = rows.groupBy("article", "caption", "image_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"))
    sized = one.groupBy("article", "caption").agg(F.count("*").alias("k")).where(F.col("k") <= most)
    kept = one.join(sized, ["article", "caption"])
    return kept.groupBy("article", "caption").agg(F.array_sort(F.collect_list("image_id")).alias("image_ids"), F.first("k").cast("int").alias("k"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories"))


def available(grouped: DataFrame) -> DataFrame:
    """Groups by size and category; a group counts for each of its categories."""
    return grouped.select("k", F.explode("categories").alias("category")).groupBy("k", "category").agg(F.count("*").alias("groups"))


def sample_groups(grouped: DataFrame, categories: tuple[str, ...], quotas: dict[int, int], salt: str = "g") -> DataFrame:
    """Groups drawn for each category and size up to its quota, none twice: (article, caption, k, category).

    A group that fits several categories is offered to the first of them in list order in which it ranks within the
    quota. Ranks by a hash are taken over all offers at once; groups drawn by two categories stay with the first, and
    the places that frees are filled in further rounds among groups not drawn, until none changes. Rounds number at
    most the categories.
    """
    order = F.create_map(*(x for i, c in enumerate(categories) for x in (F.lit(c), F.lit(i))))
    need = F.create_map(*(x for k, n in quotas.items() for x in (F.lit(k), F.lit(n))))
    offers = grouped.select("article", "caption", "k", F.explode("categories").alias("category")).withColumn("at", F.try_element_at(order, F.col("category"))).where("at is not null")
    offers = materialize(offers.withColumn("h", F.md5(F.concat_ws("|", F.lit(salt), "article", "caption"))).withColumn("quota", F.coalesce(F.try_element_at(need, F.col("k")), F.lit(0))), "offers")
    taken = None
    for _ in range(len(categories)):
        free = offers if taken is None else offers.join(taken.select("article", "caption"), ["article", "caption"], "left_anti")
        if taken is not None:
            held = taken.groupBy("category", "k").agg(F.count("*").alias("held"))
            free = free.join(F.broadcast(held), ["category", "k"], "left").withColumn("quota", F.col("quota") - F.coalesce("held", F.lit(0))).drop("held")
        rank = F.row_number().over(Window.partitionBy("category", "k").orderBy("h", "article", "caption"))
        drawn = free.withColumn("r", rank).where("r <= quota")
        first = drawn.withColumn("f", F.row_number().over(Window.partitionBy("article", "caption").orderBy("at"))).where("f = 1").select("article", "caption", "k", "category")
        new = materialize(first, "drawn")
        if new.isEmpty():
            break
        taken = new if taken is None else materialize(taken.unionByName(new), "taken")
    return taken if taken is not None else offers.select("article", "caption", "k", "category").limit(0)


def assemble(images: DataFrame, drawn: DataFrame, key: str = "mini_rec") -> DataFrame:
    """Records of drawn groups with parallel arrays over their images, by image id; of rows of one image the last holds."""
    fields = ["image_file_name", "image_panel_type", "image_primary_label", "image_secondary_label", "image_size", "image_wds_path"]
    rows = images.select(F.col(f"{key}.article_accession_id").alias("article"), caption_or_null(F.col(f"{key}.caption")).alias("caption"), F.col(f"{key}.image_id").alias("image_id"), F.col(f"{key}.article_title").alias("title"), "row_id", *(F.col(f"{key}.{f}").alias(f) for f in fields))
    wanted = rows.join(drawn.select("article", "caption", "category"), ["article", "caption"])
    last = wanted.groupBy("article", "caption", "category", "image_id").agg(F.max_by(F.struct("title", *fields), "row_id").alias("v"))
    held = F.array_sort(F.collect_list(F.struct("image_id", "v")))
    one = last.groupBy("article", "caption", "category").agg(held.alias("g"))
    column = lambda f: F.transform("g", lambda x: x["v"][f]).alias(f)
    return one.select("article", "caption", "category", F.col("g.image_id").alias("image_ids"), F.get("g", F.lit(0))["v"]["title"].alias("article_title"), *map(column, fields))
