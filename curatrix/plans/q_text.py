"""Queries over texts, vectors and pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import parsing, records, text, vectors
from curatrix.operators import knn, merging, neardup
from curatrix.plans.tables import table
from curatrix.sources import images

WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def sql_normalized(column: str) -> str:
    """The engine's patterns cannot look around, so numbers are replaced with their neighbours, fractions before whole
    ones and each twice, since neighbouring numbers share a character."""
    plain = rf"regexp_replace(regexp_replace(lower({column}), '{WS}+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s.,\-+()/#:%;'']', ' ', 'g')"
    out = rf"' ' || trim(regexp_replace({plain}, '{WS}+', ' ', 'g')) || ' '"
    for number in (r"[0-9]+\.[0-9]+", r"[0-9]+"):
        for _ in range(2):
            out = rf"regexp_replace({out}, '([^\p{{L}}\p{{N}}_]){number}([^\p{{L}}\p{{N}}_])', '\1<NUM>\2', 'g')"
    return f"trim({out})"


def sql_strip(column: str) -> str:
    return rf"regexp_replace({column}, '^{WS}+|{WS}+$', '', 'g')"


N = 13
PERMS = neardup.permutations(128)
BANDS = (9, 13)


def text_normalize(spark, d):
    n = text.normalize_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).alias("norm_length"))


def text_keys(spark, d):
    q = F.col("question")
    return table(spark, d, "vqa_records").select(
        "record_id", F.md5(text.question_key(q)).alias("question_key"), F.md5(text.alnum_key(q)).alias("alnum_key"), F.md5(text.label_key(q)).alias("label_key"), text.safe_name(F.concat_ws("#", "dataset_name", "dataset_index")).alias("file_name"),
        text.is_missing(F.col("hash")).alias("hash_missing"),
    )


def folded_questions(spark, d):
    return table(spark, d, "vqa_records").select("record_id", text.folded(F.col("question")).alias("k")).groupBy("k").agg(F.count("*").alias("records")).where("records > 1").select(F.md5("k").alias("key_md5"), "records")


def exact_dedup(spark, d):
    n = F.md5(text.normalize_text(F.col("text")))
    return table(spark, d, "documents").select("doc_id", n.alias("norm_md5")).where("norm_md5 is not null").groupBy("norm_md5").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def char_shingles(spark, d):
    # The text is normalised in a step of its own: inside the windows' lambda it would be normalised for each of them.
    norm = table(spark, d, "benchmark_items").select("item_id", text.normalize_text(F.col("text")).alias("t"))
    grams = lambda n: F.size(F.array_distinct(text.char_ngrams(F.col("t"), n)))
    return norm.select("item_id", grams(13).alias("distinct_13"), grams(3).alias("distinct_3"))


def _record_texts(spark, d):
    return table(spark, d, "vqa_records").select("record_id", records.record_text(F.coalesce("question", F.lit("")), records.options_text(F.col("options"))).alias("text"))


def near_dup_minhash(spark, d):
    return neardup.near_duplicates(_record_texts(spark, d), "record_id", "text", n=N)


def near_dup_members(spark, d):
    return neardup.memberships(table(spark, d, "documents"), "doc_id", "text")


def pair_report(spark, d):
    pairs = near_dup_minhash(spark, d)
    return neardup.pair_report(pairs, "id_a", "id_b", "levenshtein_sim", table(spark, d, "vqa_records"))


def _record_members(spark, d):
    return neardup.memberships(_record_texts(spark, d), "record_id", "text", n=N)


def near_dup_record_members(spark, d):
    return _record_members(spark, d)


def pair_report_rows(spark, d):
    """``pair_report`` with the copies that near_dup_minhash represents by one record, and both ends of every pair."""
    return neardup.row_report(near_dup_minhash(spark, d), _record_members(spark, d), table(spark, d, "vqa_records"))


def top_templates_rows(spark, d):
    return neardup.row_templates(near_dup_minhash(spark, d), _record_members(spark, d), "record_id")


def best_duplicate_rows(spark, d):
    return neardup.row_best(near_dup_minhash(spark, d), _record_members(spark, d), "record_id")


def top_templates(spark, d):
    return neardup.top_templates(near_dup_minhash(spark, d), "id_a", "id_b")


def best_duplicate(spark, d):
    return neardup.best_per_query(near_dup_minhash(spark, d), "id_a", "id_b", "levenshtein_sim")


def benchmark_contamination(spark, d):
    return neardup.contained(table(spark, d, "documents"), table(spark, d, "benchmark_items"), "doc_id", "item_id", least=0.8)


def contamination_report(spark, d):
    return neardup.pair_report(benchmark_contamination(spark, d), "item_id", "doc_id", "containment", table(spark, d, "benchmark_items"))


def _embeddings(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return rows.where("id % 50 = 0"), rows


def embed_topk(spark, d):
    return knn.cosine_topk(*_embeddings(spark, d), k=5)


def maxsim_overlap(spark, d):
    return knn.overlap(knn.best_other(embed_topk(spark, d), "cosine_sim"), (0.30, 0.35, 0.40, 0.45, 0.85, 0.88, 0.90))


def _bits(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vectors.median_bits(F.col("embedding")).alias("bits"))
    return rows.where("id % 50 = 0"), rows


def phash_topk(spark, d):
    return knn.hamming_topk(*_bits(spark, d), k=3)


def phash_overlap(spark, d):
    return knn.overlap(knn.best_other(phash_topk(spark, d), "hamming", high=False), (4, 8, 12, 16, 20), high=False)


def vector_norms(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(v), 5).alias("norm"), F.round(vectors.inner(v, v), 5).alias("square"), F.size(vectors.l2_normalize(v)).alias("dims"), vectors.median_bits(v).alias("bits"))


def md5_match(spark, d):
    first = table(spark, d, "vqa_records").select("record_id", "split", F.md5(F.get("images", F.lit(0))["bytes"]).alias("h"))
    q = first.where("split <> 'train'").select(F.col("record_id").alias("query_id"), "h")
    return merging.matches(q, first.where("split = 'train'").select(F.col("record_id").alias("train_id"), "h"), "h", "query_id", "train_id", 3)


def pixel_match(spark, d):
    first = table(spark, d, "vqa_records").select("record_id", "split", images.pixel_md5(F.get("images", F.lit(0))["bytes"]).alias("h"))
    q = first.where("split <> 'train'").select(F.col("record_id").alias("query_id"), "h")
    return merging.matches(q, first.where("split = 'train'").select(F.col("record_id").alias("train_id"), "h"), "h", "query_id", "train_id", 3)


def picture_phash(spark, d):
    one = table(spark, d, "vqa_records").select("record_id", F.posexplode("images").alias("place", "image"))
    data = F.col("image.bytes")
    return one.select("record_id", "place", images.phash(data).alias("bits"), images.picture_size(data).alias("s")).select("record_id", "place", "bits", "s.width", "s.height")


def picture_resize(spark, d):
    """Side lengths after scaling to 8 pixels, from the pictures and from arithmetic."""
    one = table(spark, d, "vqa_records").select("record_id", F.posexplode("images").alias("place", "image"))
    small = images.picture_size(images.resized_png(8)(F.col("image.bytes")))
    return one.select("record_id", "place", small.alias("s")).where("s.width is not null").select("record_id", "place", "s.width", "s.height")


def resize_sizes(spark, d):
    s = F.col("mini_rec.image_size")
    w, h = F.get(s, F.lit(0)), F.get(s, F.lit(1))
    out = records.resized(w, h)
    return table(spark, d, "curated_images").where((w > 0) & (h > 0)).select("row_id", out[0].alias("width"), out[1].alias("height"), records.small_side(w, h, 400).alias("small"))


def record_texts(spark, d):
    o = records.options_text(F.col("options"))
    t = text.normalize_text(records.record_text(F.coalesce("question", F.lit("")), o))
    return table(spark, d, "vqa_records").select("record_id", F.md5(o).alias("options_md5"), F.md5(t).alias("text_md5"))


def strip_tags(spark, d):
    out, flag = parsing.strip_tags(F.col("raw"))
    raw = F.concat(F.lit("<think>"), F.coalesce("reasoning", F.lit("none")), F.lit("</think>\n"), F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("<answer> "), "answer", F.lit(" </answer>"))).otherwise(F.col("answer")))
    return table(spark, d, "vqa_records").select("record_id", raw.alias("raw")).select("record_id", F.md5(out).alias("text_md5"), flag.alias("tagged"), F.md5(parsing.thinking(F.col("raw"))).alias("think_md5"))


_JSON = "CASE WHEN json_valid(options) THEN options END"
_OPTIONS = rf"""CASE WHEN json_type({_JSON}) = 'OBJECT' THEN coalesce((SELECT string_agg(k || '. ' || v, chr(10) ORDER BY k) FROM (SELECT unnest(json_keys({_JSON})) AS k, unnest(list_transform(json_keys({_JSON}), lambda k: json_extract_string({_JSON}, '$."' || k || '"'))) AS v) WHERE v IS NOT NULL), '') ELSE coalesce({sql_strip('options')}, '') END"""
_RECORD = "concat_ws(' ' || chr(10) || ' ', nullif(coalesce(question, ''), ''), nullif(o, ''))"
def _bytes(t: str) -> str:
    """Text of one byte a character, since the engine measures edit distance in bytes: others than ASCII become control
    characters, which normalised text has none of."""
    return f"array_to_string(list_transform(regexp_extract_all({t}, '.'), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE chr((1 + ord(c) % 31)::INT) END), '')"


_GRAMS = rf"""
o AS (SELECT record_id AS doc_id, question, {_OPTIONS} AS o FROM vqa_records),
norm AS (SELECT doc_id, {sql_normalized(_RECORD)} AS t FROM o),
texts AS (SELECT min(doc_id) AS doc_id, t FROM norm GROUP BY t),
grams AS (SELECT DISTINCT doc_id, substr('^' || t || '$', i, {N}) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) + 2 - {N} + 2)) AS i FROM texts WHERE length(t) + 2 >= {N})),
hashed AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 8))::BIGINT % {neardup.PRIME} AS h FROM grams),
perms AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(PERMS[: BANDS[0] * BANDS[1]]))}) AS p(i, a, b)),
mins AS (SELECT doc_id, i, min((a * h + b) % {neardup.PRIME}) AS m FROM hashed CROSS JOIN perms GROUP BY doc_id, i),
bands AS (SELECT doc_id, i // {BANDS[1]} AS band, md5(string_agg(m::VARCHAR, ',' ORDER BY i)) AS hash FROM mins GROUP BY doc_id, i // {BANDS[1]}),
cand AS (SELECT DISTINCT a.doc_id AS id_a, b.doc_id AS id_b FROM bands a JOIN bands b ON a.band = b.band AND a.hash = b.hash AND a.doc_id < b.doc_id),
scored AS (
  SELECT id_a, id_b, 1 - levenshtein({_bytes('x.t')}, {_bytes('y.t')})::DOUBLE / greatest(length(x.t), length(y.t)) AS s
  FROM cand JOIN texts x ON x.doc_id = id_a JOIN texts y ON y.doc_id = id_b
  WHERE abs(length(x.t) - length(y.t)) <= (1 - 0.92) * greatest(length(x.t), length(y.t))),
pairs AS (SELECT id_a, id_b, round(s, 6) AS levenshtein_sim FROM scored WHERE s >= 0.92)
"""


def _report_sql(pairs: str, query: str, sim: str, total: str) -> str:
    edges = (0.80, 0.85, 0.90, 0.95, 1.01)
    bins = ", ".join(f"count(*) FILTER ({sim} >= {lo} AND {sim} < {hi}) AS bin_{int(round(lo * 100))}" for lo, hi in zip(edges, edges[1:]))
    return f"""per AS (SELECT {query}, count(*) AS hits, max({sim}) AS top FROM {pairs} GROUP BY 1),
heads AS (SELECT coalesce(sum(hits), 0)::BIGINT AS pairs, count(*) AS hit_queries, count(*)::DOUBLE / greatest(1, ({total})) AS hit_rate, avg(hits) AS mean_hits, max(hits) AS max_hits,
  avg(top) AS top_mean, quantile_cont(top, 0.5) AS top_median, quantile_cont(top, 0.95) AS top_p95 FROM per)
SELECT * FROM heads CROSS JOIN (SELECT {bins} FROM {pairs})"""


_ROWS = f"""{_GRAMS},
members AS (SELECT doc_id AS record_id, min(doc_id) OVER (PARTITION BY t) AS rep FROM norm WHERE length(t) + 2 >= {N}),
matched AS (SELECT x.record_id AS id_a, y.record_id AS id_b, 1.0::DOUBLE AS levenshtein_sim FROM members x JOIN members y USING (rep) WHERE x.record_id <> y.record_id
  UNION ALL SELECT x.record_id, y.record_id, levenshtein_sim FROM (SELECT * FROM pairs UNION ALL SELECT id_b, id_a, levenshtein_sim FROM pairs) p JOIN members x ON x.rep = p.id_a JOIN members y ON y.rep = p.id_b)
"""

_CONTAINED = rf"""
items AS (SELECT DISTINCT item_id, substr(t, i, {N}) AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - {N} + 2)) AS i FROM (SELECT item_id, {sql_normalized('text')} AS t FROM benchmark_items) WHERE length(t) >= {N})),
docs AS (SELECT DISTINCT doc_id, substr(t, i, {N}) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - {N} + 2)) AS i FROM (SELECT doc_id, {sql_normalized('text')} AS t FROM documents WHERE text IS NOT NULL) WHERE length(t) >= {N})),
sizes AS (SELECT item_id, count(*) AS size FROM items GROUP BY 1),
shared AS (SELECT doc_id, item_id, count(*) AS shared FROM docs JOIN items USING (g) GROUP BY 1, 2),
contained AS (SELECT doc_id, item_id, shared, size, round(shared::DOUBLE / size, 6) AS containment FROM shared JOIN sizes USING (item_id) WHERE round(shared::DOUBLE / size, 6) >= 0.8)
"""

_TOPK = """
rows AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
unit AS (SELECT id, v, sqrt(list_inner_product(v, v)) + 1e-12 AS n FROM rows),
near AS (SELECT q.id AS query_id, t.id AS train_id, round(list_inner_product(q.v, t.v) / (q.n * t.n), 6) AS cosine_sim FROM unit q CROSS JOIN unit t WHERE q.id % 50 = 0),
top AS (SELECT query_id, train_id, cosine_sim, row_number() OVER (PARTITION BY query_id ORDER BY cosine_sim DESC, train_id) AS rank FROM near QUALIFY rank <= 5)
"""

_BITS = """
med AS (SELECT vec_id AS id, embedding AS v, list_sort(embedding) AS s FROM embeddings),
cut AS (SELECT id, v, (s[32]::DOUBLE + s[33]::DOUBLE) / 2 AS m FROM med),
bits AS (SELECT id, list_transform(v, lambda x: (x::DOUBLE > m)::INT) AS b FROM cut),
near AS (SELECT q.id AS query_id, t.id AS train_id, list_sum(list_transform(range(1, 65), lambda i: (q.b[i] <> t.b[i])::INT))::INT AS hamming FROM bits q CROSS JOIN bits t WHERE q.id % 50 = 0),
top AS (SELECT query_id, train_id, hamming, row_number() OVER (PARTITION BY query_id ORDER BY hamming, train_id) AS rank FROM near QUALIFY rank <= 3)
"""


def _overlap_sql(score: str, cuts: tuple, high: bool) -> str:
    values = ", ".join(f"({float(c)})" for c in cuts)
    return f"""best AS (SELECT query_id, {'max' if high else 'min'}(CASE WHEN query_id <> train_id THEN {score} END) AS best FROM top GROUP BY 1),
valid AS (SELECT best FROM best WHERE best IS NOT NULL)
SELECT c.cut::DOUBLE AS cut, count(*) FILTER (best {'>=' if high else '<='} c.cut) AS hits, count(*) AS valid, count(*) FILTER (best {'>=' if high else '<='} c.cut)::DOUBLE / greatest(count(*), 1) AS rate
FROM (VALUES {values}) c(cut) CROSS JOIN valid GROUP BY 1"""



Q = {
    "text_normalize": (text_normalize, f"SELECT doc_id, md5({sql_normalized('text')}) AS norm_md5, length({sql_normalized('text')}) AS norm_length FROM documents"),
    "text_keys": (
        text_keys,
        rf"""SELECT record_id, md5(lower({sql_strip(f"regexp_replace(question, '{WS}+', ' ', 'g')")})) AS question_key, md5(regexp_replace(lower(question), '[^a-z0-9]+', '', 'g')) AS alnum_key, md5(lower(regexp_replace(question, '{WS}+', '', 'g'))) AS label_key,
        regexp_replace(concat_ws('#', dataset_name, dataset_index), '[^A-Za-z0-9_\-#.]+', '_', 'g') AS file_name, lower(coalesce({sql_strip('hash')}, '')) IN ('', 'none', 'null', 'nan') AS hash_missing FROM vqa_records""",
    ),
    "folded_questions": (folded_questions, None),
    "exact_dedup": (exact_dedup, f"SELECT md5({sql_normalized('text')}) AS norm_md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1"),
    "char_shingles": (
        char_shingles,
        f"""WITH t AS (SELECT item_id, '^' || {sql_normalized('text')} || '$' AS s FROM benchmark_items)
        SELECT item_id, len(list_distinct(list_transform(range(1, greatest(1, length(s) - 11)), lambda i: substr(s, i, 13)))) AS distinct_13, len(list_distinct(list_transform(range(1, greatest(1, length(s) - 1)), lambda i: substr(s, i, 3)))) AS distinct_3 FROM t""",
    ),
    "near_dup_minhash": (near_dup_minhash, f"WITH {_GRAMS} SELECT * FROM pairs"),
    "near_dup_members": (near_dup_members, f"WITH n AS (SELECT doc_id, md5({sql_normalized('text')}) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep FROM n"),
    "pair_report": (pair_report, f"WITH {_GRAMS}, {_report_sql('pairs', 'id_a', 'levenshtein_sim', 'SELECT count(*) FROM vqa_records')}"),
    "near_dup_record_members": (near_dup_record_members, f"WITH {_ROWS} SELECT * FROM members"),
    "pair_report_rows": (pair_report_rows, f"WITH {_ROWS}, {_report_sql('matched', 'id_a', 'levenshtein_sim', 'SELECT count(*) FROM vqa_records')}"),
    "top_templates_rows": (top_templates_rows, f"WITH {_ROWS} SELECT id_a AS id, count(DISTINCT id_b) AS matches FROM matched GROUP BY 1 ORDER BY matches DESC, id LIMIT 10"),
    "best_duplicate_rows": (best_duplicate_rows, f"WITH {_ROWS} SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY levenshtein_sim DESC, id_b) = 1"),
    "top_templates": (top_templates, f"WITH {_GRAMS} SELECT id_a AS id, count(DISTINCT id_b) AS matches FROM pairs GROUP BY 1 ORDER BY matches DESC, id LIMIT 10"),
    "best_duplicate": (best_duplicate, f"WITH {_GRAMS} SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY levenshtein_sim DESC, id_b) = 1"),
    "benchmark_contamination": (benchmark_contamination, f"WITH {_CONTAINED} SELECT * FROM contained"),
    "contamination_report": (contamination_report, f"WITH {_CONTAINED}, {_report_sql('contained', 'item_id', 'containment', 'SELECT count(*) FROM benchmark_items')}"),
    "embed_topk": (embed_topk, f"WITH {_TOPK} SELECT * FROM top"),
    "maxsim_overlap": (maxsim_overlap, f"WITH {_TOPK}, {_overlap_sql('cosine_sim', (0.30, 0.35, 0.40, 0.45, 0.85, 0.88, 0.90), True)}"),
    "phash_topk": (phash_topk, f"WITH {_BITS} SELECT * FROM top"),
    "phash_overlap": (phash_overlap, f"WITH {_BITS}, {_overlap_sql('hamming', (4, 8, 12, 16, 20), False)}"),
    "vector_norms": (
        vector_norms,
        """WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_sort(embedding) AS s FROM embeddings), c AS (SELECT *, (s[32]::DOUBLE + s[33]::DOUBLE) / 2 AS m FROM r)
        SELECT vec_id, round(sqrt(list_inner_product(v, v)), 5) AS norm, round(list_inner_product(v, v), 5) AS square, len(v) AS dims,
        (list_sum(list_transform(range(1, 64), lambda i: CASE WHEN v[i + 1] > m THEN (1::BIGINT << (63 - i)::INT)::HUGEINT ELSE 0::HUGEINT END)) - CASE WHEN v[1] > m THEN 9223372036854775808::HUGEINT ELSE 0::HUGEINT END)::BIGINT AS bits FROM c""",
    ),
    "md5_match": (
        md5_match,
        """WITH f AS (SELECT record_id, split, md5(images[1].bytes) AS h FROM vqa_records), t AS (SELECT record_id AS train_id, h, row_number() OVER (PARTITION BY h ORDER BY record_id) AS rank FROM f WHERE split = 'train' AND h IS NOT NULL)
        SELECT f.record_id AS query_id, train_id, rank FROM f JOIN t USING (h) WHERE split <> 'train' AND rank <= 3""",
    ),
    "pixel_match": (pixel_match, None),
    "picture_phash": (picture_phash, None),
    "picture_resize": (picture_resize, None),
    "resize_sizes": (
        resize_sizes,
        """WITH s AS (SELECT row_id, mini_rec.image_size[1] AS w, mini_rec.image_size[2] AS h FROM curated_images), f AS (SELECT *, least(1.0::DOUBLE, 384::DOUBLE / greatest(w, h)) AS k FROM s WHERE w > 0 AND h > 0)
        SELECT row_id, greatest(1, round_even(w * k, 0))::INT AS width, greatest(1, round_even(h * k, 0))::INT AS height, least(w, h) < 400 AS small FROM f""",
    ),
    "record_texts": (record_texts, f"WITH o AS (SELECT record_id, question, {_OPTIONS} AS o FROM vqa_records), r AS (SELECT *, concat_ws(' ' || chr(10) || ' ', nullif(coalesce(question, ''), ''), nullif(o, '')) AS t FROM o) SELECT record_id, md5(o) AS options_md5, md5({sql_normalized('t')}) AS text_md5 FROM r"),
    "strip_tags": (
        strip_tags,
        f"""WITH r AS (SELECT record_id, '<think>' || coalesce(reasoning, 'none') || '</think>' || chr(10) || CASE WHEN record_id % 2 = 0 THEN '<answer> ' || answer || ' </answer>' ELSE answer END AS raw FROM vqa_records)
        SELECT record_id, md5({sql_strip("CASE WHEN regexp_matches(raw, '(?is)<answer>.*?</answer>') THEN regexp_extract(raw, '(?is)<answer>(.*?)</answer>', 1) ELSE regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g') END")}) AS text_md5,
        regexp_matches(raw, '(?is)<answer>.*?</answer>') AS tagged, md5(nullif({sql_strip("regexp_extract(raw, '(?is)<think>(.*?)</think>', 1)")}, '')) AS think_md5 FROM r""",
    ),
}
