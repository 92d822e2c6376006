"""SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

_MEMBERS = r"""
images AS (SELECT mini_rec.image_id AS image_id, mini_rec.image_primary_label AS p, mini_rec.image_secondary_label AS s FROM curated_images),
rowed AS (SELECT *, row_number() OVER () AS r FROM images),
first_labels AS (SELECT DISTINCT r, image_id, regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g') AS label FROM (SELECT r, image_id, unnest(p) AS x FROM rowed)),
second_labels AS (SELECT DISTINCT r, image_id, regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g') AS label FROM (SELECT r, image_id, unnest(s) AS x FROM rowed)),
goals AS (SELECT secondary_label, regexp_replace(lower(primary_label), '[^\p{L}\p{N}]', '', 'g') AS p, regexp_replace(lower(secondary_label), '[^\p{L}\p{N}]', '', 'g') AS s, target_permille, min_rows FROM category_targets),
total AS (SELECT count(DISTINCT image_id) // 10 AS size FROM images),
counted AS (
  SELECT g.secondary_label, greatest(max(g.min_rows), max((g.target_permille * t.size + 999) // 1000)) AS required, count(DISTINCT b.image_id) AS available
  FROM goals g CROSS JOIN total t
  LEFT JOIN second_labels b ON b.label = g.s AND b.image_id IS NOT NULL AND EXISTS (SELECT 1 FROM first_labels a WHERE a.r = b.r AND a.label = g.p)
  GROUP BY g.secondary_label)
"""

_SCORED = r"""
items AS (SELECT verify_id, unnest(rubric_verification.rubric) AS i FROM verified_mcq WHERE rubric_verification.error IS NULL),
parts AS (
  SELECT verify_id, coalesce(lower(regexp_replace(i.category, '^\s+|\s+$', '', 'g')) = 'pitfall', false) AS pitfall, coalesce(i.weight, 0) AS w, coalesce(i.score, 0) AS s FROM items),
sums AS (
  SELECT verify_id, sum(CASE WHEN pitfall OR w <= 0 THEN 0 ELSE w END) AS weights, sum(CASE WHEN pitfall OR w <= 0 THEN 0 ELSE greatest(least(s, w), 0) END) AS scores,
         sum(CASE WHEN pitfall AND s < 0 THEN -s ELSE 0 END) AS penalty
  FROM parts GROUP BY verify_id),
scored AS (
  SELECT v.verify_id, lower(regexp_replace(v.dataset_name, '^\s+|\s+$', '', 'g')) AS source,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, (scores - penalty)::DOUBLE / weights::DOUBLE)) AS score
  FROM verified_mcq v JOIN sums USING (verify_id) WHERE weights > 0 AND coalesce(lower(regexp_replace(v.dataset_name, '^\s+|\s+$', '', 'g')), '') <> ''),
ranked AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, count(*) OVER (PARTITION BY source ORDER BY score DESC) AS reached FROM scored),
wanted AS (
  SELECT r.*, (k.keep_permille * n + 999) // 1000 AS wanted FROM ranked r
  JOIN (SELECT lower(trim(dataset_name)) AS source, max(keep_permille) AS keep_permille FROM keep_targets GROUP BY 1) k USING (source)),
limits AS (
  SELECT source, max(n) AS n, max(wanted) AS wanted, max(CASE WHEN reached >= wanted AND wanted > 0 THEN score END) AS cutoff,
         coalesce(min(CASE WHEN reached >= wanted AND wanted > 0 THEN reached END), 0) AS kept
  FROM wanted GROUP BY source)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {_MEMBERS} SELECT secondary_label FROM counted WHERE available < required",
        "p4_found": f"WITH {_SCORED} SELECT verify_id FROM scored JOIN limits USING (source) WHERE score >= cutoff",
        "p4_cutoffs": f"WITH {_SCORED} SELECT source, n, wanted, cutoff, kept FROM limits",
    }
