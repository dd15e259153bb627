"""SQL steps for the DuckDB side of vector, cluster and template checks."""

from __future__ import annotations

from mailmine.catalog import duck as d
from mailmine.functions import lexicon as lx


def bag_cte(name: str, src: str, key: str, text: str, dim: int = lx.EMBED_DIM) -> str:
    """Hashed bag-of-words vectors in sparse form: ``key, bucket, w``."""

    return rf"""{name}_words AS (SELECT {key}, unnest(list_filter(string_split_regex(lower({text}), '\s+'), lambda v: v <> '')) AS word FROM {src}
), {name}_counts AS (SELECT {key}, ('0x' || substr(md5(word), 1, 8))::UBIGINT % {dim} AS bucket, count(*)::DOUBLE AS c
  FROM {name}_words GROUP BY ALL
), {name} AS MATERIALIZED (SELECT {key}, bucket, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS w
  FROM {name}_counts)"""


def sims_cte(name: str, left: str, left_key: str, right: str, right_key: str, right_w: str = "w") -> str:
    """Similarities of all left and right rows that share a bucket."""

    return f"""{name} AS MATERIALIZED (SELECT l.{left_key} AS lid, r.{right_key} AS rid, round(sum(l.w * r.{right_w}), 9) AS sim
  FROM {left} l JOIN {right} r USING (bucket) GROUP BY ALL)"""


# mails grouped by category, sender and style: about eighty groups
DESK = "coalesce(category, '__missing__') || '/' || sender || '/' || formality"

MEMBERS_CTE = (
    d.PREPARED_CTE
    + f""", desks AS (SELECT * EXCLUDE (sentiment), found_sentiment AS sentiment, {DESK} AS desk FROM prepared
), members AS MATERIALIZED (SELECT *, CAST(dense_rank() OVER (ORDER BY desk) - 1 AS BIGINT) AS cluster_id FROM desks
), """
    + bag_cte("bag", "members", "row_id", "combined_text")
    + """, sizes AS (SELECT cluster_id, count(*) AS size FROM members GROUP BY 1
), means AS (SELECT cluster_id, bucket, sum(w) / any_value(size) AS m
  FROM bag JOIN members USING (row_id) JOIN sizes USING (cluster_id) GROUP BY 1, 2
), centers AS MATERIALIZED (SELECT cluster_id, bucket, m / sqrt(sum(m * m) OVER (PARTITION BY cluster_id)) AS c FROM means
), own AS (SELECT row_id, cluster_id, round(sum(w * c), 9) AS sim
  FROM bag JOIN members USING (row_id) JOIN centers USING (cluster_id, bucket) GROUP BY ALL
), reps AS MATERIALIZED (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, row_id) = 1)"""
)


def majority(label: str) -> str:
    return (
        f"(SELECT cluster_id, {label} FROM (SELECT cluster_id, {label}, count(*) AS n, min(row_id) AS f FROM members "
        f"WHERE {label} <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f) = 1)"
    )


def grams_cte(name: str, src: str, keys: str, order: str, text: str, n: int = 3) -> str:
    words = f"regexp_extract_all(lower({text}), {d.lit(lx.TOKEN)})"
    joined = " || ' ' || ".join(f"ws[p + {i}]" for i in range(1, n + 1))
    return f"""{name}_ws AS (SELECT {keys}, {order}, {words} AS ws FROM {src}
), {name}_at AS (SELECT *, unnest(range(0, len(ws) - {n - 1})) AS p FROM {name}_ws WHERE len(ws) >= {n}
), {name} AS (SELECT {keys}, {joined} AS phrase, count(*) AS n, min({order} * 4294967296::HUGEINT + p) AS seen
  FROM {name}_at GROUP BY ALL)"""


PHRASES_CTE = grams_cte("grams", "members", "cluster_id", "row_id", "combined_text") + """, phrases AS (
  SELECT cluster_id, phrase, n, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, seen) AS rank FROM grams
  QUALIFY rank <= 5
), phrase_lists AS (SELECT cluster_id, list(phrase ORDER BY rank) AS common_phrases FROM phrases GROUP BY 1)"""

BUILT_CTE = (
    MEMBERS_CTE
    + ", "
    + PHRASES_CTE
    + ", rep_mails AS (SELECT m.*, r.sim FROM members m JOIN reps r USING (row_id, cluster_id))"
    + d.body_template_cte("rep_mails", "rep_texts")
    + f""", built AS MATERIALIZED (SELECT {d.template_id('body_template')} AS template_id, t.cluster_id, s.size AS cluster_size,
    ca.category, coalesce(tn.tone, fo.formality) AS tone, se.sentiment, it.intent,
    coalesce(nullif({d.ws(d.placeholderize('clean_subject'))}, ''), {d.lit(lx.SUBJECT_FALLBACK)}) AS subject_template,
    body_template, {d.targets('body_template')} AS placeholders, email_id AS representative_email_id,
    sim AS similarity_to_centroid, coalesce(common_phrases, []) AS common_phrases
  FROM rep_texts t JOIN sizes s USING (cluster_id)
  LEFT JOIN {majority('category')} ca USING (cluster_id) LEFT JOIN {majority('tone')} tn USING (cluster_id)
  LEFT JOIN {majority('formality')} fo USING (cluster_id) LEFT JOIN {majority('sentiment')} se USING (cluster_id)
  LEFT JOIN {majority('intent')} it USING (cluster_id) LEFT JOIN phrase_lists p USING (cluster_id))"""
)


def greedy_cte(bag: str, key: str, order: str, src: str, threshold: float = lx.DUPLICATE_SIMILARITY) -> str:
    """The sequential rule as a recursion over the items in order; the result is ``kept(key)``."""

    return f"""pairs AS MATERIALIZED (SELECT l.{key} AS lid, r.{key} AS rid, round(sum(l.w * r.w), 9) AS sim
  FROM {bag} l JOIN {bag} r USING (bucket) GROUP BY ALL HAVING sim >= {threshold}
), places AS MATERIALIZED (SELECT {key} AS id, row_number() OVER (ORDER BY {order}) AS place FROM {src}
), near AS MATERIALIZED (SELECT p.place, list(q.place) FILTER (q.place < p.place) AS earlier
  FROM places p LEFT JOIN pairs ON lid = p.id LEFT JOIN places q ON q.id = rid GROUP BY 1
), walk AS (SELECT 0::BIGINT AS place, []::BIGINT[] AS taken UNION ALL
  SELECT w.place + 1, CASE WHEN list_has_any(coalesce(n.earlier, []), w.taken) THEN w.taken ELSE list_append(w.taken, w.place + 1) END
  FROM walk w JOIN near n ON n.place = w.place + 1
), kept AS (SELECT id AS {key} FROM places JOIN (SELECT unnest(taken) AS place FROM (SELECT taken FROM walk ORDER BY walk.place DESC LIMIT 1)) USING (place))"""


DEDUPED_CTE = (
    BUILT_CTE
    + ", "
    + bag_cte("tbag", "built", "cluster_id", "body_template")
    + ", "
    + greedy_cte("tbag", "cluster_id", "cluster_size DESC, cluster_id", "built", lx.DUPLICATE_SIMILARITY)
    + """, mined AS MATERIALIZED (SELECT built.* FROM built JOIN kept USING (cluster_id))"""
)


def template_rows(src: str) -> str:
    return f"""SELECT template_id, cluster_id, cluster_size, category, tone, sentiment, intent, subject_template, body_template,
  array_to_string(placeholders, ',') AS placeholders, representative_email_id,
  round(similarity_to_centroid, 6) AS similarity_to_centroid, array_to_string(common_phrases, '|') AS common_phrases FROM {src}"""
