"""SQL with the results of this subpackage's queries where SQL has a form for them, for DuckDB over the same tables."""

from __future__ import annotations

from parley.llm.decontamination import WINDOW
from parley.llm.licenses import BASE, ENOUGH, MORE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _licenses() -> str:
    """Every start at which a template's key phrase stands, with the share of its words in place."""
    rows = ", ".join(
        f"({n}, '{t.label}', {t.tokens}, {t.key_from}, {t.key.split()}, {str(n < len(BASE)).lower()})" for n, t in enumerate([*BASE, *MORE])
    )
    return f"""WITH d AS (SELECT doc_id, {_WORDS} w FROM documents),
  t(n, label, words, at_key, key, base) AS (VALUES {rows}),
  p AS (SELECT doc_id, w, unnest(range(len(w))) i FROM d),
  h AS (SELECT doc_id, w, n, label, words, base, i - at_key AS start FROM p JOIN t ON w[i + 1] = key[1] WHERE w[i + 1:i + len(key)] = key),
  f AS (SELECT doc_id, label, base, start, len(list_filter(words, lambda x, k: start + k >= 1 AND w[greatest(start + k, 1)] = x)) / len(words) share FROM h),
  g AS (SELECT doc_id, count(*) FILTER (base) n_base, min(start) FILTER (base) first_word, max(start) FILTER (base) last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) base_labels, string_agg(DISTINCT label, ',' ORDER BY label) labels, max(share) score
    FROM f WHERE share >= {ENOUGH} GROUP BY doc_id)
  SELECT d.doc_id, len(w) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
    coalesce(score, 0.0)::DOUBLE score FROM d LEFT JOIN g USING (doc_id)"""


OP5 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] x FROM embeddings),
  l AS MATERIALIZED (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
  r AS (SELECT vec_id a, vec_id b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  c AS (SELECT a vec_id, min(b) component_id FROM r GROUP BY 1), n AS (SELECT a vec_id, count(*) n_links FROM l GROUP BY 1)
  SELECT vec_id, coalesce(n_links, 0) n_links, component_id, vec_id = component_id kept FROM c LEFT JOIN n USING (vec_id)"""


OP9 = f"""WITH d AS (SELECT doc_id, {_WORDS} w FROM documents), b AS (SELECT item_id, {_WORDS} w FROM benchmark),
  bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) n, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') t FROM
    (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) k FROM b WHERE len(w) > 0)),
  dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') t FROM
    (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) k FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n)),
  m AS (SELECT DISTINCT doc_id, k, bw.n, item_id FROM dw JOIN bw USING (n, t)),
  x AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) p FROM (SELECT DISTINCT doc_id, k, n FROM m)) GROUP BY 1),
  y AS (SELECT doc_id, count(*) n_items, string_agg(i, ',' ORDER BY i) s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) i FROM m) GROUP BY 1)
  SELECT d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)"""

OP11 = """WITH d AS (SELECT coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
  p AS (SELECT lang, row_number() OVER () piece, words FROM (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') words FROM d)),
  g AS (SELECT lang, array_to_string(words[i:i + k - 1], ' ') phrase, k, words[i:i + k - 1] w FROM
    (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) i FROM p, (VALUES (1), (2), (3)) s(k) WHERE len(words) >= k)),
  f AS MATERIALIZED (SELECT lang, phrase, k, any_value(w) w, any_value(list_prepend(lang, w)) own, count(*) a FROM g GROUP BY lang, phrase, k),
  n AS (SELECT lang, sum(a)::BIGINT n FROM f WHERE k = 1 GROUP BY lang),
  c AS MATERIALIZED (SELECT lang, phrase, k, w, a, cut, list_prepend(lang, w[1:cut]) lp, list_prepend(lang, w[cut + 1:k]) rp FROM f, (VALUES (1), (2)) t(cut) WHERE k > cut AND a >= 10),
  s AS (SELECT c.lang, c.phrase, c.k, c.w, c.a, cut, l.a l, r.a r, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) score
    FROM c JOIN f l ON l.own = c.lp JOIN f r ON r.own = c.rp
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
  longer AS (SELECT lang, part, max(a) a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) part FROM c WHERE k = 3) GROUP BY lang, part),
  o AS (SELECT s.* FROM s LEFT JOIN longer x ON x.lang = s.lang AND x.part = s.phrase AND s.k = 2 WHERE x.a IS NULL OR 100 * x.a < 50 * s.a)
  SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) rank, phrase, a, l, r, n, score::BIGINT score FROM o JOIN n USING (lang)
  QUALIFY rank <= 2000"""

OP13 = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v
    FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS MATERIALIZED (SELECT a.vec_id a, b.vec_id b, a.l = b.l same, list_dot_product(a.v, b.v)::BIGINT s FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
  SELECT a anchor_id, p.b positive_id, CAST(row_number() OVER (PARTITION BY a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) rank, n.b negative_id, p.s positive_score,
    n.s negative_score FROM p JOIN s n USING (a) WHERE NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
  QUALIFY row_number() OVER (PARTITION BY a, p.b ORDER BY n.s DESC, n.b) <= 3"""

ORACLES: dict[str, str] = {"op1_licenses": _licenses(), "op5_embeddings": OP5, "op9_decontamination": OP9, "op11_collocations": OP11, "op13_hard_negatives": OP13}
