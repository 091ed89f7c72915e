"""op11: the phrases of all documents whose words belong together."""

from __future__ import annotations

from freshet.llm.phrases import collocations


def op11_phrase_collocations(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LONGER = " UNION ALL ".join(f"SELECT lang, a, array_to_string(ws[{i}:{i + n - 1}], ' ') AS p FROM c WHERE len(ws) = {m}" for m in (3, 4) for n in range(2, m) for i in range(1, m - n + 2))

QUERIES = {"op11_phrase_collocations": op11_phrase_collocations}
ORACLES = {
    "op11_phrase_collocations": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents WHERE text IS NOT NULL
), p AS MATERIALIZED (SELECT d, lang, unnest(range(len(pieces))) AS i, unnest(pieces) AS piece FROM d),
t AS MATERIALIZED (SELECT d, lang, i, unnest(range(len(ws))) AS j, unnest(ws) AS w FROM (SELECT d, lang, i, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
g AS MATERIALIZED (
  SELECT lang, w AS w1, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3, lead(w, 3) OVER x AS w4 FROM t WINDOW x AS (PARTITION BY d, lang, i ORDER BY j)
), f AS MATERIALIZED (
  SELECT lang, 1 AS m, w1 AS p, count(*) AS a FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
), n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, p, a, string_split(p, ' ') AS ws FROM f WHERE m >= 2),
k AS MATERIALIZED (
  SELECT lang, p, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM c)
), s AS (
  SELECT k.lang, k.p, k.a, k.k, x.a AS l, y.a AS r, CAST((CAST(k.a AS HUGEINT) * 2000000) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.p = k.head JOIN f y ON y.lang = k.lang AND y.p = k.tail
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
o AS (SELECT lang, p, max(a) AS most FROM ("""
    + _LONGER
    + r""") GROUP BY lang, p),
z AS (
  SELECT b.lang, b.p AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN o ON o.lang = b.lang AND o.p = b.p
  WHERE o.most IS NULL OR CAST(o.most AS HUGEINT) * 100 < CAST(b.a AS HUGEINT) * 80
)
SELECT * FROM (
  SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY z.score DESC, z.a DESC, z.phrase) AS rank, z.phrase, z.a, z.l, z.r, n.n, z.score
  FROM z JOIN n ON n.lang = z.lang
) WHERE rank <= 2000
"""
}
