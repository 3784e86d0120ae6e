"""DuckDB SQL for the opN_ queries that SQL can express; the others are held against brute force in tests/llm."""

from __future__ import annotations

from siloflow.llm import decontam, licenses, mixing
from siloflow.llm.common import LOWER, UPPER

_BLANKS = r"[\x20\x09-\x0D]+"


def _words(text: str, separator: str = _BLANKS) -> str:
    return f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{separator}'), lambda x: x <> '')"


def _shingles(w: str, k: int) -> str:
    run = " || ' ' || ".join(f"{w}[i + {j}]" for j in range(k))
    return f"CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < {k} THEN [array_to_string({w}, ' ')] ELSE list_distinct(list_transform(range(1, len({w}) - {k - 2}), lambda i: {run})) END"


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents), b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
q AS (SELECT item_id, len(s) AS size, unnest(s) AS shingle FROM (SELECT item_id, {_shingles("w", decontam.K)} AS s FROM b) t),
s AS (SELECT doc_id, unnest({_shingles("w", decontam.K)}) AS shingle FROM d),
hit AS (SELECT doc_id, item_id, size, count(DISTINCT shingle) AS n FROM s JOIN q USING (shingle) GROUP BY 1, 2, 3)
SELECT doc_id, item_id, n AS n_shared, CAST(size AS BIGINT) AS n_shingles, n::DOUBLE / size AS containment FROM hit WHERE n >= size * {decontam.THRESHOLD} - 1e-9
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
s AS (SELECT doc_id, {_shingles("w", 3)} AS s FROM d),
k AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) END AS key, s FROM s),
c AS (SELECT key, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM k WHERE key IS NOT NULL GROUP BY key),
x AS (SELECT rep, n, unnest(s) AS shingle FROM c),
pairs AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.rep < b.rep
          AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
link AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
comp AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT k.doc_id, k.n AS n_shingles, coalesce(component_id, k.doc_id) AS component_id, coalesce(component_id, k.doc_id) = k.doc_id AS kept
FROM k LEFT JOIN c ON c.key = k.key LEFT JOIN comp ON comp.rep = c.rep
"""


def _licenses() -> str:
    rows = []
    for t, (label, phrase) in enumerate([*licenses.BASE, *licenses.STATEMENTS]):
        said = phrase.split()
        k = licenses.K if len(said) >= licenses.LONG else licenses.PAIR
        base = "true" if t < len(licenses.BASE) else "false"
        run = lambda j: ", ".join([*(f"'{w}'" for w in said[j : j + k]), *["NULL"] * (licenses.K - k)])  # noqa: B023, E731
        rows += [f"({t}, '{label}', {j}, {k}, {len(said) - k + 1}, {base}, {run(j)})" for j in range(len(said) - k + 1)]
    names = ", ".join(f"w{i}" for i in range(licenses.K))
    met = lambda k: f"SELECT r, t, label, k, pairs, base, i, j, i - j AS d FROM g JOIN (SELECT * FROM k WHERE k = {k}) q USING ({', '.join(f'w{i}' for i in range(k))})"
    least = f"CASE WHEN k = {licenses.K} THEN {licenses.MIN_COVER[licenses.K]} ELSE {licenses.MIN_COVER[licenses.PAIR]} END"
    return f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(rows)}) v(t, label, j, k, pairs, base, {names})),
d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text", licenses.SEPARATOR)} AS w FROM documents),
g AS (SELECT r, i, {", ".join(f"w[i + {i + 1}] AS w{i}" for i in range(licenses.K))} FROM (SELECT r, w, unnest(range(0, len(w) - 1)) AS i FROM d) t),
e AS ({met(licenses.PAIR)} UNION ALL {met(licenses.K)}),
v AS (SELECT r, t, base AND count(*) = pairs AS whole, d FROM e GROUP BY r, t, base, pairs, d),
n AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, t ORDER BY d) <= {licenses.MAX_SHIFT} THEN 0 ELSE 1 END AS fresh FROM v),
u AS (SELECT *, sum(fresh) OVER (PARTITION BY r, t ORDER BY d) AS run FROM n),
h AS (SELECT e.*, run, whole, j > coalesce(max(j) OVER (PARTITION BY e.r, e.t, run ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS onward FROM e JOIN u ON e.r = u.r AND e.t = u.t AND e.d = u.d),
m AS (SELECT r, t, label, k, pairs, base, run, count(*) FILTER (onward) AS held, min(i) AS lo, max(i) AS hi, count(DISTINCT d) FILTER (whole) AS places,
             min(d) FILTER (whole) AS first_place, max(d) FILTER (whole) AS last_place FROM h GROUP BY 1, 2, 3, 4, 5, 6, 7),
c AS (SELECT *, split_part(label, '-', 1) AS family, CASE WHEN base THEN CASE WHEN places > 0 THEN 1.0::DOUBLE ELSE 0 END
                     WHEN held::DOUBLE / pairs >= {least} AND hi - lo + k <= {licenses.STRETCH} * (pairs + k - 1) + {licenses.MAX_SHIFT} THEN held::DOUBLE / pairs ELSE 0 END AS cover FROM m),
f AS (SELECT *, cover > 0 AND NOT EXISTS (SELECT 1 FROM c x WHERE NOT x.base AND NOT c.base AND x.r = c.r AND x.family = c.family AND x.cover > c.cover AND x.lo <= c.hi AND x.hi >= c.lo) AS verified FROM c),
o AS (SELECT r, sum(places) AS n_base, min(first_place) AS first_word, max(last_place) AS last_word, list_sort(list(DISTINCT label) FILTER (base AND verified)) AS bl,
             list_sort(list(DISTINCT label) FILTER (verified)) AS l, max(cover) AS score FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN o USING (r)
"""


def _mixing() -> str:
    weight = " ".join(f"WHEN i % {len(mixing.WEIGHTS)} = {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    cls = " ".join(f"WHEN size >= {least} THEN {i}" for i, least in enumerate(mixing.CLASSES))
    steps, above = [], "0"
    for c in range(len(mixing.CLASSES)):
        got = f"coalesce((SELECT sum(k * size) FROM ({' UNION ALL '.join(f'SELECT sk, size, k FROM k{p}' for p in range(c))}) a WHERE a.sk = p.sk), 0)" if c else above
        steps.append(f"""
o{c} AS (SELECT p.sk, rest * (SELECT sum(size) FROM r WHERE r.sk = p.sk AND cls <= {c}) / source_size - {got} AS open FROM p WHERE EXISTS (SELECT 1 FROM r WHERE r.sk = p.sk AND cls <= {c} AND size > 0)),
k{c} AS (SELECT sk, h, size, n, greatest(0, least(n, CAST(floor((open - reached) / size + 0.5) AS BIGINT))) AS k FROM (
  SELECT g.*, open, coalesce(sum(n * size) OVER (PARTITION BY sk ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
  FROM (SELECT sk, h, max(size) AS size, count(*) AS n FROM r WHERE cls = {c} AND size > 0 GROUP BY sk, h) g JOIN o{c} USING (sk)) t WHERE open > 0)""")
    return f"""
WITH z AS (SELECT doc_id, source, coalesce(source, '') || CASE WHEN source IS NULL THEN '0' ELSE '1' END AS sk, CAST(len({_words("text")}) AS BIGINT) AS size FROM documents),
r AS (SELECT *, CASE {cls} END AS cls, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || size) AS h FROM z),
s AS (SELECT sk, source, sum(size) AS source_size FROM z GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM s),
w AS (SELECT *, (CASE {weight} END)::DOUBLE AS w, source_size * {float(mixing.MAX_EPOCHS)}::DOUBLE AS cap, (SELECT sum(source_size) FROM s) * {float(mixing.SHARE)}::DOUBLE AS total FROM i),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
               / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT sk, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level * w <= cap), 'inf'::DOUBLE) * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM t),
{",".join(steps)},
k AS ({" UNION ALL ".join(f"SELECT sk, h, k FROM k{c}" for c in range(len(mixing.CLASSES)))}),
x AS (SELECT r.*, row_number() OVER (PARTITION BY r.sk, r.h ORDER BY r.h) AS rn FROM r)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * (whole + CASE WHEN size > 0 AND rn <= coalesce(k, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x JOIN p USING (sk) LEFT JOIN k USING (sk, h)
"""


ORACLE: dict[str, str] = {
    "op2_decontamination": DECONTAMINATION,
    "op5_license_scan": _licenses(),
    "op8_near_duplicates": NEAR_DUPLICATES,
    "op10_mixing": _mixing(),
}
