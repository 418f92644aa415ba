"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .mixing import LEVELS, WORD


def decontamination(guarantee: int) -> str:
    """Every window of every item looked up in every document."""
    words = r"regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"
    folded = words.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return f"""
WITH d AS (SELECT doc_id, {folded} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {folded} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least({guarantee}, len(w)) AS size, array_to_string(w[i:i + least({guarantee}, len(w)) - 1], ' ') AS gram
       FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {guarantee} + 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
       FROM (SELECT doc_id, w, size, unnest(range(1, greatest(0, len(w) - size + 1) + 1)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, dw.size, i, item FROM dw JOIN bw USING (size, gram)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _weight(weights: dict, level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.get(level, {}).items())
    return f"CAST(CASE {level} {cases} ELSE 1 END AS DOUBLE)" if cases else "CAST(1 AS DOUBLE)"


def _level(n: int, weights: dict) -> str:
    name, keys, parents = LEVELS[n], ", ".join(LEVELS[:n + 1]), ", ".join(LEVELS[:n])
    part = f"PARTITION BY {parents}" if parents else ""
    usable = "cap"
    for deeper in LEVELS[n + 1:]:
        usable = f"CASE WHEN {_weight(weights, deeper)} > 0 THEN {usable} ELSE 0 END"
    frame = f"({part} ORDER BY cap / nullif(w, 0) NULLS LAST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    join = f"JOIN g{n - 1} USING ({parents})" if n else "CROSS JOIN root"
    return f"""
a{n} AS (SELECT {keys}, sum({usable}) AS cap, sum(tokens) AS tokens, {_weight(weights, name)} AS w FROM leaf GROUP BY {keys}),
r{n} AS (SELECT *, (budget - coalesce(sum(cap) OVER {frame}, 0))
                   / nullif(sum(w) OVER ({part}) - coalesce(sum(w) OVER {frame}, 0), 0) AS rate FROM a{n} {join}),
f{n} AS (SELECT *, w > 0 AND cap / nullif(w, 0) <= rate AS short, max(CASE WHEN cap / nullif(w, 0) > rate THEN rate END) OVER ({part}) AS even FROM r{n}),
g{n} AS (SELECT {keys}, tokens AS t{n}, CAST(CASE WHEN w = 0 THEN 0 WHEN short THEN cap ELSE even * w END AS DOUBLE) AS budget FROM f{n})"""


def mixing(weights: dict, epochs: int, share: float, seed: int) -> str:
    """Water-filling per level, then the prefix of the last epoch of each leaf."""
    levels = ",".join(_level(n, weights) for n in range(3))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens,
                  coalesce('d' || (coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT), 0) % 4), '?') AS domain,
                  coalesce(lang, '?') AS language, coalesce(source, '?') AS leaf_source FROM documents),
leaf AS (SELECT domain, language, leaf_source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {epochs} AS BIGINT) AS cap
         FROM d GROUP BY 1, 2, 3),
root AS (SELECT CAST(sum(tokens) AS DOUBLE) * {share} AS budget FROM leaf),{levels},
q AS (SELECT d.*, budget AS quota, coalesce(CAST(floor(budget / nullif(t2, 0)) AS BIGINT), 0) AS epoch, t2
      FROM d JOIN g2 USING (domain, language, leaf_source)),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, leaf_source
             ORDER BY md5('{seed}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '?') || ':' || md5(text)), doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, domain, language, leaf_source, round(quota, 3) AS quota,
       CAST(epoch + CAST(before < quota - epoch * t2 AS INT) AS BIGINT) AS copies FROM o"""


def top_k(k: int) -> str:
    return f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.own <> c.own AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {k}"""


def fill_in_middle(seed: int, fim_percent: int, spm_percent: int) -> str:
    """Units as lists, cut by the hash; the text itself is what must be restored."""
    draws = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, {draws} FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low,
             greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fim_percent} THEN 'plain'
                  WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                        ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
