"""The same results in SQL (DuckDB), for the queries that SQL can express on whole tables."""

from __future__ import annotations

from tidemark.llm.licenses import DIGITS, LAST_RESORT, LEAST, LEAST_TERMS, NEGATIONS, QUOTES, SHELF, TEMPLATES
from tidemark.llm.mixing import SCHEDULES

WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

OP1 = """
WITH good AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c) OR abs(c::DOUBLE) * 256 >= 9223372036854775808)) = 0
), vectors AS (
  SELECT rid, vec_id, list_resize(v, (SELECT greatest(1, max(len(v))) FROM good), 0) AS v FROM good
), scored AS (
  SELECT q.rid AS query, q.vec_id AS query_id, x.rid, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM vectors q, vectors x WHERE q.vec_id % 50 = 0 AND q.rid <> x.rid
)
SELECT query_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, rid)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP2 = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, role, text, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM turns
), answers AS (
  SELECT conv_id, text, head, body, pos FROM placed WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
), sides AS (
  SELECT x.conv_id, x.pos - (x.text <> y.text)::INT AS n, CASE WHEN x.text = y.text THEN '' ELSE y.head || y.body END AS rejected,
         CASE WHEN x.text = y.text THEN '' ELSE length(y.head) || ',' || length(y.body) END AS rejected_mask
  FROM answers x JOIN answers y ON xor(x.conv_id, 1) = y.conv_id
), drawn AS (
  SELECT conv_id, pos, coalesce(n, 0) AS n, head || body AS line, rejected, rejected_mask,
         CASE WHEN role = 'assistant' THEN length(head) || ',' || length(body) ELSE (length(head) + length(body)) || ',0' END AS mask
  FROM placed LEFT JOIN sides USING (conv_id)
)
SELECT conv_id AS pair_id, n AS n_prompt_turns, coalesce(string_agg(line, '' ORDER BY pos) FILTER (pos <= n), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (pos > n), '') AS chosen, any_value(rejected) AS rejected,
  coalesce(string_agg(mask, ',' ORDER BY pos) FILTER (pos > n), '') AS chosen_mask, any_value(rejected_mask) AS rejected_mask
FROM drawn GROUP BY conv_id, n
"""

OP5 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, {WORDS} AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d
), windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM repeated) GROUP BY rid
), stats AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         len(regexp_extract_all(t, '\\p{{Lu}}'))::BIGINT AS n_capitals
  FROM w LEFT JOIN covered USING (rid)
), base AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR (n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_capitals > 50 * word_chars) AS kept
FROM base
"""



def _time(share: str, knots) -> str:
    """The inverse of a schedule's integral, piece by piece."""
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (w0 + w1) / 2 * (t1 - t0))
    cases = []
    for k, ((t0, w0), (t1, w1)) in enumerate(zip(knots, knots[1:], strict=False)):
        part = f"greatest({share} * {areas[-1]}::DOUBLE - {areas[k]}::DOUBLE, 0::DOUBLE)"
        root = f"sqrt(greatest({w0 * w0}::DOUBLE + {2 * (w1 - w0) / (t1 - t0)}::DOUBLE * {part}, 0::DOUBLE))"
        within = f"{t0}::DOUBLE + CASE WHEN {part} > 0 THEN 2::DOUBLE * {part} / ({w0}::DOUBLE + {root}) ELSE 0::DOUBLE END"
        cases.append(f"WHEN {share} * {areas[-1]}::DOUBLE <= {areas[k + 1]}::DOUBLE THEN least({within}, {t1}::DOUBLE)")
    return f"CASE {' '.join(cases)} ELSE {knots[-1][0]}::DOUBLE END"


def _position(take: str, offset: str) -> str:
    share = f"(({offset}) + {take} / 2::DOUBLE) / target"
    places = " ".join(f"WHEN {k} THEN {_time(share, knots)}" for k, knots in enumerate(SCHEDULES))
    return f"CASE WHEN {take} > 0 THEN CASE place {places} END END"


OP6 = f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || t), 1, 15) AS key
  FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM d GROUP BY source
), c AS (
  SELECT *, [3.0, 1.0, 2.0][place + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), f AS (
  SELECT *, first_value(CASE WHEN cap >= weight * level THEN level END IGNORE NULLS) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS set_at FROM l
), t AS (
  SELECT source, source_size, place, CASE WHEN set_at IS NULL THEN cap ELSE weight * set_at END AS target FROM f
), p AS (
  SELECT d.doc_id, d.size, t.*, floor(target)::BIGINT AS quota,
         (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, greatest(0, least(start + size, least(quota, source_size)) - start) AS take_1,
         greatest(0, least(start + size, quota - source_size) - start) AS take_2 FROM p
)
SELECT doc_id, size, source_size, target, (take_1 + take_2)::BIGINT AS taken,
  {_position("take_1", "start")} AS position_1, {_position("take_2", "source_size + start")} AS position_2
FROM k
"""

_VALUES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))
_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_NEGATIONS = ", ".join(f"'{t}'" for t in NEGATIONS)
_QUOTED = "regexp_matches({}, '^\\s*[" + QUOTES.replace("'", "''") + "]')"

OP10 = f"""
WITH templates(tid, name, t) AS (VALUES {_VALUES}
), tterms AS (
  SELECT tid, name, term, count(*) AS n FROM (SELECT tid, name, unnest({_TERMS.format("t")}) AS term FROM templates) GROUP BY ALL
), twhole AS (
  SELECT tid, least({LEAST_TERMS}, count(*)) AS needed, coalesce(list(term) FILTER (term IN ({_NEGATIONS})), []) AS negations FROM tterms GROUP BY tid
), placed AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '_') AS top, coalesce(source, '_') || '/' || coalesce(lang, '_') AS middle,
         coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(floor(doc_id / {SHELF}.0)::BIGINT::VARCHAR, '_') AS shelf FROM documents
), d AS (
  SELECT row_number() OVER () AS rid, *, CASE WHEN doc_id % 100 = 0 THEN top WHEN doc_id % 10 = 0 THEN middle ELSE shelf END AS directory FROM placed
), split AS (
  SELECT rid, unnest(range(len(parts))) AS k, unnest(parts) AS line FROM (SELECT rid, string_split(t, chr(10)) AS parts FROM d)
), lines AS (
  SELECT rid, k, ts, {_QUOTED.format("line")} AS quoted FROM (SELECT rid, k, line, {_TERMS.format("line")} AS ts FROM split) WHERE len(ts) > 0
), pieces AS (
  SELECT rid, 0 AS kind, k, ts, quoted FROM lines
  UNION ALL
  SELECT rid, 1, min(k), flatten(list(ts ORDER BY k)), arg_min(quoted, k) FROM (SELECT *, k - row_number() OVER (PARTITION BY rid ORDER BY k) AS run FROM lines) GROUP BY rid, run
  UNION ALL
  SELECT rid, 2, -1, {_TERMS.format("t")}, {_QUOTED.format("t")} FROM d
), terms AS (
  SELECT rid, kind, k, term, count(*) AS n FROM (SELECT rid, kind, k, unnest(ts) AS term FROM pieces WHERE NOT quoted OR kind = 2) GROUP BY ALL
), negated AS (
  SELECT rid, kind, k, list(term) AS negations FROM terms WHERE term IN ({_NEGATIONS}) GROUP BY ALL
), total AS (
  SELECT count(*) AS docs FROM d
), idf AS (
  SELECT term, ln((1 + docs) / (1 + n)) + 1 AS w FROM (SELECT term, count(*) AS n FROM terms WHERE kind = 2 GROUP BY term), total
), tweights AS (
  SELECT tid, name, term, n * coalesce(w, ln(1 + docs) + 1) AS w FROM tterms LEFT JOIN idf USING (term), total
), tvectors AS (
  SELECT tid, name, term, w / sqrt(sum(w * w) OVER (PARTITION BY tid)) AS v FROM tweights
), weights AS (
  SELECT rid, kind, k, term, n * w AS w FROM terms JOIN idf USING (term)
), norms AS (
  SELECT rid, kind, k, sqrt(sum(w * w)) AS norm FROM weights GROUP BY ALL
), cosines AS (
  SELECT rid, kind, k, tid, name, count(*) AS shared, round(sum(w * v) / any_value(norm), {DIGITS}) AS score
  FROM weights JOIN tvectors USING (term) JOIN norms USING (rid, kind, k) GROUP BY rid, kind, k, tid, name
), matches AS (
  SELECT c.rid, c.kind, c.k, c.name, c.score FROM cosines c JOIN twhole USING (tid) LEFT JOIN negated g USING (rid, kind, k) JOIN pieces p USING (rid, kind, k)
  WHERE score >= {LEAST} AND shared >= needed AND NOT p.quoted AND list_has_all(twhole.negations, coalesce(g.negations, []))
), first_lines AS (
  SELECT rid, min(k) AS k FROM lines GROUP BY rid
), files AS (
  SELECT DISTINCT m.rid FROM matches m JOIN first_lines f USING (rid) WHERE m.kind = 2 OR m.k = f.k
), own AS (
  SELECT rid, name, least(score, 1.0) AS score, k FROM matches
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY name = '{LAST_RESORT}', score DESC, name, kind, k) = 1
), votes AS (
  SELECT directory, name, count(*) AS n FROM d JOIN own USING (rid) JOIN files USING (rid) GROUP BY ALL
), given AS (
  SELECT directory, name FROM votes QUALIFY row_number() OVER (PARTITION BY directory ORDER BY n DESC, name) = 1
), heirs AS (
  SELECT rid, given.name, given.directory AS giver FROM d JOIN given ON given.directory IN (d.directory, d.top, CASE WHEN d.directory <> d.top THEN d.middle END)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(given.directory) DESC) = 1
)
SELECT doc_id, directory || '/' || coalesce(doc_id::VARCHAR, '_') || '.txt' AS path, own.name AS own_license,
       round(own.score, 6) AS score, own.k::VARCHAR AS line, coalesce(own.name, heirs.name) AS license,
       CASE WHEN own.name IS NULL THEN giver END AS inherited_from
FROM d LEFT JOIN own USING (rid) LEFT JOIN heirs USING (rid)
"""

SQL: dict[str, str] = {
    "op1_exact_top_k": OP1,
    "op10_license_scan": OP10,
    "op2_preference_formatting": OP2,
    "op5_quality_rules": OP5,
    "op6_source_mixing": OP6,
}
