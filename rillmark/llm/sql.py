"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from rillmark.llm import entropy_mix as e
from rillmark.llm import jsd_quality as q
from rillmark.llm import url_templates as u


def url_templates() -> str:
    """The rules, the shapes, the tree level by level, and the verdict."""
    fits = lambda r: f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')"
    longest = sorted(u.RULES, key=lambda r: -len(r.host + r.path))
    name = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.host}{r.path}'" for r in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in longest) + " END"
    purity = lambda by, parent: (
        f"(CAST(sum(blocked) OVER (PARTITION BY {by}) AS DOUBLE) + {parent} * {u.PRIOR_WEIGHT}) / "
        f"(CAST(sum(labelled) OVER (PARTITION BY {by}) AS DOUBLE) + {u.PRIOR_WEIGHT})"
    )
    return f"""
WITH RECURSIVE rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{u.UPPER}', '{u.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
ruled AS (
  SELECT *, {name} AS rule, {verdict} AS decided,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
      lambda s: CASE WHEN regexp_matches(s, '[0-9]') OR length(s) > {u.LONG_SEGMENT} THEN '*' ELSE s END) AS segments
  FROM parsed),
shaped AS (SELECT *, array_to_string(segments, '/') AS shape FROM ruled),
shapes AS (
  SELECT host, shape, string_split(shape, '/') AS segs, count(decided) AS labelled, count(*) FILTER (decided = 'block') AS blocked
  FROM shaped GROUP BY host, shape),
tree AS (
  SELECT host, shape, segs, labelled, blocked, '' AS template, {purity('host', u.PRIOR)} AS purity,
    count(*) OVER (PARTITION BY host) AS left_, 0 AS depth
  FROM shapes
  UNION ALL
  SELECT host, shape, segs, labelled, blocked, template || '/' || branch,
    CASE WHEN sum(labelled) OVER (PARTITION BY host, template, branch) = all_n THEN purity ELSE {purity('host, template, branch', 'purity')} END,
    count(*) OVER (PARTITION BY host, template, branch), depth + 1
  FROM (
    SELECT *, CASE WHEN segment IN ('', '*') THEN segment WHEN literals > {u.WIDEST} THEN '*'
      WHEN n < {u.LEAST_LABELS} OR n * (bad / n - pooled) * (bad / n - pooled) <= {u.SIMILAR_Z * u.SIMILAR_Z} * pooled * (1.0 - pooled) THEN '~'
      ELSE segment END AS branch
    FROM (
      SELECT *, sum(labelled) OVER (PARTITION BY host, template) AS all_n, sum(CASE WHEN nth = 1 AND segment NOT IN ('', '*') THEN 1 ELSE 0 END) OVER (PARTITION BY host, template) AS literals,
        CAST(sum(blocked) OVER (PARTITION BY host, template) AS DOUBLE) / CAST(sum(labelled) OVER (PARTITION BY host, template) AS DOUBLE) AS pooled
      FROM (
        SELECT *, CAST(sum(labelled) OVER (PARTITION BY host, template, segment) AS DOUBLE) AS n,
          CAST(sum(blocked) OVER (PARTITION BY host, template, segment) AS DOUBLE) AS bad,
          row_number() OVER (PARTITION BY host, template, segment ORDER BY shape) AS nth
        FROM (SELECT *, coalesce(segs[depth + 1], '') AS segment FROM tree WHERE left_ > 1 AND len(segs) >= depth)))) ),
rejected AS (SELECT host, shape FROM tree WHERE (left_ = 1 OR len(segs) < depth) AND purity > {u.REJECT_ABOVE})
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN r.shape IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, shape
FROM shaped LEFT JOIN rejected r USING (host, shape)
"""


_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def jaccard_components(percent: int = 85, n: int = 4) -> str:
    """All pairs that share a shingle, their links, and the smallest id that each document reaches."""
    words = _WORDS.format(f"translate(text, '{u.UPPER}', '{u.LOWER}')")
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= {n} THEN list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = s.doc_id) AS component_id FROM s
"""


def suffix_dedup(length: int = 50) -> str:
    """Every window of the bytes (as hex digits), the smallest document it starts in, and what is left."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), {2 * length}) AS x FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 - {length - 1} AS BIGINT))) AS p FROM d WHERE len(h) >= {2 * length})),
m AS (SELECT x, min(doc_id) AS first FROM w GROUP BY x HAVING count(*) > 1),
gone AS (SELECT doc_id, p FROM w JOIN m USING (x) WHERE first < doc_id),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {length} THEN 0 ELSE 1 END AS new FROM gone)),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + {length} AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
  UNION ALL SELECT doc_id, NULL, max(b) FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (coalesce(a, len(h) // 2) - since) AS BIGINT)), '' ORDER BY since) AS k
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def jsd_quality() -> str:
    """Base counts, the references of each language, both distances to each, and the verdict."""
    classes = (r"[\x20\x09-\x0D]", "[a-z]", "[A-Z]", "[0-9]", "[#*$%&|<>]", r"[!\x22\x27(),\-./:;?@\[\\\]^_`{}~+=]", r"[^\x00-\x7F]")
    count = lambda c: f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))"
    counts = ", ".join(f"CAST({count(c)} AS BIGINT)" for c in classes)
    term = "CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"
    both = lambda p, q: "(" + term.format(p=p, q=q) + " + " + term.format(p=q, q=p) + ")"
    return f"""
WITH d AS (SELECT doc_id, lang, text, coalesce(text, '') AS t, {_WORDS.format('text')} AS ws FROM documents),
cls AS (SELECT doc_id, list_prepend(length(t) - list_sum(c), c) AS c FROM (SELECT doc_id, t, [{counts}] AS c FROM d)),
pc AS (SELECT doc_id, list_transform(c, lambda x: x / greatest(list_sum(c), 1)) AS p FROM cls),
grams AS (SELECT doc_id, i, list_transform(range(0, 5), lambda j: ws[i + j]) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST({count('[#*$%&|<>]')} AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
lw AS (SELECT lang, unnest(ws) AS w FROM d WHERE lang IS NOT NULL AND text IS NOT NULL),
totals AS (SELECT lang, count(*) AS n FROM lw GROUP BY lang),
common AS (SELECT lang, w, k / n AS q FROM (SELECT lang, w, count(*) AS k FROM lw GROUP BY ALL) JOIN totals USING (lang) WHERE k >= {q.COMMON_SHARE} * n),
mass AS (SELECT lang, coalesce(sum(q), 0) AS q FROM totals LEFT JOIN common USING (lang) GROUP BY lang),
langs AS (SELECT lang, list_transform(range(1, 9), lambda i: s[i] / list_sum(s)) AS c, mass.q AS mass
  FROM (SELECT lang, list_transform(range(1, 9), lambda i: list_sum(list_transform(list(cls.c), lambda x: x[i]))) AS s FROM d JOIN cls USING (doc_id)
    WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang) JOIN mass USING (lang)),
dw AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
hits AS (SELECT doc_id, lang, sum(k / n_words) AS p, sum({both('(k / n_words)', 'q')} - q) AS part FROM dw JOIN common USING (w) JOIN base USING (doc_id) GROUP BY ALL),
far AS (
  SELECT doc_id, lang, n_words,
    sqrt(greatest(list_sum(list_transform(range(1, 9), lambda i: {both('p[i]', 'c[i]')})) / 2, 0)) AS c,
    sqrt(greatest((coalesce(part, 0) + mass + {both('o', 'r')}) / 2, 0)) AS w
  FROM (SELECT base.doc_id, langs.lang, n_words, pc.p, langs.c, mass, hits.part, greatest(1 - coalesce(hits.p, 0), 0) AS o0,
      CASE WHEN 1 - coalesce(hits.p, 0) > 1e-12 THEN 1 - coalesce(hits.p, 0) ELSE 0 END AS o, greatest(1 - mass, 0) AS r
    FROM base JOIN pc USING (doc_id) CROSS JOIN langs LEFT JOIN hits ON hits.doc_id = base.doc_id AND hits.lang = langs.lang WHERE n_words >= {q.GUARD_WORDS})),
best AS (
  SELECT doc_id, bool_or(c <= {q.CLASS_BOUND} AND w <= {q.WORD_BOUND} + {q.SHORT_ALLOWANCE} / sqrt(n_words)) AS fits,
    arg_min(struct_pack(lang := lang, c := c, w := w), c + w) AS b FROM far GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words) AND coalesce(fits, true) AS kept,
  b.lang AS nearest, round(b.c, 6) AS class_distance, round(b.w, 6) AS word_distance
FROM base LEFT JOIN best USING (doc_id)
"""


def entropy_mix(weights: tuple[int, ...] = (1, 2, 3)) -> str:
    """Targets by raising the level source by source, the dual's closed form for one family, and the rounding."""
    octave = "(length(bin(size + 1)) - 1)"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({_WORDS.format('text')}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, greatest(1, ceil(count(*) / {e.ROWS_PER_RUN}))::BIGINT AS runs FROM d GROUP BY source),
weighted AS (SELECT *, {list(weights)}[(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(weights)} + 1]::DOUBLE AS w FROM s),
ordered AS (SELECT *, {e.MAX_REPEAT} * source_size / w AS bound FROM weighted),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum({e.MAX_REPEAT} * source_size) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM ordered WINDOW b AS (ORDER BY bound, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, runs, least({float(e.MAX_REPEAT)} * source_size, w * coalesce(max(CASE WHEN bound > level THEN level END) OVER (), CAST('inf' AS DOUBLE))) AS target FROM levels),
rows_ AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, t.runs,
    {e.CLASSES_PER_OCTAVE} * {octave} + (size + 1 - (1::BIGINT << {octave})) * {e.CLASSES_PER_OCTAVE} // (1::BIGINT << {octave}) AS class,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(size AS VARCHAR)), 1, 15) AS BIGINT) AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT source, class, count(*) AS n, sum(size)::BIGINT AS tokens, sum(rate) AS rates, sum(rate * size) AS words, any_value(target) AS target,
    row_number() OVER (PARTITION BY source ORDER BY class DESC) AS nth
  FROM rows_ GROUP BY source, class),
l AS (SELECT source, sum(words) AS words FROM c GROUP BY source),
f AS (
  SELECT c.source, c.nth, c.class, c.n, c.target AS due, l.words AS left_,
    least(floor(CASE WHEN l.words > 0 THEN greatest(c.target, 0) / l.words ELSE 1 END * c.rates + 0.5), {e.MAX_REPEAT} * c.n)::BIGINT AS given, c.tokens, c.words
  FROM c JOIN l ON c.source IS NOT DISTINCT FROM l.source WHERE nth = 1
  UNION ALL
  SELECT source, nth, class, n, due, left_, least(floor(CASE WHEN left_ > 0 THEN greatest(due, 0) / left_ ELSE 1 END * rates + 0.5), {e.MAX_REPEAT} * n)::BIGINT, tokens, words
  FROM (SELECT c.source, c.nth, c.class, c.n, f.due - f.given::DOUBLE * f.tokens / f.n AS due, f.left_ - f.words AS left_, c.rates, c.tokens, c.words
    FROM f JOIN c ON f.source IS NOT DISTINCT FROM c.source AND c.nth = f.nth + 1)),
placed AS (SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY draw % runs, draw, doc_id, size) AS place FROM rows_),
dealt AS (
  SELECT p.doc_id, p.size, p.source_size, p.target,
    CASE WHEN p.size = 0 THEN 1 ELSE (2 * place * given + n) // (2 * n) - (2 * (place - 1) * given + n) // (2 * n) END AS copies
  FROM placed p JOIN f ON p.source IS NOT DISTINCT FROM f.source AND p.class = f.class)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM dealt
"""
