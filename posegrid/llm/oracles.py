"""SQL for the operators that SQL can express, as DuckDB runs it over whole tables."""

from __future__ import annotations

from . import interleave, outliers, raking, urlblock

_UP, _LOW = urlblock.UPPER, urlblock.LOWER
#: Concentration steps and raking sweeps that the SQL unrolls; both are stable long before.
SQL_STEPS, SQL_SWEEPS, SQL_CAPS = 12, 24, 12
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id, least(w.doc_id, coalesce(c.m, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id"""


def _host(url: str) -> str:
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{_UP}', '{_LOW}')"


def _path(url: str) -> str:
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    return f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def _rule(host: str, path: str) -> str:
    cases = []
    for _, rule in sorted(urlblock.RULES, key=lambda x: -len(x[1])):
        name, _, rest = rule.partition("/")
        cases.append(f"WHEN ({host} = '{name}' OR ends_with({host}, '.{name}')) AND starts_with({path}, '/{rest}') THEN '{rule}'")
    return f"CASE {' '.join(cases)} END"


def _says(rule: str) -> str:
    return "CASE " + " ".join(f"WHEN {rule} = '{r}' THEN '{v}'" for v, r in urlblock.RULES) + " END"


def _spelling(url: str) -> str:
    host = f"CASE WHEN regexp_matches({_host(url)}, '^(www|m|amp|mobile)\\..*\\.') THEN regexp_replace({_host(url)}, '^(www|m|amp|mobile)\\.', '') ELSE {_host(url)} END"
    path = f"regexp_replace(regexp_replace({_path(url)}, '/index\\.[a-z]+$', '/'), '(\\.html?|/)$', '')"
    query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '{urlblock.TRACKING}'))), '&')"
    return f"CASE WHEN {_host(url)} <> '' THEN ({host}) || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"


def _tag(tag: str, has: str, attribute: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<{tag}\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\b{has}')), lambda t: regexp_extract(t, '(?is)\\b{attribute}', 1))[1:1]"


_Q = "[\"'']?"
_LINKS = "list_concat(" + ", ".join([
    _tag("link", rf"rel\s*=\s*{_Q}canonical\b", rf"href\s*=\s*{_Q}([^\"''\s>]+)"), _tag("meta", rf"property\s*=\s*{_Q}og:url\b", rf"content\s*=\s*{_Q}([^\"''\s>]+)"),
    _tag("meta", rf"http-equiv\s*=\s*{_Q}refresh\b", rf"url\s*=\s*{_Q}([^\"''\s>;]+)"),
    r"[regexp_extract(coalesce(html, ''), '(?is)\blocation(?:\.href)?\s*=\s*[\"'']([a-z]+://[^\"''\s]+)[\"'']', 1)]", r"[regexp_extract(coalesce(html, ''), '(?is)\blocation\.replace\(\s*[\"'']([a-z]+://[^\"''\s]+)[\"'']', 1)]"]) + ")"

URLS = f"""WITH RECURSIVE u AS (SELECT page_id, url, {_host('url')} AS host, {_path('url')} AS path, {_spelling('url')} AS node, list_filter({_LINKS}, lambda x: strpos(x, '://') > 0) AS links FROM (SELECT page_id, coalesce(url, '') AS url, html FROM pages) p),
j AS (SELECT *, {_rule('host', 'path')} AS rule FROM u),
t AS (SELECT node AS a, {_spelling('url')} AS b, {_host('url')} AS host, {_path('url')} AS path FROM (SELECT node, unnest(links) AS url FROM j) x),
d AS (SELECT node, {_says('rule')} AS says FROM j UNION ALL SELECT b, {_says(_rule('host', 'path'))} FROM t),
e AS (SELECT a, b FROM t WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM t WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT DISTINCT node, node AS other FROM d WHERE node IS NOT NULL UNION SELECT a, b FROM r),
s AS (SELECT m.node, bool_or(d.says = 'block') AND NOT coalesce(bool_or(d.says = 'allow'), false) AS blocked FROM m JOIN d ON d.node = m.other AND d.says IS NOT NULL GROUP BY m.node)
SELECT page_id, host, path, rule, coalesce({_says('rule')}, CASE WHEN coalesce(s.blocked, false) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(s.blocked, false) AS component_blocked
FROM j LEFT JOIN s ON s.node = j.node"""


def _crc_table() -> str:
    """The reflected CRC-32 table, a shift at a time."""
    inner = "SELECT CAST(k AS BIGINT) AS k, CAST(k AS BIGINT) AS n FROM range(256) q(k)"
    for _ in range(8):
        inner = f"SELECT k, CASE WHEN n & 1 = 1 THEN xor(n >> 1, 3988292384) ELSE n >> 1 END AS n FROM ({inner}) z"
    return f"crc_table AS (SELECT list(n ORDER BY k) AS t FROM ({inner}) z)"


SHARDS = f"""WITH {_crc_table()},
bytes AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS b FROM documents),
rows AS (SELECT doc_id, coalesce('=' || source, '') AS source, CAST(size AS BIGINT) AS size, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT)) AS crc FROM bytes, crc_table),
keyed AS (SELECT *, md5('{interleave.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || crc) AS key FROM rows),
ranked AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id, crc, size) - 1) * 1e0 / (2 * count(*) OVER (PARTITION BY source)) AS f FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY f, source) - 1 AS position, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(position * 16 // n AS INT) AS shard, position - ((position * 16 // n) * n + 15) // 16 AS slot, CAST(NULL AS INT) AS grown_shard FROM placed"""


def _outliers() -> str:
    text = "coalesce(text, '')"
    count = lambda what: f"CAST(length(regexp_replace({text}, '[^{what}]+', '', 'g')) AS BIGINT)"
    d, z = outliers.D, ", ".join(outliers.Z)
    windows = rf"""g AS (SELECT id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS s
    FROM w WHERE len(w) >= 3),
a AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS k FROM g) x WHERE k > 1),
c AS (SELECT id, count(DISTINCT i + k) AS n FROM a, range(3) q(k) GROUP BY id)"""
    sql = rf"""WITH w AS (SELECT row_number() OVER () AS id, doc_id, lang, source, {_WORDS.format(text)} AS w,
    list_filter(string_split({text}, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    {count('#*$%&|<>')} AS n_symbols, {count('!?.,;:')} AS n_marks, {count('A-ZÀ-ÖØ-Þ')} AS n_capitals FROM documents),
{windows},
counted AS (SELECT w.id, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, n_marks, n_capitals, CAST(len(l) AS BIGINT) AS n_lines
    FROM w LEFT JOIN c ON c.id = w.id),
stats AS (SELECT *, ({outliers.BASE_FAILED}) AS base_failed, coalesce('=' || lang, '') AS of_lang, coalesce('=' || source, '') AS of_source FROM counted),
good AS MATERIALIZED (SELECT id, of_lang, of_source, {', '.join(outliers.vector_columns())} FROM stats WHERE NOT base_failed),
v AS MATERIALIZED (SELECT unnest([{', '.join(outliers.NAMES.values())}]) AS g, {z} FROM good),
middle AS MATERIALIZED (SELECT g, count(*) AS n, {', '.join(f"quantile_cont(z{i}, 0.5) AS m{i}" for i in range(d))} FROM v GROUP BY g),
spread AS (SELECT g, {', '.join(f"quantile_cont(abs(z{i} - m{i}), 0.5) AS u{i}" for i in range(d))} FROM v JOIN middle USING (g) GROUP BY g),
near0 AS MATERIALIZED ({' UNION ALL '.join(f"SELECT g, {k} AS start, {z}, {outliers.level(x)} AS q FROM v JOIN middle USING (g) JOIN spread USING (g)" for k, x in enumerate(outliers.start_distances()))})"""
    fit = ", ".join(outliers.FIT)
    sums = [x.rpartition(" AS ")[2] for x in outliers.moments()]
    # As many steps as any table needs here: a fit that no longer moves stays as it is.
    for k in range(SQL_STEPS + 1):
        sql += f""",
levels{k} AS (SELECT g, start, q, count(*) AS here FROM near{k} GROUP BY g, start, q),
below{k} AS (SELECT *, sum(here) OVER (PARTITION BY g, start ORDER BY q) - here AS below, sum(here) OVER (PARTITION BY g, start) AS n FROM levels{k}),
share{k} AS (SELECT g, start, q, least(1e0, (least(n, (n + {d} + 1) // 2) - below) * 1e0 / here) AS share FROM below{k} WHERE below < least(n, (n + {d} + 1) // 2)),
part{k} AS (SELECT g, start, share, {', '.join(outliers.moments())} FROM near{k} JOIN share{k} USING (g, start, q) GROUP BY g, start, share),
sum{k} AS (SELECT g, start, {', '.join(f'sum(share * {x}) AS {x}' for x in sums)} FROM part{k} GROUP BY g, start)"""
        last = f"sum{k}"
        for i, columns in enumerate(outliers.covariance_stages() + outliers.factor_stages()):
            sql += f", f{k}_{i} AS (SELECT *, {', '.join(columns)} FROM {last})"
            last = f"f{k}_{i}"
        sql += f", new{k} AS MATERIALIZED (SELECT g, start, {fit}, {outliers.LOG_DET} AS log_det FROM {last})"
        if k:
            better = f"b.log_det < a.log_det - {outliers.STABLE!r}"
            sql += f", model{k} AS MATERIALIZED (SELECT g, start, {', '.join(f'CASE WHEN {better} THEN b.{x} ELSE a.{x} END AS {x}' for x in (*outliers.FIT, 'log_det'))} FROM model{k - 1} a JOIN new{k} b USING (g, start))"
        else:
            sql += ", model0 AS MATERIALIZED (SELECT * FROM new0)"
        if k < SQL_STEPS:
            last = f"(SELECT * FROM v JOIN model{k} USING (g)) x"
            for i, columns in enumerate(outliers.distance_stages()):
                sql += f", d{k}_{i} AS (SELECT *, {', '.join(columns)} FROM {last})"
                last = f"d{k}_{i}"
            sql += f", near{k + 1} AS MATERIALIZED (SELECT g, start, {z}, {outliers.level('d2')} AS q FROM {last})"
    sql += f""",
best AS MATERIALIZED (SELECT b.*, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY log_det, start) AS k FROM model{SQL_STEPS}) b JOIN middle USING (g) WHERE k = 1),
named AS (SELECT of_lang, of_source, {', '.join(f'{x} AS g_{k}' for k, x in outliers.NAMES.items())} FROM (SELECT DISTINCT of_lang, of_source FROM good) x),
shrunk AS (SELECT of_lang, of_source, {', '.join(outliers.shrunk())} FROM named JOIN best own ON own.g = g_own JOIN best lang ON lang.g = g_lang JOIN best whole ON whole.g = g_whole)"""
    last = "shrunk"
    for i, columns in enumerate(outliers.factor_stages()):
        sql += f", s_{i} AS (SELECT *, {', '.join(columns)} FROM {last})"
        last = f"s_{i}"
    last = f"(SELECT * FROM good JOIN {last} USING (of_lang, of_source)) x"
    for i, columns in enumerate(outliers.distance_stages()):
        sql += f", e_{i} AS (SELECT *, {', '.join(columns)} FROM {last})"
        last = f"e_{i}"
    return sql + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND d2 <= {outliers.CUTOFF!r}e0 AS kept, round(d2, 6) AS d2
FROM stats LEFT JOIN {last} USING (id)"""


def _rake() -> str:
    text = "coalesce(text, '')"
    keys = ("mix_source", "mix_lang", "mix_topic")
    topic = "CASE WHEN text IS NULL THEN 'none' WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[0-9]{3}') THEN 'records' WHEN contains(text, chr(10)) THEN 'article' ELSE 'note' END"
    sql = f"""WITH r AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS mix_source, coalesce('=' || lang, '') AS mix_lang, {topic} AS mix_topic, CAST(len({_WORDS.format(text)}) AS BIGINT) AS n,
    CAST(CAST('0x' || substr(md5('{raking.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / {float(16**12)!r}e0 AS unit FROM documents),
c0 AS MATERIALIZED (SELECT {', '.join(keys)}, CAST(sum(n) AS BIGINT) AS tokens, 1e0 AS raked FROM r GROUP BY ALL), total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS t FROM c0)"""
    for key in keys:
        sql += f""", of_{key} AS (SELECT {key}, CAST(sum(tokens) AS DOUBLE) AS s FROM c0 GROUP BY 1),
goal_{key} AS MATERIALIZED (SELECT {key}, CASE WHEN s > 0 THEN pow(s, {raking.TEMPER}) ELSE 0e0 END / (SELECT sum(CASE WHEN s > 0 THEN pow(s, {raking.TEMPER}) ELSE 0e0 END) FROM of_{key}) * (SELECT t FROM total) AS goal FROM of_{key})"""
    k = 0
    for _ in range(SQL_SWEEPS):
        for key in keys:
            sql += f""", c{k + 1} AS MATERIALIZED (SELECT {', '.join('c.' + x for x in keys)}, tokens, raked * CASE WHEN sum(tokens * raked) OVER (PARTITION BY c.{key}) > 0 THEN goal / sum(tokens * raked) OVER (PARTITION BY c.{key}) ELSE 1e0 END AS raked FROM c{k} c JOIN goal_{key} o ON o.{key} = c.{key})"""
            k += 1
    sql += f", p0 AS (SELECT {raking.BUDGET!r}e0 AS c)"
    for i in range(SQL_CAPS):
        sql += f""", p{i + 1} AS MATERIALIZED (SELECT greatest(c, coalesce(({raking.BUDGET!r}e0 * (SELECT t FROM total) - coalesce((SELECT sum(tokens) FROM c{k} WHERE raked * c >= 1), 0)) / (SELECT sum(tokens * raked) FROM c{k} WHERE NOT raked * c >= 1), c)) AS c FROM p{i})"""
    value = lambda x: f"CASE WHEN mix_{x} <> '' THEN substr(mix_{x}, 2) END AS {x}"
    return sql + f"""
SELECT doc_id, {value('source')}, {value('lang')}, mix_topic AS topic, n AS n_tokens, round(raked, 6) AS raked, round(p, 6) AS probability, round(raked / p, 6) AS weight, unit < p AS sampled
FROM (SELECT r.*, raked, least(1e0, raked * (SELECT c FROM p{SQL_CAPS})) AS p FROM r JOIN c{k} USING ({', '.join(keys)})) x"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_equivalence": URLS, "op3_robust_outliers": _outliers(), "op6_raked_mixture": _rake(), "op9_bayes_near_dedup": NEAR, "op10_stratified_shards": SHARDS}
