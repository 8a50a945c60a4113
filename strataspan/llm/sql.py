"""The queries' results in SQL, for DuckDB over the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = r"[^\x20\x09-\x0D]+"

OP3 = r"""
WITH said(t) AS (VALUES ('\### Assistant: </turn> ok')),
rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', t FROM said UNION ALL SELECT -7, 1, 'assistant', t FROM said),
esc AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e'), '<also/>', '\j') AS et,
    replace(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), '<also/>', '\j'), ':', '\c') AS er,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before_
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(et) + CASE WHEN before_ IS NULL OR before_ <> role THEN 4 + length(er) + 2 + 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WHITE}') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM line WHERE regexp_matches(x, '{_WHITE}') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    CAST(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (
  SELECT *, CAST(
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 20 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 50 * word_chars THEN 32 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM f
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, i AS k, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS u(i) WHERE len(ws) > 0),
dw AS (
  SELECT doc_id, i, m, array_to_string(ws[i : i + m - 1], ' ') AS s
  FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, CAST(len(ws) - m + 2 AS BIGINT))) AS u(i)),
hit AS (SELECT doc_id, i, m, item_id, k FROM dw JOIN bw USING (m, s)),
runs AS (
  SELECT doc_id, max(n) AS longest FROM (
    SELECT doc_id, count(*) + any_value(m) - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - k ORDER BY i) AS run FROM hit)
    GROUP BY doc_id, item_id, i - k, run) GROUP BY doc_id),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN runs USING (doc_id)
"""


def mixing(weights: dict[str, dict[str, int]], source: str = "documents", seed: int = 17, epochs: int = 2, share: str = "0.5") -> str:
    """Water filling level by level, then prefix sums over the seeded order."""
    own = {
        level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in weights[level].items()) + " ELSE 1 END" if weights.get(level) else "1"
        for level in ("domain", "lang", "source")
    }
    ctes = [
        rf"""d AS (
  SELECT doc_id, CASE WHEN num = '' THEN 'other' ELSE 'domain' || CAST(CAST(num AS BIGINT) % 4 AS VARCHAR) END AS domain, lang, source, n_tokens
  FROM (SELECT doc_id, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS num, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
          CAST(len(regexp_extract_all(coalesce(text, ''), '{_WHITE}')) AS BIGINT) AS n_tokens FROM {source}) WHERE n_tokens > 0)""",
        f"""leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {epochs} AS BIGINT) AS cap FROM d GROUP BY ALL)""",
        f"""n0 AS (SELECT CAST(least(floor(sum(tokens) * {share}), sum(cap)) AS BIGINT) AS budget FROM leaf)""",
    ]
    names = ["domain", "lang", "source"]
    for k, level in enumerate(names):
        keys, parent = ", ".join(names[: k + 1]), ", ".join(names[:k])
        part = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN n{k} USING ({parent})" if parent else f"CROSS JOIN n{k}"
        ctes += [
            f"c{k} AS (SELECT {keys}, CAST({own[level]} AS HUGEINT) AS weight, CAST(sum(cap) AS HUGEINT) AS cap FROM leaf GROUP BY ALL)",
            f"""s{k} AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER w AS rn
  FROM c{k} {join} WINDOW w AS ({part} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {level}))""",
            f"f{k} AS (SELECT *, cap * rest <= weight * (budget - spent) AS full_ FROM s{k})",
            f"""o{k} AS (SELECT *, budget - coalesce(sum(cap) FILTER (WHERE full_) OVER ({part}), 0) AS ob,
  sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({part}) AS ow FROM f{k})""",
            f"p{k} AS (SELECT *, CAST(CASE WHEN full_ THEN cap ELSE ob * weight // ow END AS HUGEINT) AS part_ FROM o{k})",
            f"""n{k + 1} AS (SELECT {keys}, CAST(part_ + CASE WHEN NOT full_ AND turn <= ob - open_parts THEN 1 ELSE 0 END AS BIGINT) AS budget FROM (
  SELECT *, sum(CASE WHEN full_ THEN 0 ELSE part_ END) OVER ({part}) AS open_parts,
    sum(CASE WHEN full_ THEN 0 ELSE 1 END) OVER ({part} ORDER BY rn) AS turn FROM p{k}))""",
        ]
    ctes += [
        "plan AS (SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS rest FROM leaf JOIN n3 USING (domain, lang, source))",
        f"""placed AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY CAST('0x' || substr(md5('{seed}-' || whole || '-' || doc_id), 1, 13) AS BIGINT), doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN plan USING (domain, lang, source))""",
    ]
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, domain, lang, source, n_tokens, CAST(whole AS BIGINT) AS epoch FROM placed WHERE upto <= rest"
        "\nUNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, whole)) AS BIGINT) AS epoch FROM placed WHERE whole > 0"
    )


def url_filter(rules: list[tuple[str, str, str]], mass: int, damping: int, rounds: int, share: int) -> str:
    """Rules, then both rankings round by round in whole numbers."""
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    part = lambda i: rf"regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', {i})"
    longest = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    case = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(h, p, v)}'" for h, p, v in longest) + " END"
    link = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
    ctes = [
        f"p AS (SELECT page_id, html, {fold.format(part(1))} AS host, {part(2)} AS path FROM pages)",
        f"r AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said FROM p)",
        f"a AS (SELECT host AS src, {fold.format(f'unnest(regexp_extract_all(html, $${link}$$, 1))')} AS dst FROM p WHERE host <> '')",
        "links AS (SELECT src, dst, count(*) AS w FROM a WHERE src <> dst GROUP BY ALL)",
        "hosts AS (SELECT host FROM p WHERE host <> '' UNION SELECT dst FROM links)",
        r"l AS (SELECT string_split(host, '.') AS l FROM hosts WHERE regexp_matches(host, '^[^.]+\..*\.[^.]*[a-z][^.]*$'))",
        "up AS (SELECT DISTINCT array_to_string(l[i :], '.') AS host, array_to_string(l[i + 1 :], '.') AS above FROM l, unnest(range(1, len(l) - 1)) AS u(i))",
        """e AS (SELECT src, dst, CAST(sum(w) AS BIGINT) AS w FROM (SELECT * FROM links UNION ALL SELECT host, above, 1 FROM up UNION ALL SELECT above, host, 1 FROM up) GROUP BY ALL)""",
        "way AS (SELECT *, sum(w) OVER (PARTITION BY kind, host) AS total FROM (SELECT 'trust' AS kind, src AS host, dst AS goal, w FROM e UNION ALL SELECT 'distrust', dst, src, w FROM e))",
        "n AS (SELECT CASE said WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM r WHERE host <> '' AND said IS NOT NULL GROUP BY ALL)",
        f"s0 AS MATERIALIZED (SELECT kind, host, CAST(CAST({mass} AS HUGEINT) * n // sum(n) OVER (PARTITION BY kind) AS BIGINT) AS score FROM n)",
    ]
    for k in range(1, rounds + 1):
        ctes.append(
            f"s{k} AS MATERIALIZED (SELECT kind, host, CAST(({100 - damping} * sum(seed) + {damping} * sum(inflow)) // 100 AS BIGINT) AS score FROM ("
            f"SELECT kind, host, score AS seed, 0 AS inflow FROM s0 UNION ALL SELECT kind, goal, 0, CAST(score AS HUGEINT) * w // total FROM s{k - 1} JOIN way USING (kind, host)) GROUP BY ALL)"
        )
    ctes.append(f"h AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM s{rounds} GROUP BY host)")
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN 100 * distrust > {share} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust
FROM r LEFT JOIN h ON r.host = h.host"""
    )
