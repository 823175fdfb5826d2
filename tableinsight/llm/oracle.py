"""Queries of this package in plain SQL, where SQL can express them; for another engine."""

from __future__ import annotations

from tableinsight.llm import decontaminate, importance, licenses, line_runs, secrets, source_mix, url_filter
from tableinsight.llm.common import LOWER, UPPER

_LOWERED = f"translate({{}}, '{UPPER}', '{LOWER}')"
_SPACE = " || ".join(f"chr({ord(c)})" for c in line_runs.SPACE)

LINES = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, i, l[i] AS line, {_LOWERED.format(f"trim(l[i], {_SPACE})")} AS k
          FROM split, unnest(range(1, len(l) + 1)) t(i)),
common AS (SELECT k, max(doc_id) AS owner FROM lines WHERE length(k) >= {line_runs.LEAST_CHARS}
           GROUP BY k HAVING count(DISTINCT doc_id) >= {line_runs.LEAST_DOCS}),
marked AS (SELECT lines.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM lines LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

PASSAGES = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format(_LOWERED.format("coalesce(text, '')"))} AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format(_LOWERED.format("coalesce(text, '')"))} AS w FROM benchmark),
phrases AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), {decontaminate.PHRASE_WORDS}) AS n,
              array_to_string(w[i : i + {decontaminate.PHRASE_WORDS - 1}], ' ') AS g
            FROM items, unnest(range(1, greatest(len(w) - {decontaminate.PHRASE_WORDS - 1}, 1) + 1)) t(i)
            WHERE len(w) > 0),
places AS (SELECT doc_id, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS g
           FROM docs, (SELECT DISTINCT n FROM phrases) s, unnest(range(1, len(w) - s.n + 2)) t(i)),
hits AS (SELECT doc_id, i, places.n, item FROM places JOIN phrases ON places.g = phrases.g AND places.n = phrases.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names
          FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

_SEED = source_mix.SEED
MIX = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)
                 AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sources),
capped AS (SELECT *, ({list(source_mix.WEIGHTS)})[(sid - 1) % {len(source_mix.WEIGHTS)} + 1] AS weight,
             {source_mix.CAP} * source_size AS most FROM weighed),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER earlier, 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level FROM capped
           WINDOW earlier AS (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT first(level ORDER BY most / weight, sid) AS level FROM levels WHERE most / weight >= level),
totals AS (SELECT sum(source_size) AS t, count(*) AS s FROM sources),
blocks AS (SELECT t, CAST(least(t, greatest(ceil(t / {source_mix.BLOCK_WORDS}),
             {source_mix.LEAST_BLOCKS_PER_SOURCE} * s)) AS BIGINT) AS b FROM totals),
targets AS (SELECT sid, source, source_size, least(CAST(most AS DOUBLE), (SELECT level FROM water) * weight) AS target
            FROM levels),
bids AS (SELECT sid, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, sid, k) AS place
         FROM targets, unnest(range(0, (SELECT b FROM blocks))) u(k) WHERE target > 0),
seats AS (SELECT sid, count(*) AS n FROM bids WHERE place <= (SELECT b FROM blocks) GROUP BY sid),
planned AS (SELECT targets.*, coalesce(n, 0) AS seats,
              greatest(1, least(CAST(ceil(source_size / {source_mix.SHARD_WORDS}) AS BIGINT), {source_mix.MOST_SHARDS}))
                AS shards FROM targets LEFT JOIN seats USING (sid)),
placed AS (SELECT doc_id, size, sid, source_size, target, seats,
             CAST('0x' || substr(md5('{_SEED}|' || doc_id), 1, 8) AS BIGINT) % shards AS shard
           FROM sized JOIN planned ON sized.source IS NOT DISTINCT FROM planned.source),
cells AS (SELECT sid, shard, any_value(seats) AS seats, CAST(sum(size) AS BIGINT) AS shard_size
          FROM placed GROUP BY sid, shard),
shard_bids AS (SELECT sid, shard, seats, row_number() OVER (
                 PARTITION BY sid ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS place
               FROM cells, unnest(range(0, seats)) u(k) WHERE shard_size > 0),
quotas AS (SELECT sid, shard, count(*) AS quota FROM shard_bids WHERE place <= seats GROUP BY sid, shard),
wanted AS (SELECT sid, shard, shard_size, least(CAST(round(coalesce(quota, 0) * (SELECT t / b FROM blocks)) AS BIGINT),
             {source_mix.CAP} * shard_size) AS words FROM cells LEFT JOIN quotas USING (sid, shard)),
passes AS (SELECT sid, shard, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS whole,
             CASE WHEN shard_size > 0 THEN words % shard_size ELSE 0 END AS rest FROM wanted),
ordered AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sid, shard
              ORDER BY md5('{_SEED}|order|' || doc_id), doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken
FROM ordered JOIN passes USING (sid, shard)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(name: str, pattern: str) -> str:
    """Start, end and text of every match: pieces and matches alternate."""
    return f"""{name} AS (
  SELECT doc_id, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1],
           lambda x: length(x))), 0) AS a, m[i] AS found
  FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(pattern)}) AS m, string_split_regex(text, {_quoted(pattern)}) AS p
        FROM docs), unnest(range(1, len(m) + 1)) t(i))"""


def _secrets() -> str:
    parts, spans = [], []
    for rank, (kind, pattern, group, least) in enumerate(secrets.BASE_KINDS):
        scan = pattern[:-1] + "{%d,}" % least if kind == "hex" else pattern
        parts.append(_matches(kind, scan))
        value = f"regexp_extract(found, {_quoted(pattern)}, {group})" if group else "found"
        spans.append(
            f"SELECT doc_id, a AS s, {rank} AS r, '{kind}' AS kind, a + length(found) AS e FROM {kind} "
            f"WHERE length({value}) >= {least}"
        )
    allowed = " OR ".join(f"regexp_matches(found, {_quoted(p.replace('*+', '*'))})" for p in secrets.ALLOWED)
    w = secrets.WINDOW
    (hex_kind, looks, _, hex_bits), (key_kind, _, _, key_bits) = secrets.CLASSES
    parts.append(_matches("candidates", secrets.CANDIDATE))
    parts.append(f"""windows AS (
  SELECT doc_id, a, is_hex, i, list_aggregate(string_split(substr(c, i, {w}), ''), 'entropy') AS bits
  FROM (SELECT doc_id, a, regexp_matches(found, {_quoted(looks)}) AS is_hex,
               CASE WHEN regexp_matches(found, {_quoted(looks)}) THEN lower(found) ELSE found END AS c
        FROM candidates WHERE NOT ({allowed})), unnest(range(1, length(c) - {w - 2})) t(i))""")
    base = len(secrets.BASE_KINDS)
    spans.append(
        f"SELECT doc_id, a + min(i) - 1 AS s, CASE WHEN is_hex THEN {base} ELSE {base + 1} END AS r, "
        f"CASE WHEN is_hex THEN '{hex_kind}' ELSE '{key_kind}' END AS kind, a + max(i) - 1 + {w} AS e "
        f"FROM windows WHERE bits >= CASE WHEN is_hex THEN {hex_bits} ELSE {key_bits} END GROUP BY doc_id, a, is_hex"
    )
    named = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, r)"
    counts = ", ".join(
        f"count(s) FILTER (r = {rank}) AS n_{kind}" for rank, (kind, *_) in enumerate(secrets.BASE_KINDS)
    )
    return (
        "WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), " + ", ".join(parts)
        + ", spans AS (" + " UNION ALL ".join(spans) + f") SELECT doc_id, {counts}, "
        f"sha256(coalesce({named} FILTER (r < {base}), '')) AS base_sha256, coalesce({named}, '') AS spans "
        "FROM docs LEFT JOIN spans USING (doc_id) GROUP BY doc_id"
    )


def _urls() -> str:
    """Rules as a CASE from the longest, then Witten-Bell models order by order."""
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [
        (f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v) for h, p, v in rules
    ]
    rule = " ".join(f"WHEN {test} THEN '{name}'" for test, name, _ in fits)
    known = " ".join(f"WHEN {test} THEN '{verdict}'" for test, _, verdict in fits)
    pad, last = url_filter._START, url_filter._END
    n, micro = url_filter.ORDER, url_filter._MICRO
    parts = []
    for k in range(1, n + 1):
        shorter = f"1.0 / {url_filter.SYMBOLS}" if k == 1 else "m.p"
        join = "" if k == 1 else f" JOIN m{k - 1} m ON m.g = right(o.g, {k - 1}) AND m.kind = o.kind"
        parts.append(f"""o{k} AS (SELECT right(gram, {k}) AS g, kind, CAST(sum(c) AS DOUBLE) AS c FROM counts GROUP BY 1, 2),
c{k} AS (SELECT left(g, {k - 1}) AS context, kind, sum(c) AS total, count(*) FILTER (c > 0) AS kinds
        FROM o{k} GROUP BY 1, 2),
m{k} AS (SELECT o.g, o.kind, CASE WHEN total > 0 THEN (o.c + kinds * {shorter}) / (total + kinds) ELSE {shorter} END AS p
        FROM o{k} o JOIN c{k} c ON c.context = left(o.g, {k - 1}) AND c.kind = o.kind{join})""")
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
               THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_LOWERED.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {known} END AS known, '{pad}' || regexp_replace(translate(
            {_LOWERED.format("host || path")}, '123456789', '000000000'), '[^a-z0/.\\-]', '~', 'g') || '{last}' AS s FROM parts),
strings AS (SELECT s, known, count(*) AS n FROM ruled GROUP BY s, known),
grams AS (SELECT s, known, n, substr(s, i, {n}) AS gram FROM strings, unnest(range(1, length(s) - {n - 2})) t(i)),
counts AS (SELECT gram, kind, sum(CASE WHEN known = kind THEN n ELSE 0 END) AS c
           FROM grams, (VALUES ('allow'), ('block')) v(kind) GROUP BY gram, kind),
{", ".join(parts)},
ratios AS (SELECT a.g AS gram, CAST(round((ln(a.p) - ln(b.p)) * {micro}) AS BIGINT) AS micro
           FROM m{n} a JOIN m{n} b ON a.g = b.g WHERE a.kind = 'allow' AND b.kind = 'block'),
scored AS (SELECT s, known, n, CASE WHEN s = '{pad + last}' THEN 0.0
             ELSE sum(micro) / CAST(length(s) - {n - 1} AS DOUBLE) / {micro} END AS score
           FROM grams JOIN ratios USING (gram) GROUP BY s, known, n),
moments AS (SELECT known, CAST(sum(n) AS DOUBLE) AS n, sum(n * score) / sum(n) AS mean,
              sum(n * score * score) / sum(n) AS square FROM scored WHERE known IS NOT NULL GROUP BY known),
cutoff AS (SELECT CASE WHEN y.mean > b.mean THEN (y.mean + b.mean) / 2
             + (y.n * greatest(y.square - y.mean ** 2, 0) + b.n * greatest(b.square - b.mean ** 2, 0)) / (y.n + b.n)
               / (y.mean - b.mean) * ln(b.n / y.n) ELSE 0 END AS t
           FROM moments y JOIN moments b ON y.known = 'allow' AND b.known = 'block')
SELECT page_id, host, path, rule,
       coalesce(ruled.known, CASE WHEN score >= round(coalesce((SELECT t FROM cutoff), 0), 6) THEN 'allow' ELSE 'block' END)
         AS verdict
FROM ruled LEFT JOIN scored ON ruled.known IS NULL AND scored.known IS NULL AND ruled.s = scored.s"""


def _importance() -> str:
    """CRC-32 byte by byte over a table of its remainders, each distinct run of words once."""
    return rf"""
WITH entries AS (SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda a, i:
                   CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(b)),
bytes AS (SELECT list(c ORDER BY b) AS crcs FROM entries),
docs AS (SELECT doc_id, {_WORDS.format(_LOWERED.format("coalesce(text, '')"))} AS w FROM documents),
items AS (SELECT {_WORDS.format(_LOWERED.format("coalesce(text, '')"))} AS w FROM benchmark),
runs AS (SELECT doc_id, array_to_string(w[i : i + n - 1], ' ') AS g FROM docs,
           unnest({list(range(1, importance.MOST_WORDS + 1))}) s(n), unnest(range(1, len(w) - n + 2)) u(i)),
wanted AS (SELECT array_to_string(w[i : i + n - 1], ' ') AS g FROM items,
           unnest({list(range(1, importance.MOST_WORDS + 1))}) s(n), unnest(range(1, len(w) - n + 2)) u(i)),
counted AS (SELECT doc_id, g, count(*) AS n FROM runs GROUP BY ALL),
target AS (SELECT g, count(*) AS n FROM wanted GROUP BY g),
spelt AS (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM counted UNION SELECT g FROM target) t),
sums AS (SELECT g, xor(list_reduce(list_prepend(4294967295,
             list_transform(range(1, length(h), 2), lambda i: CAST('0x' || h[i : i + 1] AS BIGINT))),
           lambda a, x: xor(crcs[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) % {importance.BUCKETS} AS bucket FROM spelt, bytes),
s AS (SELECT bucket, sum(n) AS s FROM counted JOIN sums USING (g) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM target JOIN sums USING (g) GROUP BY bucket),
totals AS (SELECT CAST((SELECT coalesce(sum(s), 0) FROM s) + {importance.BUCKETS} AS DOUBLE) AS all_s,
             CAST((SELECT coalesce(sum(t), 0) FROM t) + {importance.BUCKETS} AS DOUBLE) AS all_t),
gains AS (SELECT bucket, CAST(floor(1000 * ln(
            CAST(coalesce(t, 0) + 1 AS DOUBLE) * all_s / (CAST(s + 1 AS DOUBLE) * all_t))) AS BIGINT) AS gain
          FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight
            FROM counted JOIN sums USING (g) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
             CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(
             (CAST('0x' || substr(sha256('{importance.SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
           FROM docs LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
           FROM scored WHERE n_words >= {importance.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {importance.PERCENT} * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)"""


def _licences() -> str:
    """Runs of words met as texts, voted on by diagonal, neighbouring diagonals merged."""
    rows = ", ".join(
        f"({i}, '{t.label}', {t.phrase}, {t.run}, string_split('{t.words}', ' '))" for i, t in enumerate(licenses.TEMPLATES)
    )
    return f"""
WITH docs AS (SELECT doc_id, {_WORDS.format(_LOWERED.format("coalesce(text, '')"))} AS w FROM documents),
templates(t, label, phrase, k, tw) AS (VALUES {rows}),
places AS (SELECT t, k, i - 1 AS tp, array_to_string(tw[i : i + k - 1], ' ') AS g
           FROM templates, unnest(range(1, len(tw) - k + 2)) u(i)),
runs AS (SELECT doc_id, s.k, i - 1 AS p, array_to_string(w[i : i + s.k - 1], ' ') AS g
         FROM docs, (SELECT DISTINCT k FROM templates) s, unnest(range(1, len(w) - s.k + 2)) u(i)),
hits AS (SELECT doc_id, t, p, tp, p - tp AS diagonal FROM runs JOIN places ON runs.g = places.g AND runs.k = places.k),
diagonals AS (SELECT doc_id, t, diagonal, any_value(phrase) AS phrase FROM hits JOIN templates USING (t) GROUP BY ALL),
steps AS (SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER line > {licenses.SLACK}, true) THEN 1
            ELSE 0 END AS fresh FROM diagonals WINDOW line AS (PARTITION BY doc_id, t ORDER BY diagonal)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM steps),
spans AS (SELECT doc_id, t, span, min(p) AS a, count(DISTINCT tp) AS held
          FROM hits JOIN numbered USING (doc_id, t, diagonal) GROUP BY ALL),
verified AS (SELECT doc_id, label, phrase, a, CAST(held AS DOUBLE) / (len(tw) - k + 1) AS share
             FROM spans JOIN templates USING (t)
             WHERE CAST(held AS DOUBLE) / (len(tw) - k + 1) >= CASE WHEN phrase THEN 1.0 ELSE {licenses.COVER} END)
SELECT doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(a) FILTER (phrase) AS n_base,
       min(a) FILTER (phrase) AS first_word, max(a) FILTER (phrase) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score
FROM docs LEFT JOIN verified USING (doc_id) GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": LINES, "op4_source_mix": MIX, "op7_secrets": _secrets(), "op9_decontaminate": PASSAGES,
        "op10_url_filter": _urls(), "op11_importance": _importance(), "op13_licenses": _licences(),
    }
