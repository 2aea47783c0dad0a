"""SQL that gives the rows of queries in `queries.py`, where SQL can express their method."""

from __future__ import annotations

from tallywind.llm import licenses

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') AS t
  FROM b, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS u(s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
tried AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS t
  FROM d, lengths, unnest(range(0, len(w) - n + 1)) AS u(s) WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, item_id, s, n FROM tried JOIN windows USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) AS u(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def licenses_sql() -> str:
    """The lists of sentences and rules come from `licenses`; one condition a rule."""
    def clean(x: str) -> str:
        return rf"trim(regexp_replace({_LOWER.format(x)}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"

    pieces = "list_filter([{} FOR x IN regexp_split_to_array({}, '[.!?;:][\\x20\\x09\\x0D]+|\\x0A')], lambda x: x <> '')".format(clean("x"), "{}")
    def canonical(x: str) -> str:
        named = " ".join(f"WHEN regexp_matches({x}, '^{p}$') THEN {_text(licenses._plain(licenses.SENTENCES[n]))}" for n, p in licenses.OPEN_SENTENCES.items())
        return f"CASE {named} ELSE regexp_replace({x}, '{licenses.NOTICE}', 'notice ') END"

    values = ", ".join(f"({_text(name)}, {_text(text)})" for name, text in licenses.SENTENCES.items())
    cases = []
    for rule in licenses.RULES:
        ids = licenses._rule_ids(rule, licenses.SENTENCES)
        steps = [f"ids[j + {k}] = '{name}'" for k, name in enumerate(ids)]
        steps += [f"places[j + {k}] - places[j + {k - 1}] <= 3" for k in range(1, len(ids))]
        cases.append(
            f"CASE WHEN len(list_filter(range(1, len(ids) - {len(ids)} + 2), lambda j: {' AND '.join(steps)})) > 0 THEN '{rule.license}' END"
        )
    return f"""
WITH fixed(name, text) AS (VALUES {values}),
parts AS (SELECT name, {pieces.format('text')} AS p FROM fixed),
known AS (SELECT CASE WHEN k = 1 THEN name ELSE name || '/' || (k - 1) END AS id, {canonical('p[k]')} AS known FROM parts, unnest(range(1, len(p) + 1)) AS u(k)),
d AS (SELECT doc_id, {pieces.format("coalesce(text, '')")} AS p FROM documents),
hits AS (SELECT doc_id, k AS place, id FROM (SELECT doc_id, {canonical('p[k]')} AS known, k FROM d, unnest(range(1, len(p) + 1)) AS u(k)) JOIN known USING (known)),
found AS (SELECT doc_id, list(id ORDER BY place, id) AS ids, list(place ORDER BY place, id) AS places FROM hits GROUP BY doc_id),
judged AS (SELECT d.doc_id, cast(len(p) AS BIGINT) AS n_sentences, coalesce(ids, []) AS ids, coalesce(places, []) AS places FROM d LEFT JOIN found USING (doc_id))
SELECT doc_id, n_sentences, cast(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_sort(list_distinct(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL))), ',') AS licenses
FROM judged
"""


CHAT = r"""
WITH m AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) // 512 AS part FROM m),
parts AS (SELECT DISTINCT conv_id, part FROM n),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
held AS (
  SELECT conv_id, part, 1 AS own_part, turn, role, text FROM n
  UNION ALL SELECT n.conv_id, parts.part, 0, turn, role, text
  FROM n JOIN parts ON n.conv_id IS NOT DISTINCT FROM parts.conv_id AND n.part < parts.part WHERE role = 'system'),
p AS (
  SELECT held.*, speaker, role = speaker AS own,
    row_number() OVER (PARTITION BY held.conv_id, part, speaker ORDER BY own_part, turn NULLS FIRST, role, text) AS place,
    CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user name="' || role || '"|>' || chr(10) END AS head, text || '<|end|>' || chr(10) AS body
  FROM held JOIN speakers ON held.conv_id IS NOT DISTINCT FROM speakers.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM p)
SELECT conv_id, part, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(head || body, '' ORDER BY place) AS text,
  coalesce(string_agg(cast(past + length(head) AS BIGINT) || ':' || cast(past + length(head) + length(body) AS BIGINT), ',' ORDER BY place) FILTER (own), '') AS masks
FROM placed GROUP BY conv_id, part, speaker
"""

_SECOND = "('ac', 'co', 'com', 'edu', 'gob', 'gov', 'net', 'nom', 'or', 'org')"


def _strength(table: str) -> str:
    rate = "(cast(sum(k) AS DOUBLE) / sum(n))"
    own = f"({rate} * (1 - {rate}))"
    squares = f"(sum(cast(k AS DOUBLE) * k / n) - sum(n) * {rate} * {rate})"
    share = f"(({squares} - (count(*) - 1) * {own}) / nullif({own} * (sum(n) - sum(cast(n AS DOUBLE) * n) / sum(n) - (count(*) - 1)), 0))"
    return f"(SELECT coalesce(1 / greatest(0.000999000999000999, least(0.5, {share})) - 1, 1000) FROM {table} WHERE n > 0)"


HOSTS = rf"""
WITH p AS (
  SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id AS page_id, count(*) AS n, sum(cast(quality = 1 AND toxic = 0 AS INT)) AS k FROM labels
  WHERE (quality = 1 AND toxic = 0) IS NOT NULL GROUP BY doc_id),
named AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS k, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS x
  FROM p LEFT JOIN l USING (page_id) GROUP BY host),
cut AS (SELECT *, CASE WHEN len(x) >= 3 AND length(x[-1]) = 2 AND x[-2] IN {_SECOND} THEN 2 ELSE 1 END AS s FROM named),
h AS (SELECT host, n, k, array_to_string(x[greatest(1, len(x) - s + 1) : len(x)], '.') AS suffix,
  array_to_string(x[greatest(1, len(x) - s) : len(x)], '.') AS domain FROM cut),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
m AS (SELECT {_strength('s')} AS s, {_strength('d')} AS d, {_strength('h')} AS h, (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0.5) FROM s) AS everything),
sm AS (SELECT suffix, (m.s * everything + k) / (m.s + n) AS mean FROM s, m),
dm AS (SELECT domain, suffix, (m.d * sm.mean + k) / (m.d + n) AS mean FROM d JOIN sm USING (suffix), m),
post AS (SELECT host, m.h * dm.mean + k AS a, m.h * (1 - dm.mean) + n - k AS b FROM h JOIN dm USING (domain, suffix), m),
bound AS (SELECT host, least(1, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS upper FROM post),
ruled AS (
  SELECT p.*, upper, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p JOIN bound USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_all) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * n_all) // l_all AS m FROM d, s WHERE len(w) > 0),
scores AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(weights.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN weights USING (t) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""


#: Two hexadecimal digits stand for each byte; windows are cut from blocks of 500, as substr walks a text from its start.
REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT r, doc_id, 500 * k AS base, substr(h, 1000 * k + 1, 1098) AS b FROM d, unnest(range(0, (len(h) + 901) // 1000)) AS u(k)),
w AS MATERIALIZED (SELECT r, doc_id, base + p AS p, substr(b, 2 * p + 1, 100) AS s FROM blocks, unnest(range(0, len(b) // 2 - 49)) AS u(p)),
owners AS (SELECT s, min(doc_id) AS owner FROM w GROUP BY s HAVING count(*) > 1),
hits AS (SELECT r, p FROM w JOIN owners USING (s) WHERE doc_id > owner),
islands AS (
  SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS island
  FROM (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hits)),
spans AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM islands GROUP BY r, island),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y, b FROM spans),
kept AS (
  SELECT r, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS head, max(b) AS last, sum(b - y) AS gone, count(*) AS n
  FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


COLLOCATIONS = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM w, (VALUES (1), (2), (3)) AS sizes(k), unnest(range(1, len(w) - k + 2)) AS u(i) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM c, unnest(range(1, c.k)) AS u(cut)
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : cut], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1 :], ' ')),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cuts) WHERE o = 1),
inner_phrases AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT chosen.* FROM chosen LEFT JOIN inner_phrases USING (lang, phrase) WHERE NOT coalesce(100 * most >= 50 * a, false))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000
"""
