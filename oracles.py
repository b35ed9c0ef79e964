"""The same queries in SQL, written independently of the Spark plans."""

from __future__ import annotations

# Written out here, so that a wrong value in the engine does not pass on both sides.
SPELLING_FOLDS = [("re-", "re"), ("co-", "co"), ("non-", "non"), ("&", "and"), (",", "")]
LINE_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
BLANKS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
# The references that the given pages hold; all may lack their semicolon, `amp` comes last.
PAGE_REFERENCES = [("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")]

_WORDS = r"[\p{L}\p{N}_]+"


def _sql(text: str) -> str:
    return text.replace("'", "''")


def _replaced(expr: str, pairs) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, '{_sql(old)}', '{_sql(new)}')"
    return expr


def _normal(expr: str) -> str:
    return _replaced(f"lower({expr})", [*SPELLING_FOLDS, ("-", " ")])


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def _squeeze(expr: str) -> str:
    gap = f"[{BLANKS}]*[{LINE_BREAKS}][{BLANKS}{LINE_BREAKS}]*"
    return _strip(f"regexp_replace({expr}, '{gap}', ' ', 'g')")


def _unescaped(expr: str) -> str:
    for name, char in PAGE_REFERENCES:
        expr = f"regexp_replace({expr}, '&{name};?', '{char}', 'g')"
    return expr


def _visible(expr: str) -> str:
    expr = f"regexp_replace({expr}, '<!--.*?-->', '', 'gs')"
    for tag in ("head", "title", "style", "script"):
        expr = f"regexp_replace({expr}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'gis')"
    return _squeeze(_unescaped(f"regexp_replace({expr}, '</?[a-zA-Z!?][^>]*>', '', 'g')"))


_DOC_WORDS = f"""
words AS (
  SELECT source AS career, doc_id, unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS skill
  FROM documents),
said AS (
  SELECT item_id AS user_id, unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS skill
  FROM benchmark)"""

_CAREER_MODEL = f"""{_DOC_WORDS},
ct AS (SELECT career, skill, count(*) AS tf FROM words GROUP BY ALL),
idf AS (
  SELECT skill, count(*) AS df, log2((SELECT count(DISTINCT career) FROM ct) / count(*)) AS idf
  FROM ct GROUP BY skill HAVING log2((SELECT count(DISTINCT career) FROM ct) / count(*)) > 1e-12),
cw AS (SELECT career, skill, tf * idf AS w FROM ct JOIN idf USING (skill)),
cv AS (SELECT career, skill, w / sqrt(sum(w * w) OVER (PARTITION BY career)) AS w FROM cw),
ut AS (SELECT user_id, skill, count(*) AS tf FROM said GROUP BY ALL),
uw AS (SELECT user_id, skill, tf * idf AS w FROM ut JOIN idf USING (skill)),
uv AS (SELECT user_id, skill, w / sqrt(sum(w * w) OVER (PARTITION BY user_id)) AS w FROM uw),
dots AS (
  SELECT user_id, career, sum(uv.w * cv.w) AS s FROM uv JOIN cv USING (skill) GROUP BY ALL),
pairs AS (
  SELECT user_id, career, round(coalesce(s, 0), 6) AS sim
  FROM (SELECT DISTINCT user_id FROM said) CROSS JOIN (SELECT DISTINCT career FROM ct)
  LEFT JOIN dots USING (user_id, career)),
suggested AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, career) AS rank
  FROM pairs QUALIFY rank <= 5)"""

_DOC_RANK = f"""{_CAREER_MODEL},
wanted AS (SELECT user_id, career FROM suggested),
lt AS (SELECT career, doc_id, skill, count(*) AS tf FROM words GROUP BY ALL)"""

_RANKED = """
SELECT user_id, career, CAST(doc_id AS VARCHAR) AS unique_url, sim,
  row_number() OVER (PARTITION BY user_id, career ORDER BY sim DESC, CAST(doc_id AS VARCHAR)) AS rank
FROM scored QUALIFY rank <= 5"""

_BASKETS = """
lines AS (
  SELECT lower(c_mktsegment) AS career, o_orderkey AS k, o_custkey AS user_id, o_orderdate,
    p_brand AS brand, lower(p_brand) AS item
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey),
basket AS (SELECT DISTINCT career, k, item FROM lines),
sizes AS (SELECT career, count(DISTINCT k) AS n FROM basket GROUP BY career HAVING count(DISTINCT k) > 20)"""

# Itemsets of every size the baskets have, each grown from the set before by a later item.
_SETS = """grown AS (
  SELECT career, k, [item] AS s, item AS last FROM b
  UNION ALL
  SELECT grown.career, grown.k, list_append(s, b.item), b.item
  FROM grown JOIN b ON grown.k = b.k AND b.item > grown.last),
sets AS (SELECT career, s, count(*) AS freq FROM grown GROUP BY ALL)"""

_ITEMSETS = f"""{_BASKETS},
b AS (SELECT * FROM basket WHERE career IN (SELECT career FROM sizes)),
{_SETS},
rounds AS (
  SELECT career, n, r, CAST(ceil(n / pow(2, r)) AS BIGINT) AS floor
  FROM sizes, LATERAL (SELECT unnest(range(1, CAST(ceil(log2(n)) AS BIGINT) + 1)) AS r)),
counted AS (
  SELECT rounds.career, n, r, floor, count(s) AS m FROM rounds
  LEFT JOIN sets ON sets.career = rounds.career AND freq >= floor GROUP BY ALL),
chosen AS (
  SELECT career, n, r, floor FROM counted
  QUALIFY row_number() OVER (PARTITION BY career
    ORDER BY CASE WHEN m >= 300 THEN 0 ELSE 1 END, CASE WHEN m >= 300 THEN r ELSE -r END) = 1),
itemsets AS (
  SELECT sets.career, s, freq, n, r FROM sets JOIN chosen ON sets.career = chosen.career
  AND freq >= floor)"""

_RULES = f"""{_ITEMSETS},
whole AS (SELECT career, s, freq, unnest(s) AS suggested FROM itemsets WHERE len(s) > 1),
heads AS (
  SELECT career, freq, suggested, list_filter(s, lambda x: x <> suggested) AS antecedent
  FROM whole),
rules AS (
  SELECT heads.career, antecedent, suggested, heads.freq / itemsets.freq AS confidence,
    len(antecedent) AS complexity
  FROM heads JOIN itemsets ON heads.career = itemsets.career AND antecedent = itemsets.s
  WHERE heads.freq / itemsets.freq >= 0.1)"""

_LATEST = """
latest AS (
  SELECT user_id, career, arg_max(k, (o_orderdate, k)) AS k FROM lines GROUP BY ALL),
owned AS (
  SELECT user_id, career, list(DISTINCT item) AS skills
  FROM latest JOIN lines USING (user_id, career, k) GROUP BY ALL)"""

_SUGGESTIONS = f"""{_RULES},{_LATEST},
tips AS (
  SELECT user_id, career, suggested, confidence, complexity, antecedent AS used
  FROM owned JOIN rules USING (career)
  WHERE complexity <= 3 AND list_has_all(skills, antecedent) AND NOT list_contains(skills, suggested))"""

_EDGES = f"""{_SUGGESTIONS},
links AS (SELECT user_id, career, suggested, confidence, unnest(used) AS skill FROM tips),
strongest AS (
  SELECT user_id, career, skill, suggested, max(confidence) AS strength FROM links GROUP BY ALL),
strong AS (
  SELECT user_id, career, suggested, sum(strength) AS total FROM strongest
  GROUP BY ALL HAVING round(sum(strength), 9) >= 0.4),
edges AS (
  SELECT user_id, career, skill, suggested, strength, total
  FROM strongest JOIN strong USING (user_id, career, suggested))"""

# Texts with every word in private-use brackets, so a phrase is a plain substring.
_OPEN, _CLOSE, _MARK, _END = "\ue000", "\ue001", "\ue002", "\ue003"


def _bracketed(expr: str) -> str:
    return f"regexp_replace({expr}, '({_WORDS})', '{_OPEN}\\1{_CLOSE}', 'g')"


_LEXICON = f"""
passage AS (
  SELECT item_id, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM benchmark),
mentions AS (
  SELECT item_id * 4294967296 + i AS ord, w[i + 1] AS a, w[i + 2] AS b
  FROM (SELECT item_id, w, unnest(range(len(w))) AS i FROM passage)),
lex AS (
  SELECT phrase, min(ord) AS ord, {_strip(_normal('phrase'))} AS formatted FROM (
    SELECT ord, a AS phrase FROM mentions
    UNION ALL SELECT ord, a || ' ' || b FROM mentions WHERE b IS NOT NULL) GROUP BY phrase),
named AS (
  SELECT formatted, arg_max(phrase, ord) AS skill, min(ord) AS ord FROM lex
  WHERE formatted <> '' GROUP BY formatted)"""


def _found(source: str, keys: str, ignore: str = "") -> str:
    """CTEs ending in found(keys, skill, n) over source(keys, text)."""
    return f"""{_LEXICON},
source AS ({source}),
heard AS (
  SELECT DISTINCT {keys}, unnest(regexp_extract_all({_normal('text')}, '{_WORDS}')) AS word FROM source),
phrase AS (
  SELECT {_bracketed('formatted')} AS p, formatted, ord,
    split_part(formatted, ' ', 1) AS a, split_part(formatted, ' ', -1) AS z FROM named {ignore}),
possible AS (
  SELECT {', '.join(f'h.{k.strip()}' for k in keys.split(','))},
    list(p ORDER BY length(formatted) DESC, ord) AS phrases
  FROM heard h JOIN phrase ON h.word = a JOIN heard g ON g.word = z
    AND {' AND '.join(f'h.{k.strip()} = g.{k.strip()}' for k in keys.split(','))} GROUP BY ALL),
settled AS (
  SELECT {keys}, list_reduce(list_prepend({_bracketed(_normal('text'))}, phrases),
    lambda t, p: CASE WHEN contains(t, p) THEN replace(t, p,
      '{_MARK}' || replace(replace(p, '{_OPEN}', ''), '{_CLOSE}', '') || '{_END}') ELSE t END) AS t
  FROM source JOIN possible USING ({keys})),
marks AS (
  SELECT {keys}, unnest(regexp_extract_all(t, '{_MARK}([^{_END}]*){_END}', 1)) AS formatted
  FROM settled),
found AS (
  SELECT {keys}, skill, count(*) AS n FROM marks JOIN named USING (formatted) GROUP BY ALL)"""


_RESUME_STOP = "WHERE formatted NOT IN ('education', 'publications', 'philosophy')"
_CHATS = "SELECT conv_id, turn, text FROM conversations"

_STATE = """
SELECT user_id, skill FROM (
  SELECT user_id, 'k' || json_extract_string(props, '$.k') AS skill, event_type,
    row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k')
      ORDER BY ts DESC, event_id DESC) AS nth
  FROM events) WHERE nth = 1 AND event_type <> 'error'"""

_ARRIVALS = """
seen AS (
  SELECT regexp_replace(url, '^https?://[^/]+', '') AS unique_url, page_id,
    starts_with(url, 'http://') AS before FROM pages),
fresh AS (
  SELECT unique_url, min(page_id) AS page_id FROM seen
  WHERE NOT before AND unique_url NOT IN (SELECT unique_url FROM seen WHERE before)
  GROUP BY unique_url)"""

_PART_CAREERS = """
counters AS (
  SELECT replace(lower(p_name || ' ' || p_brand), ' ', '+') AS career, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""

_LINES = "SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents"
_TITLE = _strip("regexp_replace(line, '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]', '', 'g')")

_FIELDS = f"""
WITH cut AS (
  SELECT page_id, (regexp_split_to_array(html, '(?i)<li\\b'))[2:] AS p FROM pages),
piece AS (
  SELECT page_id, i - 1 AS pos, p[i] AS piece
  FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM cut)),
link AS (
  SELECT page_id, pos, regexp_extract(piece, '<a\\b[^>]*>', 0, 'is') AS tag,
    regexp_extract(piece, '<a\\b[^>]*>(.*?)</a\\s*>', 1, 'is') AS inside FROM piece),
href AS (
  SELECT *, {_unescaped("regexp_extract(tag, 'href=\"([^\"]*)\"', 1)")} AS href FROM link
  WHERE tag <> '')
SELECT page_id, CAST(pos AS INTEGER) AS pos,
  {_squeeze(_unescaped("regexp_replace(inside, '<[^>]*>', '', 'g')"))} AS title, href,
  regexp_replace(href, '^https?://[^/]+', '') AS unique_url, '' AS location
FROM href"""


_BAG = """
bags AS (
  SELECT {keys}, list_sort(flatten(list(list_transform(range(n), lambda i: skill)))) AS s
  FROM found GROUP BY ALL)"""


def _crawled() -> str:
    source = f"SELECT page_id, {_visible('html')} AS text FROM pages"
    return f"""WITH {_found(source, 'page_id')},{_BAG.format(keys='page_id')}
SELECT regexp_replace(url, '^https?://[^/]+', '') AS unique_url,
  regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS career,
  make_timestamp(page_id * 1000000) AS searched_at, CAST(len(s) AS INTEGER) AS n_skills,
  array_to_string(s, '|') AS skills
FROM bags JOIN pages USING (page_id)
QUALIFY row_number() OVER (PARTITION BY regexp_replace(url, '^https?://[^/]+', '')
  ORDER BY page_id) = 1"""


_COUNTERS = f"""WITH said AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'add_skill' ELSE 'remove_skill' END AS action,
    regexp_extract_all(text, '{_WORDS}') AS w FROM conversations
  WHERE role IN ('user', 'assistant')),
one AS (
  SELECT conv_id, turn, action, w[i] AS spelling, i AS pos
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM said)),
spelled AS (
  SELECT action, {_strip(_normal('spelling'))} AS formatted, spelling, count(*) AS n,
    max((conv_id, turn, pos)) AS latest FROM one GROUP BY ALL)
SELECT action, formatted, lower(arg_max(spelling, latest)) AS skill,
  string_agg(spelling || ':' || n, ',' ORDER BY spelling) AS spellings,
  CAST(sum(n) AS BIGINT) AS n
FROM spelled GROUP BY action, formatted"""


_RANKED_QUERIES = [
    "suggest_careers",
    "saved_model_careers",
    "rank_listings",
    "jaccard_listings",
    "suggest_skills",
    "latest_suggestions",
    "learning_plan",
    "ranked_rules",
    "described_listings",
]


def oracle_sql() -> dict[str, str]:
    queries = _oracles()
    queries["described_listings"] = f"""SELECT r.*, lang AS title, source AS location
        FROM ({queries["rank_listings"]}) r JOIN documents ON unique_url = CAST(doc_id AS VARCHAR)"""
    for name in _RANKED_QUERIES:
        # Spark's row_number is a 32-bit integer.
        queries[name] = f"SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({queries[name]})"
    return queries


def _oracles() -> dict[str, str]:
    return {
        "suggest_careers": f"WITH {_CAREER_MODEL} SELECT user_id, career, sim, rank FROM suggested",
        "saved_model_careers": f"WITH {_CAREER_MODEL} SELECT user_id, career, sim, rank FROM suggested",
        "rule_upsert": f"""WITH RECURSIVE {_RULES}
            SELECT career || '+' || suggested || '["' || array_to_string(antecedent, '","') || '"]' AS rule_id,
              CASE WHEN confidence >= 0.15 THEN round(confidence, 6) ELSE 0.0 END AS confidence
            FROM rules""",
        "locations": """SELECT c_custkey,
              regexp_replace(n_name || ', ' || c_mktsegment, '[0-9]', '', 'g') AS location,
              'http://jobs.example.com/' || c_name AS link
            FROM customer JOIN nation ON c_nationkey = n_nationkey""",
        "career_terms": f"WITH {_CAREER_MODEL} SELECT career, skill, tf FROM ct",
        "skill_idf": f"WITH {_CAREER_MODEL} SELECT skill, df, round(idf, 6) AS idf FROM idf",
        "career_vectors": f"WITH {_CAREER_MODEL} SELECT career, skill, round(w, 6) AS weight FROM cv",
        "rank_listings": f"""WITH {_DOC_RANK},
            n AS (SELECT career, count(DISTINCT doc_id) AS n FROM lt GROUP BY career),
            li AS (
              SELECT career, skill, log2(any_value(n) / count(*)) AS idf FROM lt JOIN n USING (career)
              GROUP BY ALL HAVING log2(any_value(n) / count(*)) > 1e-12),
            lw AS (SELECT career, doc_id, skill, tf * idf AS w FROM lt JOIN li USING (career, skill)),
            lv AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM lw),
            qw AS (
              SELECT user_id, career, skill, tf * idf AS w
              FROM wanted JOIN ut USING (user_id) JOIN li USING (career, skill)),
            qv AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY user_id, career)) AS v FROM qw),
            d AS (
              SELECT user_id, career, doc_id, sum(qv.v * lv.v) AS s
              FROM qv JOIN lv USING (career, skill) GROUP BY ALL),
            scored AS (
              SELECT user_id, career, doc_id, round(coalesce(s, 0), 6) AS sim
              FROM wanted JOIN (SELECT DISTINCT career, doc_id FROM lt) USING (career)
              LEFT JOIN d USING (user_id, career, doc_id)) {_RANKED}""",
        "jaccard_listings": f"""WITH {_DOC_RANK},
            us AS (SELECT user_id, list(skill) AS a FROM ut GROUP BY user_id),
            ls AS (SELECT career, doc_id, list(skill) AS b FROM lt GROUP BY ALL),
            scored AS (
              SELECT user_id, career, doc_id, round(len(list_intersect(a, b)) /
                (len(a) + len(b) - len(list_intersect(a, b))), 6) AS sim
              FROM wanted JOIN us USING (user_id) JOIN ls USING (career)) {_RANKED}""",
        "frequent_itemsets": f"""WITH RECURSIVE {_ITEMSETS}
            SELECT career, array_to_string(s, ',') AS items, freq, n, CAST(r AS INTEGER) AS halvings
            FROM itemsets""",
        "ranked_rules": f"""WITH RECURSIVE {_RULES}, named AS (
              SELECT career, complexity, round(confidence, 3) AS confidence,
                career || '+' || suggested || '["' || array_to_string(antecedent, '","') || '"]' AS rule_id
              FROM rules)
            SELECT rule_id, CAST(complexity AS INTEGER) AS complexity, confidence, row_number() OVER (
              PARTITION BY career ORDER BY complexity DESC, confidence DESC, rule_id) AS rank
            FROM named""",
        "skill_rules": f"""WITH RECURSIVE {_RULES}
            SELECT career, array_to_string(antecedent, ',') AS antecedent, suggested,
              round(confidence, 6) AS confidence, CAST(complexity AS INTEGER) AS complexity,
              career || '+' || suggested || '["' || array_to_string(antecedent, '","') || '"]' AS rule_id
            FROM rules""",
        "suggest_skills": f"""WITH RECURSIVE {_SUGGESTIONS}
            SELECT user_id, career, suggested, round(confidence, 6) AS confidence,
              CAST(complexity AS INTEGER) AS complexity, array_to_string(used, ',') AS used,
              row_number() OVER (PARTITION BY user_id, career
                ORDER BY complexity DESC, confidence DESC, suggested DESC, used DESC) AS rank
            FROM tips""",
        "plan_edges": f"""WITH RECURSIVE {_EDGES}
            SELECT user_id, career, skill, suggested, round(strength, 6) AS strength,
              round(total, 6) AS total,
              round(pow((strength - min(strength) OVER p + 0.2) * 2
                / (max(strength) OVER p - min(strength) OVER p + 0.2), 2), 6) AS width
            FROM edges WINDOW p AS (PARTITION BY user_id, career)""",
        "learning_plan": f"""WITH RECURSIVE {_EDGES},
            plan AS (
              SELECT user_id, career, suggested, total, any_value(n_used) AS n_used FROM edges
              JOIN (SELECT user_id, career, count(DISTINCT skill) AS n_used FROM edges GROUP BY ALL)
              USING (user_id, career) GROUP BY ALL),
            scored AS (SELECT *, total * 5 / n_used + 0.75 AS score FROM plan)
            SELECT user_id, career, suggested, round(total, 6) AS strength, CAST(n_used AS INTEGER) AS n_used,
              round(score, 6) AS score,
              CASE WHEN score >= 4 THEN 'Very Strong' WHEN score >= 3 THEN 'Strong'
                WHEN score >= 2 THEN 'Medium' WHEN score >= 1 THEN 'Weak' ELSE '' END AS tier,
              row_number() OVER (PARTITION BY user_id, career
                ORDER BY round(total, 9) DESC, suggested) AS rank
            FROM scored""",
        "skill_subsets": f"""WITH {_BASKETS}, latest AS (
              SELECT user_id, career, arg_max(k, (o_orderdate, k)) AS k FROM lines GROUP BY ALL),
            own AS (SELECT DISTINCT user_id, brand FROM latest JOIN lines USING (user_id, career, k))
            SELECT user_id, a.brand || ',' || b.brand || ',' || c.brand AS subset
            FROM own a JOIN own b USING (user_id) JOIN own c USING (user_id)
            WHERE a.brand < b.brand AND b.brand < c.brand
            UNION ALL
            SELECT user_id, a.brand || ',' || b.brand FROM own a JOIN own b USING (user_id) WHERE a.brand < b.brand
            UNION ALL
            SELECT user_id, brand FROM own""",
        "known_skills": f"""WITH {_DOC_WORDS}, {_LEXICON}
            SELECT DISTINCT user_id, skill FROM said WHERE skill IN (SELECT phrase FROM lex)""",
        "user_term_counts": f"""WITH {_DOC_WORDS}
            SELECT user_id, skill, count(*) AS tf FROM said GROUP BY ALL""",
        "extract_skills": f"""WITH {_found('SELECT doc_id, text FROM documents', 'doc_id')}
            SELECT doc_id, skill, n FROM found""",
        "resume_skills": f"""WITH {_found(_CHATS, 'conv_id, turn', _RESUME_STOP)}
            SELECT conv_id, turn, skill FROM found""",
        "listings_with_skills": f"""WITH {_found(
                f"SELECT page_id, {_visible('html')} AS text FROM pages", 'page_id')},
            bags AS (
              SELECT page_id, list_sort(flatten(list(list_transform(range(n), lambda i: skill)))) AS s
              FROM found GROUP BY page_id)
            SELECT page_id, url, array_to_string(s, '|') AS skills FROM bags JOIN pages USING (page_id)""",
        "visible_text": f"SELECT page_id, {_visible('html')} AS text FROM pages",
        "listing_fields": _FIELDS,
        "ingest_new_listings": f"WITH {_ARRIVALS} SELECT unique_url, page_id FROM fresh",
        "new_listing_count": f"WITH {_ARRIVALS} SELECT count(*) AS n_new FROM fresh",
        "known_careers": f"WITH {_BASKETS} SELECT DISTINCT career FROM lines",
        "career_listings": f"""WITH {_BASKETS}
            SELECT CAST(k AS VARCHAR) AS unique_url, string_agg(brand, ',' ORDER BY brand) AS skills
            FROM lines WHERE career = 'machinery' GROUP BY k""",
        "career_titles": f"""SELECT DISTINCT * FROM (
              SELECT source AS category, {_TITLE} AS title,
                replace(replace(lower({_TITLE}), ' ', '+'), ',', '') AS career
              FROM ({_LINES})) WHERE career <> ''""",
        "user_skills_state": _STATE,
        "merged_user_skills": f"""WITH {_found(_CHATS, 'conv_id, turn', _RESUME_STOP)}
            SELECT user_id, skill FROM ({_STATE}) UNION SELECT conv_id, skill FROM found""",
        "feedback_counts": _COUNTERS,
        "stream_feedback": _COUNTERS,
        "result_pages": """SELECT s_nationkey AS page_id,
              CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS pos,
              s_name || ' & Co' AS title, 'http://jobs.example.com/rc/' || s_suppkey || '?a=1&b=2' AS href,
              '/rc/' || s_suppkey || '?a=1&b=2' AS unique_url,
              regexp_replace(n_name, '[0-9]', '', 'g') || ',' AS location
            FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
        "stream_career_feedback": f"""SELECT career, count(*) AS n FROM (
            SELECT unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS career FROM conversations) GROUP BY ALL""",
        "merged_career_feedback": f"WITH {_PART_CAREERS} SELECT career, 2 * n AS n FROM counters",
        "decoded_references": "SELECT doc_id, text FROM documents",
        "merged_feedback": _COUNTERS,
        "ingest_pages": _crawled(),
        "stream_ingest": _crawled(),
        "reextracted_listings": f"""WITH {_found('SELECT doc_id, text FROM documents', 'doc_id')},
            {_BAG.format(keys='doc_id')}
            SELECT source AS career, CAST(doc_id AS VARCHAR) AS unique_url,
              CAST(len(s) AS INTEGER) AS n_skills, sha256(array_to_string(s, '|')) AS skills_sha
            FROM bags JOIN documents USING (doc_id)""",
        "latest_suggestions": f"""WITH RECURSIVE {_SUGGESTIONS}
            SELECT user_id, career, suggested, row_number() OVER (PARTITION BY user_id, career
              ORDER BY complexity DESC, confidence DESC, suggested DESC, used DESC) AS rank
            FROM tips QUALIFY rank <= 5""",
        "career_feedback": f"WITH {_PART_CAREERS} SELECT career, n FROM counters",
        "promote_careers": f"""WITH {_PART_CAREERS}
            SELECT career, n FROM counters WHERE n >= 3 AND career NOT IN (
              SELECT replace(lower(p_name || ' ' || p_brand), ' ', '+') FROM part
              WHERE p_type = 'STANDARD')""",
        "career_display": r"""WITH keys AS (
              SELECT DISTINCT replace(lower(p_name), ' ', '+') || '/' || lower(p_type) || '&'
                || lower(p_brand) AS career FROM part)
            SELECT career, array_to_string(list_transform(
              regexp_extract_all(replace(career, '+', ' '), '\p{L}+|[^\p{L}]+'),
              lambda r: upper(r[1]) || lower(r[2:])), '') AS display FROM keys""",
        "formatted_skills": f"""SELECT DISTINCT line AS skill, {_strip(_normal('line'))} AS formatted
            FROM ({_LINES})""",
        "typeahead": """WITH kinds AS (SELECT DISTINCT p_type FROM part),
            typed AS (
              SELECT left(p_type, n) AS term
              FROM (SELECT p_type, unnest(range(1, length(p_type) + 1)) AS n FROM kinds))
            SELECT DISTINCT term, p_name AS entry FROM typed JOIN part
            ON contains(lower(p_name), lower(term)) WHERE length(term) >= 2""",
        "known_requests": """SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS career FROM part
            WHERE lower(split_part(p_name, ' ', 1)) IN (SELECT lower(p_type) FROM part)""",
        "unknown_requests": """SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS career FROM part
            WHERE lower(split_part(p_name, ' ', 1)) NOT IN (SELECT lower(p_type) FROM part)""",
        "url_extension": r"""SELECT page_id, lower(regexp_extract(url, '\.([^.]*)$', 1)) AS extension,
            lower(regexp_extract(url, '\.([^.]*)$', 1)) IN ('html', 'pdf') AS allowed FROM pages""",
    }
