"""The queries of ``queries.py`` as DuckDB SQL. Queries left out here have no SQL form."""

from __future__ import annotations

from facetloom import constants as C
from facetloom.checks.queries import GATE, NEAR, SENTIMENTS, SORTED_LABELS, SURE
from facetloom.functions.text import WHITESPACE
from facetloom.palette import CLUSTER_PALETTE, NAMED_COLORS, NOISE_COLOR


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _listed(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


BLANK = " || ".join(["''"] + [f"chr({ord(c)})" for c in WHITESPACE])


def _strip(value: str) -> str:
    return f"trim({value}, {BLANK})"


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def _votes(name: str, labels) -> str:
    """``<name>``: doc_id, label, pos, score, place of the labels each document votes for."""
    return f"""
{name}_words AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
{name}_votes AS (
  SELECT doc_id, ('0x' || substr(md5(term), 1, 2))::INT % {len(labels)} AS pos, count(*) AS c
  FROM {name}_words GROUP BY 1, 2),
{name} AS (
  SELECT doc_id, ({_listed(labels)})[pos + 1] AS label, pos,
         c / (sum(c) OVER (PARTITION BY doc_id))::DOUBLE AS score,
         row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, pos) AS place
  FROM {name}_votes)"""


def _sentiment(label: str) -> str:
    return (
        f"CASE WHEN {label} IS NULL THEN NULL WHEN {label} IN {_in(C.POSITIVE_EMOTIONS)} THEN 'positive'"
        f" WHEN {label} IN {_in(C.NEGATIVE_EMOTIONS)} THEN 'negative' ELSE 'neutral' END"
    )


EMO = _votes("emo", C.EMOTION_LABELS)
SLOTS = ",\n".join(
    f"max(label) FILTER (place = {i}) AS emo{i}_label, max(score) FILTER (place = {i}) AS emo{i}_conf"
    for i in range(1, 6)
)
SLOT_TABLE = f"slots AS (SELECT doc_id, {SLOTS} FROM emo WHERE place <= 5 GROUP BY doc_id)"
SENT = _votes("sent", SENTIMENTS)
SENT_NAME = "CASE label WHEN 'LABEL_0' THEN 'negative' WHEN 'LABEL_1' THEN 'neutral' ELSE 'positive' END"
SCORED = f"""
WITH {EMO}, {SENT}, {SLOT_TABLE},
sentiment AS (SELECT doc_id, {SENT_NAME} AS reddit_sentiment, score AS reddit_conf FROM sent WHERE place = 1),
scored AS (
  SELECT d.doc_id, d.lang, d.source, s.*  EXCLUDE (doc_id),
         s.emo1_label AS top_emotion, s.emo1_conf AS emotion_conf,
         {_sentiment('s.emo1_label')} AS emotion_sentiment, t.reddit_sentiment, t.reddit_conf
  FROM documents d LEFT JOIN slots s USING (doc_id) LEFT JOIN sentiment t USING (doc_id)),
gate AS (
  SELECT *, coalesce(emotion_conf >= {GATE} AND reddit_conf >= {GATE}, false) AS good,
         (emotion_sentiment <> reddit_sentiment)::INT AS masking FROM scored)"""

SEGMENTS = """
seg AS (SELECT o.*, c.c_mktsegment AS cluster FROM orders o JOIN customer c ON o_custkey = c_custkey),
long AS (
  SELECT cluster, 'o_orderpriority' AS feature, o_orderpriority AS value FROM seg
  UNION ALL SELECT cluster, 'o_orderstatus', o_orderstatus FROM seg)"""


def _tests(source: str) -> str:
    """Chi-square and both Cramér's V of a table (cluster, feature, value)."""
    return f"""
cells AS (SELECT feature, cluster, value, count(*) AS n FROM {source}
          WHERE cluster IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
r AS (SELECT feature, cluster, sum(n)::DOUBLE AS rn FROM cells GROUP BY ALL),
c AS (SELECT feature, value, sum(n)::DOUBLE AS cn FROM cells GROUP BY ALL),
t AS (SELECT feature, sum(rn) AS tn, count(*) AS nr FROM r GROUP BY ALL),
k AS (SELECT feature, count(*) AS nc FROM c GROUP BY ALL),
dense AS (
  SELECT r.feature, tn, nr, nc, rn * cn / tn AS e, abs(coalesce(n, 0) - rn * cn / tn) AS gap
  FROM r JOIN c USING (feature) JOIN t USING (feature) JOIN k USING (feature)
  LEFT JOIN cells USING (feature, cluster, value)),
chi AS (
  SELECT feature, any_value(tn) AS n, any_value(nr)::DOUBLE AS nr, any_value(nc)::DOUBLE AS nc,
    sum(CASE WHEN nr = 2 AND nc = 2 THEN (gap - least(0.5::DOUBLE, gap)) ^ 2 ELSE gap ^ 2 END / e) AS chi2
  FROM dense GROUP BY feature),
tests AS (
  SELECT feature, chi2, ((nr - 1) * (nc - 1))::BIGINT AS dof,
    CASE WHEN n > 1 AND room > 0
         THEN sqrt(greatest(0, chi2 / n - (nr - 1) * (nc - 1) / (n - 1)) / room) END AS cramers_v,
    CASE WHEN least(nr, nc) > 1 THEN sqrt(chi2 / n / (least(nr, nc) - 1)) END AS effect
  FROM (SELECT *, least(nr - (nr - 1) ^ 2 / (n - 1), nc - (nc - 1) ^ 2 / (n - 1)) - 1 AS room FROM chi))"""


def _terms(source: str, row: str, pairs: bool = True, min_df: int = 1) -> str:
    """``tfidf``: row, term, weight over the vocabulary of a table (row, text)."""
    grams = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])" if pairs else "w"
    return f"""
bag AS (SELECT {row}, unnest({grams}) AS term
        FROM (SELECT {row}, {TOKENS} AS w FROM {source})),
tf AS (SELECT {row}, term, count(*) AS tf FROM bag GROUP BY ALL),
stats AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM tf GROUP BY term),
vocabulary AS (
  SELECT term, ln((1 + (SELECT count(*) FROM {source})) / (1 + df)::DOUBLE) + 1 AS idf
  FROM stats WHERE df >= {min_df} ORDER BY tf DESC, term LIMIT {C.VOCABULARY_SIZE}),
raw AS (SELECT {row}, term, tf * idf AS w FROM tf JOIN vocabulary USING (term)),
tfidf AS (SELECT {row}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {row})) AS weight FROM raw)"""


def _top_words(group: str, source: str, row: str, top: int) -> str:
    return f"""
sizes AS (SELECT {group}, count(*) AS size FROM {source} GROUP BY ALL),
ranked_words AS (
  SELECT {group}, term, sum(weight) / any_value(size) AS weight,
         row_number() OVER (PARTITION BY {group} ORDER BY sum(weight) / any_value(size) DESC, term)::INT AS rank
  FROM tfidf JOIN {source} USING ({row}) JOIN sizes USING ({group}) GROUP BY {group}, term
  QUALIFY rank <= {top})"""


def _persona_emotions(group: str, source: str, slots: str, row: str, top: int = 8) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT {row}, emo{i}_label AS emotion, emo{i}_conf AS conf FROM {slots}" for i in range(1, 6)
    )
    return f"""
slot_pairs AS ({pairs}),
group_sizes AS (SELECT {group}, count(*) AS size FROM {source} GROUP BY ALL),
means AS (
  SELECT {group}, emotion, sum(conf) / any_value(size) AS avg_conf
  FROM slot_pairs JOIN {source} USING ({row}) JOIN group_sizes USING ({group})
  WHERE emotion IS NOT NULL GROUP BY {group}, emotion),
every_mean AS (
  SELECT {group}, emotion, coalesce(avg_conf, 0) AS avg_conf
  FROM (SELECT {group}, unnest({_listed(SORTED_LABELS)}) AS emotion FROM group_sizes)
  LEFT JOIN means USING ({group}, emotion)),
ranked_emotions AS (
  SELECT {group}, emotion, avg_conf,
         row_number() OVER (PARTITION BY {group} ORDER BY avg_conf DESC, emotion)::INT AS rank
  FROM every_mean QUALIFY rank <= {top})"""


def _rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


_DATE_TEXT = """
CASE o_orderkey % 7 WHEN 0 THEN 'on ' || d WHEN 1 THEN upper(d) WHEN 2 THEN '00' || d
  WHEN 3 THEN ' ' || chr(9) || d || ' ' || chr(10) WHEN 4 THEN '31,February,2004' ELSE d END"""

GENERATION_FLAGS = rf"""
WITH d AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%-d,%B,%Y') AS d FROM orders),
t AS (SELECT o_orderkey, {_strip(_DATE_TEXT)} AS s,
             CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE (o_custkey % 60)::INT END AS age FROM d),
y AS (SELECT o_orderkey, age, CASE WHEN regexp_full_match(s, '[0-9]{{1,2}},\p{{L}}+,[0-9]{{4}}')
             THEN year(try_strptime(s, '%d,%B,%Y'))::INT END AS y FROM t)
SELECT o_orderkey, y AS birth_year, coalesce(y BETWEEN 1997 AND 2012, false)::INT AS born_in_cohort,
       (y - age)::INT AS post_birth_year, coalesce(y - age BETWEEN 1997 AND 2012, false)::INT AS post_in_cohort
FROM y"""

BLOG_LINES = rf"""
WITH content AS (
  SELECT doc_id, '<Blog>' || chr(10) || regexp_replace(text, '\. ([A-Za-z]+)',
    '.' || chr(10) || '<date>\1</date>' || chr(10) || '<post>' || chr(10) || ' \1', 'g') AS s FROM documents),
lines AS (
  SELECT doc_id, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS spot
  FROM (SELECT doc_id, string_split(regexp_replace(s, '\r\n?', chr(10), 'g'), chr(10)) AS parts FROM content)),
dated AS (SELECT *, {_strip('raw')} AS text, contains(raw, '<date>') AS is_date FROM lines),
placed AS (
  SELECT *, sum(is_date::INT) OVER (PARTITION BY doc_id ORDER BY spot) AS post_no,
    last_value(CASE WHEN is_date THEN split_part(list_last(string_split(text, '<date>')), '</date>', 1) END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY spot ROWS UNBOUNDED PRECEDING) AS date
  FROM dated),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, post_no ORDER BY spot) - 1 AS line_no FROM placed)
SELECT doc_id, post_no::INT AS post_no, line_no::INT AS line_no, text, coalesce(date, '') AS date
FROM numbered WHERE text <> '' AND NOT is_date AND NOT starts_with(text, '<')"""

SCALAR_FUNCTIONS = rf"""
SELECT doc_id, {_strip("'  ' || chr(9) || lang || chr(10) || ' '")} AS stripped,
  replace(substring(text, 1, 60), chr(10), ' ') AS preview,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE length(text) END::BIGINT AS embedded,
  least(length(text), {C.EMBED_CHARS})::BIGINT AS clipped,
  CASE WHEN doc_id % 3 = 0 THEN 'nan' ELSE lang END AS scored_as,
  CASE WHEN doc_id % 3 = 0 THEN 'NA' ELSE lang END AS category,
  CASE WHEN doc_id % 3 <> 0 THEN n_chars::DOUBLE END AS number,
  greatest(0::DOUBLE, least(1::DOUBLE, n_chars / 1000::DOUBLE - 0.5::DOUBLE)) AS clamped,
  round_even(n_chars / 8::DOUBLE * 100, 0) / 100 AS rounded,
  CASE WHEN doc_id % 3 = 0 THEN 1 WHEN lang = 'fr' THEN -1 ELSE 0 END::DOUBLE AS sentiment,
  CASE WHEN doc_id % 3 <> 0 THEN 'mixed/neutral' WHEN n_chars / 1000::DOUBLE - 1 > 0.2::DOUBLE THEN 'positive'
       WHEN n_chars / 1000::DOUBLE - 1 < -0.2::DOUBLE THEN 'negative' ELSE 'mixed/neutral' END AS tone,
  CASE WHEN doc_id % 3 = 0 THEN 'negative' WHEN lang = 'fr' THEN 'positive' WHEN lang = 'de' THEN 'neutral' END AS mapped
FROM documents"""

_NAMED = ", ".join(f"({i}, '{name}', '{code}')" for i, (name, code) in enumerate(NAMED_COLORS))


def _hex(code: str, at: int) -> str:
    return f"('0x' || substr({code}, {at}, 2))::INT"


_COLORS = f"""
named(pos, name, code) AS (VALUES {_NAMED}),
placed AS (SELECT *, row_number() OVER (ORDER BY cluster = -1, cluster) - 1 AS spot FROM sizes),
coded AS (SELECT *, CASE WHEN cluster = -1 THEN '{NOISE_COLOR}'
                    ELSE ({_listed(CLUSTER_PALETTE)})[(spot % 20 + 1)::INT] END AS target FROM placed),
legend AS (
  SELECT cluster, count, name AS color_name FROM coded, named
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY
    {' + '.join(f"({_hex('target', a)} - {_hex('code', a)}) ^ 2" for a in (1, 3, 5))}, pos) = 1)"""



def _near(source: str) -> str:
    return f"""
pairs AS (
  SELECT q.vec_id AS query_id, i.label AS persona_id, i.vec_id AS row_id,
    round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 12) AS similarity
  FROM {source} q JOIN {source} i ON i.label = (q.label + 1) % 10),
near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id)::INT AS rank FROM pairs)"""


_NEAR = _near("embeddings")

_NEAREST = f"WITH {_NEAR} SELECT query_id, persona_id, row_id, round(similarity, 6) AS similarity, rank FROM near"

_SLOT_NAMES = [(f"emo{i}_label", f"emo{i}_conf") for i in range(1, 6)]
_SURE_PARTS = ", ".join(
    f"CASE WHEN {c} >= {SURE} THEN '{{\"label\": \"' || {n} || '\", \"confidence\": ' || {c} || '}}' END"
    for n, c in _SLOT_NAMES[:4]
)
_SURE_JSON = f"'[' || concat_ws(', ', {_SURE_PARTS}) || ']'"
_ROUNDED_SLOTS = ", ".join(f"{n}, round({c}, 4) AS {c}" for n, c in _SLOT_NAMES)

HIGH_CONF = f"""
WITH {EMO}, {SLOT_TABLE},
s AS (SELECT d.doc_id, d.lang, {_ROUNDED_SLOTS} FROM documents d LEFT JOIN slots USING (doc_id))
SELECT doc_id, lang, {_SURE_JSON} AS sure,
  {', '.join(f'CASE WHEN {c} >= {SURE} THEN {n} END AS {n}, CASE WHEN {c} >= {SURE} THEN {c} END AS {c}' for n, c in _SLOT_NAMES[:4])},
  emo5_label, emo5_conf FROM s"""


def _member(name: str, quoted: bool, sure: str | None = None) -> str:
    value = f"'\"' || {name} || '\"'" if quoted else f"{name}::VARCHAR"
    member = f"'\"{name}\": ' || coalesce({value}, 'null')"
    return f"CASE WHEN {sure} THEN {member} END" if sure else member


_ATTRIBUTES = ", ".join(
    [_member("row_id", False), _member("persona_id", False), _member("lang", True), _member("job", True)]
    + [
        _member(name, quoted, f"{c} >= {SURE}" if i < 4 else None)
        for i, (n, c) in enumerate(_SLOT_NAMES)
        for name, quoted in ((n, True), (c, False))
    ]
)

PROMPTS = rf"""
WITH {EMO}, {SLOT_TABLE},
written AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
{_near('written')},
held AS (
  SELECT e.vec_id AS row_id, e.label AS persona_id, d.text, d.lang, d.source AS job, {_ROUNDED_SLOTS}
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN slots USING (doc_id)),
members AS (SELECT * FROM held WHERE persona_id > 0),
{_terms('members', 'row_id')},
{_top_words('persona_id', 'members', 'row_id', 6)},
{_persona_emotions('persona_id', 'members', 'members', 'row_id', 5)},
words AS (SELECT persona_id, string_agg(term, ', ' ORDER BY rank) AS words FROM ranked_words GROUP BY 1),
emotions AS (SELECT persona_id, string_agg(emotion, ', ' ORDER BY rank) AS emotions FROM ranked_emotions GROUP BY 1),
attributes AS (
  SELECT row_id, '{{' || concat_ws(', ', {_ATTRIBUTES}) || '}}' AS attributes, {_SURE_JSON} AS sure FROM held),
records AS (
  SELECT n.query_id, n.persona_id, greatest(0, least(1, n.similarity)) AS similarity, n.row_id, a.attributes, a.sure,
    q.text AS asked, greatest(0, least(1, n.similarity)) >= {NEAR} AS used,
    'Persona #' || n.persona_id || ' traits:' || CASE WHEN e.emotions IS NULL THEN ' (no card found)' ELSE
      chr(10) || '- Typical emotions: ' || e.emotions || chr(10) || '- Common words/phrases: ' || w.words
      || chr(10) || '- Overall tone tendency: mixed/neutral' END AS traits
  FROM near n JOIN attributes a USING (row_id) JOIN held q ON q.row_id = n.query_id
  LEFT JOIN emotions e ON e.persona_id = n.persona_id LEFT JOIN words w ON w.persona_id = n.persona_id
  WHERE n.rank = 1)
SELECT query_id, persona_id, round(similarity, 6) AS similarity, row_id AS matched_row_id, used AS used_attributes,
  CASE WHEN used THEN attributes END AS attributes_sent, {_text(C.PROMPT_SYSTEM)} AS system_content,
  concat_ws(chr(10), traits,
    CASE WHEN used THEN {_text(C.PROMPT_SIMILARITY)} || printf('%.2f', similarity) END,
    CASE WHEN used THEN {_text(C.PROMPT_ATTRIBUTES)} || attributes END,
    CASE WHEN used AND sure <> '[]' THEN {_text(C.PROMPT_EMOTIONS)} || sure END)
  || chr(10) || chr(10) || 'Message: ' || {_strip('asked')} || chr(10) || chr(10) || {_text(C.PROMPT_REQUEST)} AS user_content,
  NULL::VARCHAR AS reaction, 'no generator given' AS error
FROM records"""

DENSITY = """
WITH RECURSIVE cells AS (
  SELECT floor(c_acctbal / 250::DOUBLE)::INT AS a, floor(c_nationkey * 2::DOUBLE)::INT AS b, count(*) AS rows
  FROM customer GROUP BY ALL),
links AS (
  SELECT s.a AS sa, s.b AS sb, s.rows, t.a, t.b FROM cells s JOIN cells t
  ON t.a BETWEEN s.a - 1 AND s.a + 1 AND t.b BETWEEN s.b - 1 AND s.b + 1),
dense AS (SELECT a, b FROM links GROUP BY ALL HAVING sum(rows) >= 5),
edges AS (
  SELECT l.* FROM links l JOIN dense USING (a, b) JOIN dense d ON d.a = sa AND d.b = sb),
reach AS (
  SELECT a, b, a AS la, b AS lb FROM dense
  UNION SELECT e.a, e.b, la, lb FROM reach r JOIN edges e ON e.sa = r.a AND e.sb = r.b),
core AS (SELECT a, b, min((la, lb)) AS label FROM reach GROUP BY ALL),
border AS (
  SELECT l.a, l.b, min(label) AS label FROM links l JOIN core c ON c.a = sa AND c.b = sb GROUP BY ALL),
home AS (SELECT a, b, coalesce(c.label, o.label) AS label FROM border o LEFT JOIN core c USING (a, b)),
kept AS (
  SELECT label, row_number() OVER (ORDER BY label) - 1 AS number FROM home JOIN cells USING (a, b)
  GROUP BY label HAVING sum(rows) >= 30)
SELECT c_custkey, coalesce(number, -1)::INT AS cluster FROM customer
LEFT JOIN (home JOIN kept USING (label))
ON a = floor(c_acctbal / 250::DOUBLE)::INT AND b = floor(c_nationkey * 2::DOUBLE)::INT"""

DENSITY_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON list_distance(a.e, b.e) <= 1.15::DOUBLE),
core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 4),
reach AS (
  SELECT a, a AS label FROM core
  UNION SELECT n.b, label FROM reach r JOIN near n ON n.a = r.a JOIN core c ON c.a = n.b),
labels AS (SELECT a, min(label) AS label FROM reach GROUP BY a),
home AS (
  SELECT a, label FROM labels
  UNION ALL SELECT n.a, min(label) FROM near n JOIN labels l ON l.a = n.b
  WHERE n.a NOT IN (SELECT a FROM core) GROUP BY n.a),
kept AS (
  SELECT label, row_number() OVER (ORDER BY label) - 1 AS number FROM home GROUP BY label HAVING count(*) >= 3)
SELECT vec_id, coalesce(number, -1)::INT AS cluster
FROM v LEFT JOIN (home JOIN kept USING (label)) ON a = vec_id"""

CHOOSE_K_SEPARABLE = """
WITH rows AS (
  SELECT c_custkey, n_regionkey AS g, c_acctbal / 10000::DOUBLE AS b
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
sums AS (SELECT g, count(*)::DOUBLE AS n, sum(b) AS s, sum(b * b) AS ss FROM rows GROUP BY g),
far AS (
  SELECT c_custkey, r.g, s.g AS h, n,
    n * b * b + ss - 2 * b * s.s + CASE WHEN r.g = s.g THEN 0 ELSE n * 20000 END AS d
  FROM rows r CROSS JOIN sums s),
scored AS (
  SELECT c_custkey, max(CASE WHEN g = h THEN d / (n - 1) END) AS own, min(CASE WHEN g <> h THEN d / n END) AS other
  FROM far GROUP BY c_custkey)
SELECT c_custkey, min(c_custkey) OVER (PARTITION BY g) AS first_member, 5 AS k,
  (SELECT round(avg((other - own) / greatest(other, own)), 4) FROM scored) AS score
FROM rows"""

_COMPONENTS = """
e AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, avg(x) AS m FROM e GROUP BY i)"""

_PRODUCTS = """
SELECT a.vec_id, round(sum(a.x * a.x), 6) AS norm, round(sum(a.x * b.x), 6) AS next_product
FROM c a LEFT JOIN c b ON b.vec_id = a.vec_id + 1 AND b.i = a.i GROUP BY a.vec_id"""

FEATURE_PARTS = f"""
WITH n AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS length,
    (vec_id - avg(vec_id) OVER ()) / stddev_samp(vec_id) OVER () AS a,
    (label - avg(label) OVER ()) / stddev_samp(label) OVER () AS b, label % 3 AS kind
  FROM embeddings)
SELECT vec_id, 70::INT AS width, round(e[1] / length, 6) AS f0, round(e[64] / length, 6) AS f63,
  round(2 * a / sqrt(a * a + b * b), 6) AS f64, round(2 * b / sqrt(a * a + b * b), 6) AS f65,
  {", ".join(f"round(CASE WHEN kind = {k} THEN 0.5::DOUBLE / sqrt(2) ELSE 0 END, 6) AS f{i}" for i, k in ((66, 2), (67, 0), (68, 1)))},
  round(0.5::DOUBLE / sqrt(2), 6) AS f69
FROM n"""

_FILES = """
files AS (SELECT source || '/' || doc_id AS path FROM documents),
split AS (
  SELECT path, row_number() OVER (ORDER BY path) - 1 AS file_idx,
         CASE WHEN (row_number() OVER (ORDER BY path) - 1) % 20 = 0 THEN 'validation' ELSE 'train' END AS split
  FROM files)"""

ORACLES: dict[str, str] = {
    "generation_flags": GENERATION_FLAGS,
    "blog_lines": BLOG_LINES,
    "carry_forward": """
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_text
FROM conversations""",
    "split_every_20th": f"WITH {_FILES} SELECT path, file_idx, split FROM split",
    "row_range": """
SELECT o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (ORDER BY o_orderkey) AS spot FROM orders) WHERE spot BETWEEN 101 AND 1100""",
    "limit_then_filter": """
SELECT doc_id, quality AS is_genz FROM (SELECT * FROM labels ORDER BY doc_id LIMIT 150) WHERE quality = 1""",
    "column_checks": """
SELECT o_orderstatus AS job, NULL::VARCHAR AS top_emotion, 1 AS cluster, count(*) AS n,
  'o_orderstatus,o_orderpriority' AS categoricals, 'o_custkey,o_orderkey,o_totalprice' AS numerics, 18 AS width
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "scalar_functions": SCALAR_FUNCTIONS,
    "unit_vectors": """
SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 0 ELSE 1 END::DOUBLE AS norm2,
  CASE WHEN vec_id % 10 = 0 THEN 0
       ELSE round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) END::DOUBLE AS cosine
FROM embeddings""",
    "emotion_top5": f"""
WITH {EMO}, {SLOT_TABLE}
SELECT d.doc_id, emo1_label AS top_emotion, {_sentiment('emo1_label')} AS emotion_sentiment,
  {', '.join(f'{n}, round({c}, 6) AS {c}' for n, c in _SLOT_NAMES)}
FROM documents d LEFT JOIN slots USING (doc_id)""",
    "top_emotion": f"""
WITH {EMO} SELECT d.doc_id, label AS top_emotion
FROM documents d LEFT JOIN (SELECT * FROM emo WHERE place = 1) USING (doc_id)""",
    "emotion_sentiment": f"""
WITH {EMO}, best AS (
  SELECT d.lang, {_sentiment('label')} AS emotion_sentiment
  FROM documents d LEFT JOIN (SELECT * FROM emo WHERE place = 1) USING (doc_id))
SELECT lang, emotion_sentiment, n, round(n / (sum(n) OVER (PARTITION BY lang))::DOUBLE, 6) AS share
FROM (SELECT lang, emotion_sentiment, count(*) AS n FROM best GROUP BY ALL)""",
    "lexicon_emotions": f"""
WITH {EMO}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rank FROM emo)
SELECT d.doc_id, max(label) FILTER (rank = 1) AS top_emotion,
  round(max(score) FILTER (rank = 1), 6) AS emotion_conf, max(label) FILTER (rank = 2) AS emo2_label
FROM documents d LEFT JOIN ranked USING (doc_id) GROUP BY d.doc_id""",
    "sentiment_scores": f"""
WITH {SENT} SELECT d.doc_id, CASE WHEN label IS NOT NULL THEN {SENT_NAME} END AS reddit_sentiment,
  round(score, 6) AS reddit_conf
FROM documents d LEFT JOIN (SELECT * FROM sent WHERE place = 1) USING (doc_id)""",
    "confidence_gate_masking": f"""
{SCORED} SELECT doc_id, emotion_sentiment, reddit_sentiment, masking FROM gate WHERE good""",
    "quality_report": f"""
{SCORED} SELECT count(*) AS rows_loaded, count(*) FILTER (good) AS rows_kept,
  count(*) FILTER (NOT good) AS rows_dropped, round(coalesce(avg(masking) FILTER (good), 0), 6) AS masking_rate
FROM gate""",
    "model_scores": """
WITH s AS (
  SELECT doc_id, (length(text) - length(replace(text, 'a', ''))) % 7 = 3 AS refused,
    (length(text) - length(replace(text, 'e', ''))) / (length(text) + 1)::DOUBLE AS joy,
    (length(text) - length(replace(text, 'n', ''))) / (length(text) + 1)::DOUBLE AS fear
  FROM documents)
SELECT doc_id, CASE WHEN refused THEN NULL WHEN joy >= fear THEN 'joy' ELSE 'fear' END AS top_emotion,
  CASE WHEN NOT refused THEN round(greatest(joy, fear), 6) END AS emotion_conf FROM s""",
    "model_embeddings": """
WITH s AS (
  SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS e,
    length(text) - length(replace(text, 'n', '')) AS n, length(text) - length(replace(text, 'z', '')) AS z
  FROM documents),
u AS (
  SELECT doc_id, CASE WHEN z <= 3 THEN [e, n, z]::DOUBLE[] END AS v,
    nullif(sqrt((e * e + n * n + z * z)::DOUBLE), 0) AS norm FROM s)
SELECT doc_id, """ + ", ".join(
        f"round(coalesce(v[{i + 1}] / norm, v[{i + 1}]), 4) AS e{i}" for i in range(3)
    ) + " FROM u",
    "numeric_block": """
WITH raw AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
    CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS given FROM lineitem),
filled AS (SELECT *, coalesce(given, avg(given) OVER ()) AS d FROM raw),
m AS (SELECT avg(l_quantity) AS m0, stddev_samp(l_quantity) AS s0, avg(l_extendedprice) AS m1,
        stddev_samp(l_extendedprice) AS s1, avg(d) AS m2, stddev_samp(d) AS s2 FROM filled),
z AS (SELECT l_orderkey, l_linenumber, (l_quantity - m0) / s0 AS a, (l_extendedprice - m1) / s1 AS b,
        (d - m2) / s2 AS c FROM filled, m),
u AS (SELECT *, sqrt(a * a + b * b + c * c) AS norm FROM z)
SELECT l_orderkey, l_linenumber, round(a / norm, 6) AS n0, round(b / norm, 6) AS n1,
  round(c / norm, 6) AS n2, 0::DOUBLE AS n3 FROM u""",
    "categorical_block": """
WITH t AS (
  SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS p,
    5 + dense_rank() OVER (ORDER BY CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus ELSE 'NA' END) - 1 AS s
  FROM orders)
SELECT o_orderkey, """ + ", ".join(
        f"CASE WHEN p = {i} OR s = {i} THEN round(1 / sqrt(2), 6) ELSE 0 END::DOUBLE AS c{i}"
        for i in range(9)
    ) + " FROM t",
    "cluster_sizes": f"WITH {SEGMENTS} SELECT cluster, count(*) AS count FROM seg GROUP BY ALL",
    "crosstab": f"WITH {SEGMENTS} SELECT cluster, feature, value, count(*) AS n FROM long GROUP BY ALL",
    "chi_square_tests": f"""
WITH {SEGMENTS}, {_tests('''(SELECT * FROM long UNION ALL
  SELECT CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END, 'l_linestatus', l_linestatus FROM lineitem)''')}
SELECT feature, dof, {_rounded('chi2', 'cramers_v', 'effect')} FROM tests""",
    "strongest_associations": f"""
WITH long AS (
  SELECT l_returnflag AS cluster, 'l_linestatus' AS feature, l_linestatus AS value FROM lineitem
  UNION ALL SELECT l_returnflag, 'quantity', l_quantity::VARCHAR FROM lineitem
  UNION ALL SELECT l_returnflag, 'cluster', l_returnflag FROM lineitem), {_tests('long')}
SELECT feature, dof, {_rounded('effect')} FROM tests ORDER BY cramers_v DESC NULLS LAST, feature LIMIT 10""",
    "value_profiles": f"""
WITH {SEGMENTS}, cells AS (SELECT cluster, feature, value, count(*) AS n FROM long GROUP BY ALL),
r AS (SELECT feature, cluster, sum(n) AS rn FROM cells GROUP BY ALL),
v AS (SELECT DISTINCT feature, value FROM cells)
SELECT cluster, feature, value, round_even(coalesce(n, 0) / rn::DOUBLE * 100 * 100, 0) / 100 AS pct
FROM r JOIN v USING (feature) LEFT JOIN cells USING (cluster, feature, value)""",
    "numeric_summary": "SELECT l_returnflag AS cluster, " + ", ".join(
        f"round({f}({c}), 4) AS {c}_{n}"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("median", "median"), ("min", "min"), ("max", "max"))
    ) + " FROM lineitem GROUP BY 1",
    "emotion_wide": f"WITH {EMO} SELECT d.doc_id, " + ", ".join(
        f"round(coalesce(max(score) FILTER (place <= 5 AND label = '{n}'), 0), 6) AS emotion_{n}"
        for n in SORTED_LABELS
    ) + " FROM documents d LEFT JOIN emo USING (doc_id) GROUP BY d.doc_id",
    "persona_emotions": f"""
WITH {EMO}, {SLOT_TABLE}, {_persona_emotions('lang', 'documents', 'slots', 'doc_id')}
SELECT lang, emotion, round(avg_conf, 6) AS avg_conf, rank FROM ranked_emotions""",
    "persona_base": f"""
{SCORED} SELECT lang, count(*) AS size, round(count(*) / (SELECT count(*) FROM scored)::DOUBLE, 6) AS share,
  round(avg(CASE reddit_sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END), 6) AS avg_sentiment_score
FROM scored GROUP BY lang""",
    "most_common": """
WITH c AS (
  SELECT lang, CASE WHEN doc_id % 9 <> 4 THEN source ELSE 'nan' END AS value, count(*) AS count, min(doc_id) AS f
  FROM documents GROUP BY 1, 2)
SELECT lang, value, count, row_number() OVER (PARTITION BY lang ORDER BY count DESC, f)::INT AS rank
FROM c QUALIFY rank <= 5""",
    "term_stats": f"WITH {_terms('documents', 'doc_id')} SELECT term, tf, df FROM stats",
    "tfidf_terms": f"""
WITH {_terms('documents', 'doc_id', min_df=2)} SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf""",
    "persona_top_terms": f"""
WITH {_terms('documents', 'doc_id')}, {_top_words('lang', 'documents', 'doc_id', 12)}
SELECT lang, term, round(weight, 6) AS weight, rank FROM ranked_words""",
    "mutual_information": f"""
WITH {SEGMENTS}, span AS (SELECT min(o_totalprice) AS low, max(o_totalprice) - min(o_totalprice) AS width FROM seg),
every AS (
  SELECT * FROM long UNION ALL SELECT cluster, 'o_totalprice',
    least(floor((o_totalprice - low) * 10::DOUBLE / width), 9)::INT::VARCHAR FROM seg, span),
cells AS (SELECT cluster, feature, value, count(*)::DOUBLE AS n FROM every GROUP BY ALL),
p AS (
  SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, cluster) AS r,
    sum(n) OVER (PARTITION BY feature, value) AS c FROM cells),
scores AS (SELECT feature, sum(n / t * ln(n * t / (r * c))) AS score FROM p GROUP BY feature)
SELECT feature, round(score, 8) AS score, row_number() OVER (ORDER BY score DESC)::INT AS rank FROM scores""",
    "vector_information": """
WITH x AS (
  SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings
  WHERE label IS NOT NULL
), span AS (SELECT i, min(x) AS low, max(x) - min(x) AS width FROM x GROUP BY i
), cells AS (
  SELECT label, i, least(floor((x - low) * 10::DOUBLE / width), 9) AS value, count(*)::DOUBLE AS n
  FROM x JOIN span USING (i) GROUP BY ALL
), p AS (
  SELECT i, n, sum(n) OVER (PARTITION BY i) AS t, sum(n) OVER (PARTITION BY i, label) AS r,
    sum(n) OVER (PARTITION BY i, value) AS c FROM cells
), scores AS (SELECT i, sum(n / t * ln(n * t / (r * c))) AS score FROM p GROUP BY i)
SELECT 'dim_' || i AS feature, round(score, 8) AS score, row_number() OVER (ORDER BY score DESC, i)::INT AS rank
FROM scores QUALIFY rank <= 30""",
    "legend_colors": f"""
WITH sizes AS (SELECT CASE WHEN label = 3 THEN -1 ELSE label END AS cluster, count(*) AS count FROM embeddings GROUP BY 1),
{_COLORS} SELECT cluster, count, color_name FROM legend""",
    "cluster_colors": f"""
WITH sizes AS (SELECT label AS cluster, count(*) AS count FROM embeddings GROUP BY 1),
{_COLORS} SELECT vec_id, label AS cluster, color_name AS cluster_color_name
FROM embeddings JOIN legend ON cluster = label""",
    "nearest_in_persona": f"""
WITH {_NEAR} SELECT query_id, persona_id, row_id, round(greatest(0, least(1, similarity)), 6) AS similarity, rank,
  greatest(0, least(1, similarity)) >= {NEAR} AS used_attributes FROM near WHERE rank = 1""",
    "nearest_three": f"{_NEAREST} WHERE rank <= 3",
    "nearest_in_blocks": f"{_NEAREST} WHERE rank = 1",
    "high_conf_attributes": HIGH_CONF,
    "prompt_records": PROMPTS,
    "csv_table": """
SELECT doc_id, text, lang, '5,May,2004' AS date FROM documents
UNION ALL SELECT doc_id + 9007199254740993, '  lead, "quoted" and trail  ' || chr(9) || chr(10) || ' next line ', '', NULL
FROM documents""",
    "match_edges": """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), asked AS (SELECT 'q' || vec_id AS query_id, CASE WHEN label = 9 THEN 'none' ELSE 'p' || label END AS persona_id, v FROM e
), held AS (SELECT 'r' || lpad(vec_id::VARCHAR, 9, '0') AS row_id, 'p' || label AS persona_id, v FROM e WHERE vec_id % 50 <> 7
), near AS (
  SELECT query_id, row_id, round(list_inner_product(a.v, h.v), 12) AS s FROM asked a JOIN held h USING (persona_id)
), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS k FROM near)
SELECT query_id, persona_id, row_id, round(s, 6) AS similarity FROM asked LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (query_id)""",
    "silhouette_score": """
WITH x AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings
), rows AS (SELECT vec_id, label, sum(v * v) AS q FROM x GROUP BY ALL
), groups AS (SELECT label AS g, count(*) AS n, avg(q) AS q FROM rows GROUP BY label
), centres AS (SELECT label AS g, i, avg(v) AS m FROM (SELECT label, i, v FROM x) GROUP BY ALL
), dots AS (SELECT vec_id, g, sum(v * m) AS d FROM x JOIN centres USING (i) GROUP BY ALL
), far AS (
  SELECT r.vec_id, r.label, g, n, r.q - 2 * d + groups.q AS f FROM rows r JOIN dots USING (vec_id) JOIN groups USING (g)
), each AS (
  SELECT vec_id, any_value(n) FILTER (g = label) AS n, sum(f * n / nullif(n - 1, 0)) FILTER (g = label) AS a, min(f) FILTER (g <> label) AS b
  FROM far GROUP BY vec_id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM each""",
    "published_dataset": f"WITH {_FILES} SELECT path, file_idx, split FROM split WHERE split = 'validation'",
    "persona_index": """
SELECT vec_id AS row_id, label AS persona_id, len(embedding)::INT AS width FROM embeddings WHERE label = 3""",
    "cards_json": f"""
{SCORED}, {_terms('documents', 'doc_id')}, {_top_words('lang', 'documents', 'doc_id', 12)},
{_persona_emotions('lang', 'documents', 'slots', 'doc_id')},
jobs AS (SELECT lang, source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL),
ranked_jobs AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS rank FROM jobs QUALIFY rank <= 5),
base AS (
  SELECT lang, count(*) AS size, count(*) / (SELECT count(*) FROM scored)::DOUBLE AS share,
    avg(CASE reddit_sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END) AS mean
  FROM scored GROUP BY lang)
SELECT lang AS persona_id, size, round(share, 6) AS share, round(mean, 6) AS avg_sentiment_score,
  (SELECT string_agg(term, '|' ORDER BY rank) FROM ranked_words w WHERE w.lang = base.lang) AS top_words,
  (SELECT string_agg(emotion, '|' ORDER BY rank) FROM ranked_emotions e WHERE e.lang = base.lang) AS top_emotions,
  (SELECT string_agg(source, '|' ORDER BY rank) FROM ranked_jobs j WHERE j.lang = base.lang) AS job_top
FROM base""",
    "density_clusters": DENSITY,
    "density_vectors": DENSITY_VECTORS,
    "choose_k_separable": CHOOSE_K_SEPARABLE,
    "kmeans_separable": """
SELECT c_custkey, min(c_custkey) OVER (PARTITION BY n_regionkey) AS first_member
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "pca_products": f"WITH {_COMPONENTS}, c AS (SELECT vec_id, i, x - m AS x FROM e JOIN m USING (i)) {_PRODUCTS}",
    "svd_products": f"WITH {_COMPONENTS}, c AS (SELECT * FROM e) {_PRODUCTS}",
    "feature_parts": FEATURE_PARTS,
    "importance_planted": """
WITH shares AS (
  SELECT count(*) / (SELECT count(*) FROM customer)::DOUBLE AS p
  FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey)
SELECT 'region' AS feature, round(1 - sum(p * p), 1) AS score, 1::INT AS rank FROM shares
UNION ALL SELECT 'constant', 0::DOUBLE, 2::INT UNION ALL SELECT 'balance', 0::DOUBLE, 3::INT""",
}
