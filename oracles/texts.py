"""Oracle queries for documents and messages."""

from __future__ import annotations

from shelfwise.functions import fixed

Q: dict[str, str] = {}


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOP = "[" + quoted(fixed.ENGLISH_STOP_WORDS) + "]"
STRIP = "trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

PARTS = f"""list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'),
    lambda x: {STRIP.format(x='x')}), lambda x: x <> '')"""
CHUNKS = f"""
parts AS (SELECT doc_id, source, {PARTS} AS s FROM documents),
windows AS (SELECT doc_id, source, list_filter(
    list_transform(range(0, len(s), 3), lambda i: array_to_string(s[i + 1 : i + 4], '. ')), lambda w: length(w) > 20) AS w FROM parts),
chunks AS (SELECT doc_id || '_chunk_' || n AS chunk_id, doc_id, source, text
  FROM (SELECT doc_id, source, unnest(w) AS text, unnest(range(0, len(w))) AS n FROM windows))"""
Q["chunk_sentences"] = f"WITH {CHUNKS} SELECT chunk_id, doc_id, source, text FROM chunks"

Q["chunk_chars"] = f"""
WITH cut AS (SELECT doc_id, source, list_filter(list_transform(range(0, length(text), 450),
    lambda i: {STRIP.format(x='substring(text, i + 1, 500)')}), lambda w: w <> '') AS w FROM documents)
SELECT doc_id || '_' || n AS chunk_id, doc_id, source, text
FROM (SELECT doc_id, source, unnest(w) AS text, unnest(range(0, len(w))) AS n FROM cut)"""


def words(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOP}, w))"


def terms(w: str) -> str:
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


Q["tokenize"] = f"""
WITH worded AS (SELECT doc_id, {words('text')} AS w FROM documents)
SELECT doc_id, array_to_string({terms('w')}, '|') AS terms FROM worded"""

INDEX = f"""WITH {CHUNKS},
worded AS (SELECT chunk_id, {words('text')} AS w FROM chunks),
tf AS (SELECT chunk_id, term, COUNT(*) AS tf FROM (SELECT chunk_id, unnest({terms('w')}) AS term FROM worded) GROUP BY 1, 2),
total AS (SELECT COUNT(*) AS n FROM chunks),
vocab AS (SELECT term, CAST(SUM(tf) AS BIGINT) AS "count", COUNT(*) AS df FROM tf GROUP BY term ORDER BY 2 DESC, term LIMIT 8000),
idf AS (SELECT term, "count", df, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM vocab, total),
raw AS (SELECT chunk_id, tf.term, (1 + ln(tf)) * idf AS r FROM tf JOIN idf ON tf.term = idf.term),
norm AS (SELECT chunk_id, sqrt(SUM(r * r)) AS l FROM raw GROUP BY 1),
weights AS (SELECT raw.chunk_id, term, r / l AS weight FROM raw JOIN norm ON raw.chunk_id = norm.chunk_id)"""
Q["vocabulary"] = f"{INDEX} SELECT term, \"count\", df, ROUND(idf, 6) AS idf FROM idf"
Q["tfidf_index"] = f"{INDEX} SELECT chunk_id, term, ROUND(weight, 6) AS weight FROM weights"

SEARCH = INDEX + f""",
qw AS (SELECT item_id AS query_id, {words('text')} AS w FROM benchmark),
qtf AS (SELECT query_id, term, COUNT(*) AS tf FROM (SELECT query_id, unnest({terms('w')}) AS term FROM qw) GROUP BY 1, 2),
qraw AS (SELECT query_id, qtf.term, (1 + ln(tf)) * idf AS r FROM qtf JOIN idf ON qtf.term = idf.term),
qnorm AS (SELECT query_id, sqrt(SUM(r * r)) AS l FROM qraw GROUP BY 1),
qweights AS (SELECT qraw.query_id, term, r / l AS weight FROM qraw JOIN qnorm ON qraw.query_id = qnorm.query_id),
scores AS (SELECT query_id, chunk_id, ROUND(SUM(q.weight * w.weight), 9) AS score
  FROM qweights q JOIN weights w ON q.term = w.term GROUP BY 1, 2),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM scores),
found AS (SELECT query_id, rank, score, r.chunk_id, source, text,
    '[Source: ' || source || ' | Relevance: ' || printf('%.2f', score) || ']' || chr(10) || text AS block
  FROM ranked r JOIN chunks c ON r.chunk_id = c.chunk_id WHERE rank <= 3)"""
SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
Q["search_topk"] = f"{SEARCH} SELECT query_id, rank, chunk_id, ROUND(score, 6) AS score FROM found"
Q["distinct_sources"] = f"""{SEARCH}
SELECT query_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM found GROUP BY query_id"""
Q["build_context"] = f"""{SEARCH}
SELECT item_id AS query_id, COALESCE(context, 'No relevant documents found.') AS context
FROM benchmark LEFT JOIN (SELECT query_id, string_agg(block, {SEP} ORDER BY rank) AS context FROM found GROUP BY 1) f
  ON item_id = query_id"""
Q["tfidf_blocks"] = f"""{INDEX}
SELECT regexp_replace(chunk_id, '[0-9]{{1,2}}$', '') AS block, term, ROUND(MAX(weight), 6) AS top FROM weights GROUP BY 1, 2"""
Q["retrieve_answers"] = f"""{SEARCH},
every AS (SELECT item_id, b.text AS query, c.chunk_id, c.source, c.text, COALESCE(score, 0) AS score
  FROM benchmark b CROSS JOIN chunks c LEFT JOIN scores s ON s.query_id = item_id AND s.chunk_id = c.chunk_id),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank,
  '[Source: ' || source || ' | Relevance: ' || printf('%.2f', score) || ']' || chr(10) || text AS block FROM every)
SELECT item_id AS query_id, query, arg_min(text, rank) AS answer, string_agg(block, {SEP} ORDER BY rank) AS full_context,
       array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, CAST(COUNT(*) AS INT) AS chunk_count
FROM best WHERE rank <= 3 GROUP BY 1, 2"""


def hits(text: str, keywords) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{k}') AS INT)" for k in keywords) + ")"


GOOD = hits("lower(text)", fixed.POSITIVE_WORDS)
BAD = hits("lower(text)", fixed.NEGATIVE_WORDS)
Q["sentiment"] = f"""
WITH judged AS (SELECT doc_id, {GOOD} AS g, {BAD} AS b FROM documents)
SELECT doc_id, CASE WHEN g > b THEN 'positive' WHEN b > g THEN 'negative' ELSE 'neutral' END AS sentiment,
       CAST(CASE WHEN g > b THEN 0.8 WHEN b > g THEN 0.05 ELSE 0.1 END AS DOUBLE) AS positive,
       CAST(CASE WHEN g <> b THEN 0.15 ELSE 0.8 END AS DOUBLE) AS neutral,
       CAST(CASE WHEN g > b THEN 0.05 WHEN b > g THEN 0.8 ELSE 0.1 END AS DOUBLE) AS negative
FROM judged"""

Q["key_phrases"] = f"""
WITH runs AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'),
    lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains([{quoted(fixed.PHRASE_STOP_WORDS)}], w)) AS w FROM documents),
firsts AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i) AS places FROM runs)
SELECT doc_id, array_to_string(list_transform(places[1:8], lambda i: w[i]), ',') AS key_phrases FROM firsts"""

# messages

FORECAST, POLICY, ANALYTICS = (hits("m", fixed.AGENT_KEYWORDS[n]) for n in (fixed.FORECAST, fixed.POLICY, fixed.ANALYTICS))
ACTIONS = list(fixed.ACTION_KEYWORDS.items())


def routed(source: str) -> str:
    """Adds agent and action to a relation that has ``text``."""
    scores = ", ".join(f"{hits('m', words)} AS a{i}" for i, (_, words) in enumerate(ACTIONS))
    best = "greatest(" + ", ".join(f"a{i}" for i in range(10)) + ")"
    pick = " ".join(f"WHEN a{i} = {best} THEN '{name}'" for i, (name, _) in enumerate(ACTIONS))
    return f"""
lowered AS (SELECT *, lower(text) AS m FROM {source}),
scored AS (SELECT *, {FORECAST} AS f, {POLICY} AS p, {ANALYTICS} AS a, {scores} FROM lowered),
routed AS (SELECT *, CASE WHEN f > 0 AND f >= p AND f >= a THEN 'ForecastAgent' WHEN p > 0 AND p >= a THEN 'PolicyAgent'
    ELSE 'AnalyticsAgent' END AS agent, CASE {pick} END AS action FROM scored)"""


def tool_of(tools, fallback) -> str:
    """SQL for the first tool of the row's agent one of whose words occurs in ``m``."""
    def chosen(agent: str) -> str:
        tests = [f"WHEN {' OR '.join(f'contains(m, {quoted([w])})' for w in words)} THEN '{name}'" for name, words in tools[agent].items()]
        return f"CASE {' '.join(tests)} ELSE '{fallback[agent]}' END" if tests else f"'{fallback[agent]}'"

    return f"CASE agent {' '.join(f'WHEN {quoted([a])} THEN {chosen(a)}' for a in tools)} END"


AGENT_TOOL = tool_of(fixed.AGENT_TOOLS, fixed.ANSWERING_FALLBACK)
SESSION_TOOL = tool_of(fixed.SESSION_TOOLS, fixed.FALLBACK_TOOL)

QUESTIONS = """
questions AS (SELECT 'P' || p_partkey AS session_id, p_name AS answer, CASE p_size % 12
  WHEN 0 THEN 'Show me the top ' || p_size || ' products by revenue'
  WHEN 1 THEN 'What is the return policy for a ' || p_name || '?'
  WHEN 2 THEN 'Predict units sold for PROD_' || p_partkey
  WHEN 3 THEN 'Show me anomaly detection results for ' || p_name
  WHEN 4 THEN 'Give the detail of item PROD_' || p_partkey || ' please'
  WHEN 5 THEN 'Revenue by category ' || p_type
  WHEN 6 THEN 'Monthly trend of ' || p_brand
  WHEN 7 THEN 'Which region sells most of ' || p_name
  WHEN 8 THEN 'What are the promotion rules?'
  WHEN 9 THEN 'Which algorithm is the model of demand for PROD_' || p_partkey
  WHEN 10 THEN 'Hello, is ' || p_name || ' any good?'
  WHEN 11 THEN 'Is sku PROD_' || p_partkey || ' in stock at all stores?' END AS text FROM part)"""
ASKED = f"WITH {QUESTIONS}, {routed('questions')}"
TALK = f"WITH {routed('conversations')}"

Q["classify_messages"] = f"{TALK} SELECT conv_id, turn, agent, action FROM routed"
Q["classify_questions"] = f"{ASKED} SELECT session_id, agent, action FROM routed"

TOKENS = "string_split_regex({x}, '\\s+')"
NUMBER = f"TRY_CAST(list_filter({TOKENS.format(x='m')}, lambda w: regexp_full_match(w, '[0-9]+'))[1] AS BIGINT)"
PROD = f"list_filter({TOKENS.format(x='upper(text)')}, lambda w: starts_with(w, 'PROD') AND length(w) >= 6)[1]"
SHORT = f"list_filter({TOKENS.format(x='upper(text)')}, lambda w: starts_with(w, 'P') AND length(w) >= 3)[1]"
Q["select_tool"] = f"""{ASKED}, chosen AS (SELECT *, {AGENT_TOOL} AS tool FROM routed)
SELECT session_id, text, agent, tool, CASE WHEN tool = 'get_top_products' THEN {NUMBER} END AS top_n,
       CASE WHEN tool = 'get_product_detail' THEN {PROD} END AS product_id, CASE WHEN agent = 'PolicyAgent' THEN text END AS query
FROM chosen"""
Q["pick_action"] = f"""{ASKED}
SELECT session_id, text, action, CASE WHEN action = 'pull_top_earners' THEN {NUMBER} END AS top_n,
       CASE WHEN action = 'pull_product_breakdown' THEN {SHORT} END AS product_id,
       CASE WHEN action = 'search_policy_docs' THEN text END AS query FROM routed"""

MESSAGES = TALK + f""", messages AS (SELECT conv_id AS session_id, turn AS position,
  CASE WHEN role = 'assistant' THEN 'agent' ELSE role END AS role, CASE WHEN role = 'assistant' THEN agent ELSE role END AS agent_id,
  text AS content, CASE WHEN role = 'assistant' THEN {SESSION_TOOL} END AS tool_name, CAST(NULL AS VARCHAR) AS tool_result FROM routed)"""
TRAIL = ASKED + f""", chosen AS (SELECT *, {SESSION_TOOL} AS tool FROM routed),
messages AS (
  SELECT session_id, 0 AS position, 'user' AS role, 'user' AS agent_id, text AS content, NULL AS tool_name, NULL AS tool_result FROM chosen
  UNION ALL SELECT session_id, 1, 'agent', agent, 'I will use the ''' || tool || ''' tool to answer your question.', tool, NULL FROM chosen
  UNION ALL SELECT session_id, 2, 'tool', agent, 'Tool ''' || tool || ''' returned result.', NULL, answer FROM chosen
  UNION ALL SELECT session_id, 3, 'agent', agent, answer, NULL, NULL FROM chosen)"""
SUMMARY = """,
agents AS (SELECT session_id, string_agg(agent_id, ',' ORDER BY p) AS agents_involved
  FROM (SELECT session_id, agent_id, MIN(position) AS p FROM messages WHERE agent_id <> 'system' GROUP BY 1, 2) GROUP BY 1),
tools AS (SELECT session_id, string_agg(tool_name, ',' ORDER BY p) AS tools_used, CAST(SUM(n) AS BIGINT) AS tool_calls
  FROM (SELECT session_id, tool_name, MIN(position) AS p, COUNT(*) AS n FROM messages WHERE tool_name <> '' GROUP BY 1, 2) GROUP BY 1),
total AS (SELECT session_id, COUNT(*) AS message_count FROM messages GROUP BY 1)
SELECT t.session_id, COALESCE(agents_involved, '') AS agents_involved, COALESCE(tools_used, '') AS tools_used,
       COALESCE(tool_calls, 0) AS tool_calls, message_count
FROM total t LEFT JOIN agents a ON t.session_id = a.session_id LEFT JOIN tools o ON t.session_id = o.session_id"""
HISTORY = """
SELECT session_id, position, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role,
       CASE WHEN role = 'tool' THEN '[Tool Result] ' || tool_result ELSE content END AS content
FROM messages WHERE role IN ('user', 'agent') OR (role = 'tool' AND tool_result <> '')"""
Q["session_summary"] = MESSAGES + SUMMARY
Q["session_summary_routed"] = TRAIL + SUMMARY
Q["tool_calls"] = MESSAGES + " SELECT session_id, position, tool_name FROM messages WHERE tool_name <> ''"
Q["tool_call_lists"] = MESSAGES + """
SELECT session_id, CAST(position // 1000 AS BIGINT) AS block, string_agg(tool_name, ',' ORDER BY position, tool_name) AS tools
FROM messages WHERE tool_name <> '' GROUP BY 1, 2"""
Q["history_for_llm"] = MESSAGES + HISTORY
Q["history_for_llm_routed"] = TRAIL + HISTORY
