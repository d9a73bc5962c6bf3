"""The registered queries as SQL, written independently of the Spark plans."""

from __future__ import annotations

from ..sample_lexicon import sample_lines
from .catalog import HOSTILE_WORDS, LATER_RULES, LINES_PER_FILE, LOOKUP_TOKEN, LOOKUP_WORD, RULES

_SAMPLE_RAW = "raw(ord, value) AS (VALUES " + ", ".join(
    f"({number}, '{line}')" for number, line in enumerate(sample_lines(), 1)
) + ")"

_KEYED = """parsed AS (
    SELECT ord,
        coalesce(string_split(list_filter(string_split(value, ' '),
            lambda f: contains(f, 'word1'))[-1], '=')[2], '') AS word,
        coalesce(string_split(list_filter(string_split(value, ' '),
            lambda f: contains(f, 'priorpolarity'))[-1], '=')[2], '') AS polarity
    FROM raw)"""

_POSITIONAL = """parsed AS (
    SELECT ord,
        string_split(string_split(value, ' ')[3], '=')[2] AS word,
        string_split(string_split(value, ' ')[6], '=')[2] AS polarity
    FROM raw)"""

_FIRST = """first_lines AS (
    SELECT word, polarity FROM parsed
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY ord) = 1)"""

_LEXICON = "lexicon AS (SELECT word, polarity FROM first_lines WHERE polarity <> '')"

_PART_RAW = """raw(ord, value) AS (
    SELECT p_partkey,
        'type=weaksubj len=1 word1=' || string_split(p_name, ' ')[1] || '-' || p_size
        || ' pos1=adj stemmed1=n'
        || CASE WHEN p_size % 7 = 0 THEN ' m' ELSE '' END
        || CASE WHEN p_size % 5 = 0 THEN '' ELSE ' priorpolarity=' ||
            (['positive', 'negative', 'neutral', 'both'])[p_partkey % 4 + 1] END
    FROM part)"""

_WS = "string_split({}, ' ')"
_NW = "regexp_split_to_array({}, '\\W+')"

_DOCUMENT_LINES = """lines AS (
    SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))"""


def _labels(
    source: str,
    keys: str,
    text: str,
    split: str,
    edges: str,
    parse: str = _KEYED,
    ctes: str = "",
    lexicon: str = "",
) -> str:
    """Common table expressions that end in `labels(keys, score, label)`."""
    tokens = split.format(text)
    if edges == "clean":
        cut = f"""cut AS (
    SELECT {keys}, w, len(w) AS n FROM (
        SELECT {keys}, list_filter({tokens}, lambda t: t <> '') AS w FROM {source}))"""
        single = "WHEN n = 1 THEN coalesce((SELECT polarity FROM lexicon WHERE word = w[1]), 'mixed')"
    else:
        cut = f"""cut AS (
    SELECT {keys}, CASE WHEN len(t) > 1 THEN t[2:len(t) - 1] ELSE [] END AS w, len(t) AS n FROM (
        SELECT {keys}, {tokens} AS t FROM {source}))"""
        single = ""
    on = " AND ".join(f"cut.{k.strip()} = scores.{k.strip()}" for k in keys.split(","))
    cut_keys = ", ".join(f"cut.{k.strip()}" for k in keys.split(","))
    lexicon = lexicon or ",\n".join([_SAMPLE_RAW, parse, _FIRST, _LEXICON])
    return f"""WITH {ctes}{lexicon},
{cut},
scores AS (
    SELECT {keys}, sum(CASE polarity WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END) AS score
    FROM (SELECT {keys}, unnest(w) AS word FROM cut) JOIN lexicon USING (word) GROUP BY {keys}),
labels AS (
    SELECT {cut_keys}, CAST(coalesce(score, 0) AS BIGINT) AS score,
        CASE WHEN n > 1 AND score > 0 THEN 'positive'
            WHEN n > 1 AND score < 0 THEN 'negative'
            {single}
            ELSE 'mixed' END AS label
    FROM cut LEFT JOIN scores ON {on})
"""


_REPORT = """SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct
FROM labels GROUP BY label ORDER BY """

_ALL = "SELECT * FROM labels"

_DOCUMENTS_WS = _labels("documents", "doc_id", "text", _WS, "clean")
_DOCUMENTS_NW = _labels("documents", "doc_id", "text", _NW, "clean")
_LAKE = _labels("documents", "doc_id", "text", _NW, "clean", _POSITIONAL)
_PART_TEXT = "(p_name || ' ' || p_type)"


def _token_counts(table: str, tokens: str) -> str:
    return f"""SELECT token, count(*) AS n FROM (SELECT unnest({tokens}) AS token FROM {table})
GROUP BY token"""


_ROLLED = f"""rolled AS (
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) // {LINES_PER_FILE} + 1 AS file_no,
        (SELECT count(*) FROM documents) // {LINES_PER_FILE} AS finished
    FROM documents)"""

_LANDED = "SELECT CAST(doc_id AS VARCHAR) AS id, text, true AS within_size FROM documents"

_FLAT_TOKENS = "'[' || array_to_string(" + _NW.format("text") + ", ', ') || ']'"

_STREAM_RULES = ", ".join(
    f"({half}, '{value}', '{tag}')"
    for half, rules in enumerate((RULES, LATER_RULES))
    for value, tag in rules.items()
)
_RULE_VALUES = ", ".join(f"('{value}', '{tag}')" for value, tag in RULES.items())

_KEYS = _labels(
    "posts",
    "r",
    "text",
    _NW,
    "clean",
    ctes="""posts AS (SELECT conv_id * 100000 + turn AS r, conv_id, turn, text,
    CASE WHEN conv_id % 7 <> 0 THEN conv_id END AS key FROM conversations),
""",
)

_QUOTED = {word: word.replace("'", "''") for word in HOSTILE_WORDS}
_HOSTILE = ", ".join(f"'{word}'" for word in _QUOTED.values())
_HOSTILE_LEXICON = "lexicon(word, polarity) AS (VALUES " + ", ".join(
    f"('{_QUOTED[word]}', '{polarity}')" for word, polarity in HOSTILE_WORDS.items()
) + ")"
_HOSTILE_TEXT = f"""([{_HOSTILE}][doc_id % {len(HOSTILE_WORDS)} + 1] || ' '
    || [{_HOSTILE}][(doc_id + 1) % {len(HOSTILE_WORDS)} + 1] || ' ' || text)"""
_ALL_WORDS = f"""lexicon AS (
    SELECT word, (['neutral', 'positive', 'negative'])[length(word) % 3 + 1] AS polarity
    FROM (SELECT DISTINCT unnest({_WS.format("text")}) AS word FROM documents) WHERE word <> '')"""

# Pages of a source in order of document; every seventh was lost, which cuts the chain.
_CHAINS = """placed AS (
    SELECT doc_id, source, lag(doc_id) OVER w AS before, lead(doc_id) OVER w AS after,
        count(*) FILTER (doc_id % 7 = 3) OVER w AS lost
    FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)
), chains AS (
    SELECT source AS account, count(*) AS n_pages, CASE WHEN bool_and(after IS NOT NULL) THEN max(after)::VARCHAR END AS missing,
        CASE WHEN bool_and(before IS NOT NULL) THEN min(doc_id)::VARCHAR END AS first_token
    FROM placed WHERE doc_id % 7 <> 3 GROUP BY source, lost
)"""


ORACLE: dict[str, str] = {
    "sentiment_report_ws": _DOCUMENTS_WS + _REPORT + "label",
    "sentiment_report_nw": _DOCUMENTS_NW + _REPORT + "pct DESC, label",
    "sentiment_labels_ws": _DOCUMENTS_WS + _ALL,
    "sentiment_labels_nw": _DOCUMENTS_NW + _ALL,
    "sentiment_labels_broadcast": _DOCUMENTS_WS + _ALL,
    "sentiment_labels_salted": _DOCUMENTS_NW + _ALL,
    "sentiment_ref_ws": _labels("part", "p_partkey", _PART_TEXT, _WS, "as_reference") + _ALL,
    "sentiment_ref_nw": _labels("part", "p_partkey", _PART_TEXT, _NW, "as_reference") + _ALL,
    "sentiment_single_token": _labels("part", "p_partkey", "p_type", _WS, "clean") + _ALL,
    "label_counts": _labels("conversations", "conv_id, turn", "text", _NW, "clean")
    + "SELECT label, count(*) AS n FROM labels GROUP BY label",
    **{
        f"sentiment_keys_{plan}": _KEYS + "SELECT key AS conv_id, score, label FROM labels JOIN posts USING (r)"
        for plan in ("row", "broadcast", "salted")
    },
    "sentiment_large_lexicon": _labels(
        "documents", "doc_id", "text", _WS, "clean", lexicon=_ALL_WORDS
    )
    + _ALL,
    "sentiment_hostile_words": _labels(
        "documents", "doc_id", _HOSTILE_TEXT, _WS, "clean", lexicon=_HOSTILE_LEXICON
    )
    + _ALL,
    "labels_with_text": _KEYS + "SELECT conv_id, turn, text, score, label FROM labels JOIN posts USING (r)",
    "account_rules_report": _labels(
        "documents", "doc_id", "text", _WS, "clean"
    )
    + f"""SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct
FROM labels JOIN documents USING (doc_id)
WHERE 'from:' || source IN (SELECT value FROM (VALUES {_RULE_VALUES}) rules(value, tag))
GROUP BY label ORDER BY label""",
    "page_chains": f"WITH {_CHAINS} SELECT account, first_token, n_pages, missing, false AS ring FROM chains",
    "page_gaps": f"""WITH {_CHAINS}
SELECT account, sum(n_pages)::BIGINT AS n_pages, count(*) AS n_chains,
    count(missing) + CASE WHEN bool_or(first_token IS NULL) THEN 0 ELSE 1 END AS n_gaps,
    min(missing) AS first_gap,
    count(*) = 1 AND count(missing) = 0 AND bool_or(first_token IS NULL) AS complete
FROM chains GROUP BY account""",
    "corrupt_pages": """SELECT count(*) AS n_pages, count(*) FILTER (cut) AS n_corrupt,
    coalesce(sum(lines) FILTER (NOT cut), 0)::BIGINT AS n_posts,
    count(*) FILTER (NOT cut AND last) AS n_last
FROM (SELECT doc_id % 10 = 3 AS cut, len(string_split(text, chr(10))) AS lines,
    doc_id = (SELECT max(doc_id) FROM documents) AS last FROM documents)""",
    "lexicon_keyed": f"WITH {_PART_RAW}, {_KEYED} SELECT word, polarity FROM parsed",
    "lexicon_positional": f"WITH {_PART_RAW}, {_POSITIONAL} SELECT word, polarity FROM parsed",
    "lexicon_dedup": f"WITH {_PART_RAW}, {_KEYED}, {_FIRST} SELECT word, polarity FROM first_lines",
    "lexicon_word": f"""WITH {_PART_RAW}, {_KEYED}, {_FIRST}
SELECT coalesce(max(polarity), '') AS polarity FROM first_lines WHERE word = '{LOOKUP_WORD}'""",
    "word_lookup": f"""SELECT conv_id, turn, count(*) AS n
FROM (SELECT conv_id, turn, unnest({_WS.format("text")}) AS word FROM conversations)
WHERE word = '{LOOKUP_TOKEN}' GROUP BY conv_id, turn""",
    "tokens_ws": _token_counts("documents", _WS.format("text")),
    "tokens_nw": _token_counts("documents", _NW.format("text")),
    "tokens_from_text": _token_counts("conversations", f"string_split({_FLAT_TOKENS}, ', ')"),
    "array_to_text": f"SELECT doc_id, {_FLAT_TOKENS} AS text FROM documents",
    "map_pair": "SELECT p_partkey, p_name AS name, p_type AS type FROM part",
    "json_infer_scan": """SELECT event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, value, props
FROM events""",
    "schema_drift": """WITH e AS (
    SELECT *, event_type = 'purchase' AS later, ts IS NOT NULL AS timed, value IS NOT NULL AS valued FROM events
)
SELECT 'event_id' AS path, 'BIGINT' AS kinds, count(*) AS n_values, false AS conflict FROM e
UNION ALL SELECT 'user_id', 'BIGINT', count(user_id), false FROM e
UNION ALL SELECT 'reading', 'OBJECT', count(*), false FROM e
UNION ALL SELECT 'reading/time', 'STRING', count(ts), false FROM e
UNION ALL SELECT 'reading/value', string_agg(DISTINCT CASE WHEN later THEN 'STRING' ELSE 'DOUBLE' END, ' '
    ORDER BY CASE WHEN later THEN 'STRING' ELSE 'DOUBLE' END), count(value), count(DISTINCT later) > 1 FROM e WHERE valued
UNION ALL SELECT 'tags', 'ARRAY', count(*), false FROM e WHERE later
UNION ALL SELECT 'tags/[]', 'STRING', count(*), false FROM e WHERE later""",
    "flatten_pages": f"WITH {_DOCUMENT_LINES} SELECT doc_id || '-' || i AS id, text FROM lines",
    "union_pages": """SELECT conv_id, turn, text FROM conversations WHERE role = 'user'
UNION ALL BY NAME SELECT turn, conv_id, role, text FROM conversations WHERE role <> 'user'""",
    "page_has_next": """SELECT doc_id, doc_id < (SELECT max(doc_id) FROM documents) AS has_next
FROM documents""",
    "account_report": _labels("lines", "doc_id, i", "text", _WS, "clean", ctes=_DOCUMENT_LINES + ",\n")
    + _REPORT
    + "label",
    "rule_ids": """SELECT c_custkey, unnest([c_custkey || '', c_custkey || '-2']) AS id FROM customer
WHERE c_nationkey % 5 <> 0 AND c_nationkey % 7 <> 0""",
    "match_rules": f"""SELECT doc_id, source, tag FROM documents
JOIN (VALUES {_RULE_VALUES}) rules(value, tag) ON 'from:' || source = value""",
    "match_rules_semi": f"""SELECT doc_id, source FROM documents
WHERE 'from:' || source IN (SELECT value FROM (VALUES {_RULE_VALUES}) rules(value, tag))""",
    "stream_tokens": _token_counts("documents", _NW.format("text")),
    "stream_report": _LAKE + _REPORT + "pct DESC, label",
    "stream_labels": _LAKE + "SELECT CAST(doc_id AS VARCHAR) AS id, score, label FROM labels",
    "stream_labels_report": _LAKE + _REPORT + "pct DESC, label",
    "stream_compacted": f"""SELECT CAST(doc_id AS VARCHAR) AS id, len({_NW.format("text")}) AS n_tokens,
    true AS fewer_files
FROM documents""",
    "stream_running_report": _LAKE + _REPORT + "pct DESC, label",
    "stream_ruled_tokens": f"""SELECT CAST(doc_id AS VARCHAR) AS id, len({_NW.format("text")}) AS n_tokens,
    source AS account, tag
FROM documents JOIN (VALUES {_STREAM_RULES}) rules(half, value, tag)
    ON 'from:' || source = value AND doc_id % 2 = half
WHERE doc_id % 10 <> 3""",
    "stream_rejected": """SELECT doc_id % 2 + 1 AS rules_version, count(*) AS n_lines,
    count(*) FILTER (doc_id % 10 = 3) AS n_rejected
FROM documents GROUP BY doc_id % 2""",
    "stream_landing": _LANDED,
    "sink_row_groups": f"""SELECT CAST(doc_id AS VARCHAR) AS id, len({_NW.format("text")}) AS n_tokens
FROM documents""",
    "roll_files": f"""WITH {_ROLLED}
SELECT file_no, file_no <= finished AS published, count(*) AS n_lines FROM rolled GROUP BY ALL""",
    **dict.fromkeys(
        ("land_lines", "land_files"),
        f"""WITH {_ROLLED}
SELECT file_no, CAST(doc_id AS VARCHAR) AS id, text FROM rolled JOIN documents USING (doc_id)
WHERE file_no <= finished""",
    ),
    "land_chunks": _LANDED,
}
