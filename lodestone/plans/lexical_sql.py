"""DuckDB SQL of the lexical queries: stems of distinct words, their positions, and minimal covers."""

from __future__ import annotations

from ..functions import stemmer
from ..functions.lexical import STOP_WORDS, WebQuery

_STOPS = "'" + "','".join(STOP_WORDS) + "'"


def tokens(table: str = "documents") -> str:
    """CTEs up to ``stems``: (doc_id, lang, pos, word) of a table's texts, stop words left out and counted, and the distinct words' stems."""
    return f"""toks AS MATERIALIZED (SELECT doc_id, lang, pos, word FROM (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM {table})) WHERE word NOT IN ({_STOPS})),
vocab AS (SELECT DISTINCT word FROM toks),
{stemmer.sql("vocab")}"""


TOKENS = tokens()


def covers(query: WebQuery, table: str = "documents") -> str:
    """CTEs up to ``m`` (doc_id, lang, score): rows of a table (doc_id, lang, text) that satisfy the query, by the sum over their minimal covers."""
    items = sorted({item for a in query.alternatives for item in a})
    parts = [tokens(table), f"lx_e AS MATERIALIZED (SELECT doc_id, lang, pos, lexeme, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM toks JOIN stems USING (word) WHERE lexeme IN ({', '.join(repr(w) for w in query.every_word)}))"]
    latest = []
    for k, item in enumerate(items):
        words = item.split()
        begin = "e.pos" if len(words) == 1 else f"e.pos - {len(words) - 1}"
        holds = " AND ".join([f"e.lexeme = '{words[-1]}'"] + [f"EXISTS (SELECT 1 FROM lx_e f WHERE f.doc_id = e.doc_id AND f.pos = e.pos - {len(words) - 1 - j} AND f.lexeme = '{w}')" for j, w in enumerate(words[:-1]) if w != "*"])
        latest.append(f"CASE WHEN {holds} THEN {begin} END AS h{k}")
    parts.append(f"lx_h AS (SELECT doc_id, lang, pos, i, {', '.join(latest)} FROM lx_e e)")
    last = ", ".join(f"coalesce(max(h{k}) OVER w, 0) AS l{k}" for k in range(len(items)))  # an item's occurrences begin in the order that they end
    parts.append(f"lx_l AS (SELECT doc_id, lang, pos, i, {last} FROM lx_h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")
    tight = "greatest(0, " + ", ".join("least(" + ", ".join(f"l{items.index(item)}" for item in a) + ")" for a in query.alternatives) + ")"
    parts.append(f"lx_s AS (SELECT doc_id, lang, pos, i, {tight} AS begin FROM lx_l)")
    parts.append("lx_c AS (SELECT *, coalesce(max(begin) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM lx_s)")
    absent = f"AND c.doc_id NOT IN (SELECT doc_id FROM lx_e WHERE lexeme IN ({', '.join(repr(w) for w in query.absent)}))" if query.absent else ""
    parts.append(f"m AS (SELECT c.doc_id, any_value(c.lang) AS lang, sum(0.1::DOUBLE / (1 + (c.pos - c.begin) - (c.i - b.i))) AS score FROM lx_c c JOIN lx_e b ON b.doc_id = c.doc_id AND b.pos = c.begin WHERE begin > earlier {absent} GROUP BY 1)")
    return ",\n".join(parts)
