"""DuckDB SQL for the queries that SQL can say."""

from __future__ import annotations

from . import chat, licenses, mixing, quality_rules

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_quoted(x) for x in xs) + "]"


def _canonical(x: str) -> str:
    """DuckDB expression of licenses.canonical."""
    t = f"coalesce({x}, '')"
    for word in licenses.PROSE:
        t = f"replace({t}, 'Copyright {word}', 'copyright {word}')"
    t = f"lower(regexp_replace({t}, {_quoted(licenses.COPYRIGHT_LINE)}, '', 'g'))"
    t = f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    t = f"' ' || replace({t}, ' ', '  ') || ' '"
    for wrong, right in licenses.SPELLINGS.items():
        t = f"replace({t}, {_quoted(' ' + wrong.replace(' ', '  ') + ' ')}, {_quoted(' ' + right.replace(' ', '  ') + ' ')})"
    return f"trim(replace({t}, '  ', ' '))"


def license_scan() -> str:
    texts = ", ".join(f"({_quoted(t)}, {_quoted(k)}, false)" for k, t in licenses.TEXTS.items())
    texts += "".join(f", ({_quoted(t)}, {_quoted(k)}, true)" for k, ts in licenses.NOTICES.items() for t in ts)
    return f"""
    WITH known AS (
      SELECT sha256({_canonical('t')}) AS digest, notice, min(k) AS license_id FROM (VALUES {texts}) v(t, k, notice) GROUP BY 1, 2),
    form AS (SELECT doc_id, {_canonical('text')} AS form FROM documents),
    lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    noticed AS (
      SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
      FROM lines JOIN known ON notice AND sha256({_canonical('line')}) = digest
      WHERE regexp_matches(lower(line), {_quoted(licenses.NOTICE_HEAD)}) GROUP BY 1)
    SELECT f.doc_id, sha256(form) AS canonical_sha256, length(form)::BIGINT AS canonical_chars,
           CASE WHEN length(form) > 0 THEN k.license_id END AS license_id, coalesce(n.ids, '') AS notice_ids
    FROM form f LEFT JOIN known k ON NOT k.notice AND k.digest = sha256(form) LEFT JOIN noticed n USING (doc_id)
    """


def quality() -> str:
    ratio = {
        "mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
        "symbols_per_word": "CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END",
        "stop_word_ratio": "CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
        "n_words": "n_words",
    }

    def holds(r: quality_rules.Rule) -> str:
        ok = [f"{ratio[r.metric]} >= {r.low}"] * (r.low is not None) + [f"{ratio[r.metric]} <= {r.high}"] * (r.high is not None)
        return f"(({' AND '.join(ok)}) OR n_words < {r.from_words})"

    rules = "".join(f", {holds(r)} AS rule_{r.name}" for r in quality_rules.RULES)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS w FROM d),
    g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
    g3 AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM g),
    rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g3 WHERE n > 1) GROUP BY r),
    l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
    m AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: list_contains({_list(quality_rules.STOP_WORDS)}, lower(rtrim(x, '.,;:!?')))))::BIGINT AS n_stop_words
      FROM w JOIN l USING (r) LEFT JOIN rep USING (r)),
    v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed{rules} FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
           {', '.join('rule_' + r.name for r in quality_rules.RULES)},
           (NOT base_failed AND {' AND '.join('rule_' + r.name for r in quality_rules.RULES)}) AS kept
    FROM v
    """


def mixing_sql() -> str:
    w = list(mixing.WEIGHTS)
    cells = mixing.BITS * mixing.LEVELS
    return f"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
    f AS (SELECT *, [{', '.join(f'{x}.0' for x in w)}][(rank - 1) % {len(w)} + 1]::DOUBLE AS w FROM r),
    l AS (
      SELECT *, source_size / w AS fill,
             1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest
      FROM f),
    x AS (SELECT * FROM l WHERE 2.0::DOUBLE * source_size * w_rest >= rest * w ORDER BY fill, rank LIMIT 1),
    t AS (
      SELECT l.source, l.source_size,
             CASE WHEN x.rank IS NOT NULL AND (l.fill > x.fill OR (l.fill = x.fill AND l.rank >= x.rank)) THEN l.w * x.rest / x.w_rest ELSE 2.0::DOUBLE * l.source_size END AS target
      FROM l LEFT JOIN x ON true),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
    c AS (SELECT source, hash >> {mixing.HASH_BITS - cells} AS cell, sum(size) AS n FROM d GROUP BY 1, 2),
    u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY cell) AS upto FROM c),
    h AS (
      SELECT u.source, min(struct_pack(cell := cell, left_ := target - whole * source_size - (upto - n), n := n)) AS x
      FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source WHERE upto > target - whole * source_size GROUP BY 1),
    b AS (SELECT p.*, coalesce(x.cell + CASE WHEN x.n > 0 AND x.left_ * 2 >= x.n THEN 1 ELSE 0 END, 0) AS below
          FROM p LEFT JOIN h ON p.source IS NOT DISTINCT FROM h.source)
    SELECT doc_id, size, source_size, target,
           (size * (whole + CASE WHEN whole < 2 AND (hash >> {mixing.HASH_BITS - cells}) < below THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
    """


EXACT = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256 FROM d JOIN g USING (text)
    """


def chat_sql(budget: int = 1024, history: int = 128) -> str:
    half, marks = budget // 2, len(chat.TURN) + len(chat.TEXT) + len(chat.END)

    def escaped(x: str) -> str:
        x = f"replace({x}, '\\', '\\\\')"
        for c in chat.CONTROL:
            x = f"replace({x}, {_quoted(c)}, {_quoted(c[0] + chr(92) + c[1:])})"
        return x

    return f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    t AS (
      SELECT *, len(regexp_extract_all(text, '{_WORD}')) + {chat.OVERHEAD} AS tokens,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
             length({escaped('role')}) + length({escaped('text')}) + {marks} AS chars FROM c),
    s AS (
      SELECT *, greatest(0, {budget - history - half} - coalesce(max(tokens) FILTER (pos = 0 AND role = 'system') OVER (PARTITION BY conv_id), 0)) AS room FROM t),
    k AS (
      SELECT *, sum(tokens) OVER w - tokens AS before, (sum(tokens) OVER w - tokens) // {half} AS cell, sum((tokens > room)::INT) OVER w * 2 - (tokens > room)::INT AS big
      FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
    b AS (SELECT conv_id, cell, big, min(pos) AS pos, min(before) AS before FROM k GROUP BY 1, 2, 3),
    o AS (
      SELECT k.conv_id, sum(k.chars) AS chars FROM b JOIN k ON b.conv_id IS NOT DISTINCT FROM k.conv_id AND b.pos > 0
        AND ((k.pos = 0 AND k.role = 'system') OR (k.pos < b.pos AND b.before - k.before <= {history} AND NOT (k.pos = 0 AND k.role = 'system')))
      GROUP BY 1),
    a AS (
      SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns,
             coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss FROM k GROUP BY 1)
    SELECT a.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
           (a.chars + coalesce(o.chars, 0))::BIGINT AS formatted_chars
    FROM a LEFT JOIN o ON a.conv_id IS NOT DISTINCT FROM o.conv_id
    """


ORACLES = {
    "op1_license_scan": license_scan(),
    "op2_quality_rules": quality(),
    "op6_source_mixing": mixing_sql(),
    "op7_exact_dedup": EXACT,
    "op8_chat_format": chat_sql(),
}
