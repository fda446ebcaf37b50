"""DuckDB SQL for the catalogue, from common parts: lines, direct blocks, pages."""

from __future__ import annotations

from ..config import MODES, stages_of
from ..functions.text import ALEF, ALEF_FORMS, TATWEEL, WS

LATIN, RTL = "aeio", "أإآـ"
#: (case, lines of spans (text, font, size)).
FIXED_FONTS = (
    (0, [[("a", "Serif", 9.5), ("b", "Sans", 8.0)], [("c", "Mono", 7.0)]]),
    (1, [[("a", None, None)]]),
    (2, [[]]),
    (3, []),
    (4, [[("  padded ", "Serif", 10.0)]]),
    (5, None),
)


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def _words(t: str) -> str:
    return f"(CASE WHEN {_strip(t)} = '' THEN 0 ELSE len(regexp_split_to_array({_strip(t)}, '{WS}+')) END)"


def _singles(t: str) -> str:
    return f"len(list_filter(regexp_split_to_array({_strip(t)}, '{WS}+'), lambda w: length(w) = 1))"


def _score(words: str, chars: str) -> str:
    return f"least(1.0::DOUBLE, {words} / 50.0::DOUBLE * 0.5::DOUBLE + {chars} / 500.0::DOUBLE * 0.5::DOUBLE)"


def _confidence(words: str, chars: str, singles: str, few: int) -> str:
    return f"CASE WHEN {words} = 0 THEN 0.0::DOUBLE WHEN {words} < {few} THEN 0.2::DOUBLE WHEN {singles} / {words} > 0.5 THEN 0.3::DOUBLE ELSE {_score(words, chars)} END"


def _ratio(t: str) -> str:
    return f"coalesce(length(regexp_replace({t}, '[^\\x{{590}}-\\x{{6ff}}]', '', 'g')) / nullif(length(regexp_replace({t}, '{WS}', '', 'g')), 0), 0.0::DOUBLE)"


def _direction(r: str) -> str:
    return f"CASE WHEN {r} > 0.7 THEN 'rtl' WHEN {r} > 0.3 THEN 'mixed' ELSE 'ltr' END"


def _artifacts(t: str) -> str:
    t = f"regexp_replace({t}, '{WS}+[|~`]{WS}+', ' ', 'g')"
    t = f"regexp_replace({t}, '[|~`]{{2,}}', '', 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\.{{3,}}', '...', 'g'), '-{{3,}}', '--', 'g')"


def _spacing(t: str) -> str:
    t = _strip(f"regexp_replace({t}, '{WS}+', ' ', 'g')")
    t = f"regexp_replace({t}, '{WS}+([.,!?;:])', '\\1', 'g')"
    return f"regexp_replace({t}, '([.,!?;:]){WS}*', '\\1 ', 'g')"


def _unbroken(t: str) -> str:
    """Marks the ends of words (private-use characters, which no table has): this SQL has no look-behind."""
    t = f"regexp_replace({t}, '([\\p{{L}}\\p{{N}}_]+)', '\ue000\\1\ue001', 'g')"
    t = f"regexp_replace({t}, '\ue000([\\p{{L}}\\p{{N}}_])\ue001{WS}+\ue000([\\p{{L}}\\p{{N}}_])\ue001', '\\1\\2', 'g')"
    return f"replace(replace(replace(translate({t}, '\ue000\ue001', ''), 'th e', 'the'), 'an d', 'and'), 'i s', 'is')"


BASE = f"""
lines_ AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
placed AS (
  SELECT doc_id, (pos // 12 + 1)::INT AS page_number, pos, pos % 12 AS slot, 1 + doc_id % 3 AS ncols, 576.0::DOUBLE / (1 + doc_id % 3) AS wide, line, {_strip('line')} AS text FROM lines_),
boxed AS (
  SELECT *, (slot % ncols) * wide + 16.0::DOUBLE AS x0, (slot // ncols) * 64.0::DOUBLE AS y0, (slot % ncols) * wide + 16.0::DOUBLE + wide - 32.0::DOUBLE AS x1, (slot // ncols) * 64.0::DOUBLE + 48.0::DOUBLE AS y1 FROM placed),
pages_ AS (SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY pos) AS text FROM placed GROUP BY 1, 2),
counted AS (
  SELECT doc_id, page_number, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pos) - 1)::INT AS seq, x0, y0, x1, y1, text,
         {_words('text')} AS word_count, length(text) AS char_count, {_singles('text')} AS singles
  FROM boxed WHERE length(text) >= 2),
direct AS (
  SELECT doc_id, page_number, seq, 'p' || page_number || '_b' || seq AS block_id, x0, y0, x1, y1, text, word_count::INT AS word_count, char_count::INT AS char_count,
         {_confidence('word_count', 'char_count', 'singles', 3)} AS confidence, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS cx
  FROM counted),
copied AS (
  SELECT doc_id, page_number, seq, block_id, 'direct' AS source_stage, 0 AS stage_ord, char_count, confidence FROM direct
  UNION ALL SELECT doc_id, page_number, seq, block_id || '_ocr', 'block_ocr', 1, char_count, confidence FROM direct WHERE seq % 3 = 0),
mixed AS (
  SELECT * REPLACE (CASE seq % 3 WHEN 0 THEN translate(text, '{LATIN}', '{RTL}')
    WHEN 1 THEN translate(substr(text, 1, 40), 'abcdefghijklmnopqrstuvwxyz', '{'ا' * 26}') || substr(text, 41) ELSE text END AS text) FROM direct),
noisy AS (
  SELECT * REPLACE (CASE seq % 3 WHEN 0 THEN replace(text, '. ', '.... ') WHEN 1 THEN replace(text, ' ', ' --- ') ELSE text END AS text) FROM direct),
cleaned AS (SELECT *, {_spacing(_artifacts(_unbroken('text')))} AS clean FROM noisy),
recognised AS (
  SELECT *, CASE seq % 5 WHEN 0 THEN text WHEN 1 THEN text || ' recovered words' WHEN 2 THEN substr(text, 1, 3) WHEN 3 THEN '' ELSE 'different ' || reverse(text) END AS ocr_text
  FROM direct WHERE confidence < 0.3 OR word_count < 3),
accepted AS (SELECT *, {_strip('ocr_text')} AS better FROM recognised WHERE length(ocr_text) > 0 AND length({_strip('ocr_text')}) > length(text)),
totals AS (
  SELECT p.doc_id, p.page_number, coalesce(sum(d.char_count), 0)::BIGINT AS total_chars, coalesce(sum(area), 0.0) / (576.0::DOUBLE * 768.0::DOUBLE) * 100 AS coverage,
         count(d.seq) AS n_blocks, coalesce(avg(confidence), 0.0::DOUBLE) AS mean,
         count(*) FILTER (cx < 576.0::DOUBLE / 3) AS l, count(*) FILTER (cx >= 576.0::DOUBLE / 3 AND cx < 576.0::DOUBLE * 2 / 3) AS m, count(*) FILTER (cx >= 576.0::DOUBLE * 2 / 3) AS r
  FROM pages_ p LEFT JOIN direct d USING (doc_id, page_number) GROUP BY 1, 2),
columned AS (SELECT *, CASE WHEN l + m + r < 2 THEN 1 WHEN l > 0 AND r > 0 AND m < 2 THEN 2 WHEN l > 0 AND m > 0 AND r > 0 THEN 3 ELSE 1 END AS columns FROM totals),
cells AS (
  SELECT doc_id, page_number, cell::INT AS cell, (800 * (cell % 3)) * (576.0::DOUBLE / 2400) AS x0, (1066 * (cell // 3)) * (768.0::DOUBLE / 3200) AS y0,
         (800 * (cell % 3 + 1)) * (576.0::DOUBLE / 2400) AS x1, (1066 * (cell // 3 + 1)) * (768.0::DOUBLE / 3200) AS y1
  FROM pages_, range(9) g(cell)),
validated AS (
  SELECT doc_id, page_number, text, {_words('text')} AS w, length({_strip('text')}) AS c, {_singles('text')} AS s FROM pages_),
scored AS (SELECT *, {_confidence('w', 'c', 's', 5)} AS confidence FROM validated),
routed AS (SELECT *, CASE WHEN confidence > 0.1 THEN 'direct' ELSE 'ocr' END AS method FROM scored),
shifted AS (
  SELECT doc_id, page_number, seq, 0 AS stage_ord, x0, y0, x1, y1 FROM direct
  UNION ALL SELECT doc_id, page_number, seq, 1, x0 + (x1 - x0) / 8, y0, x1 + (x1 - x0) / 8, y1 FROM direct WHERE seq % 2 = 0),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY stage_ord, seq) - 1)::INT AS ord FROM shifted),
pictures AS (
  SELECT doc_id, page_number, i::INT AS img_index, CASE WHEN i = 1 THEN [0.0, 0.0, 100.0, 100.0] ELSE [0.0, 0.0, 100.0 + i, 50.0] END::DOUBLE[] AS b,
         CASE WHEN i = 0 THEN 'words in an image' ELSE '' END AS ocr_text
  FROM pages_, range(3) g(i))
"""
_P = "doc_id, page_number"
_OVERLAP = "greatest(0.0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0::DOUBLE, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_IOU = f"({_OVERLAP} / nullif((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_OVERLAP}, 0))"


def _fonts() -> str:
    def row(i, lines) -> str:
        first = lines[0][0] if lines and lines[0] else None
        q = lambda x: "NULL" if x is None else f"'{x}'"
        font, size = ("NULL", "NULL") if first is None else (q(first[1] or "Unknown"), str(first[2] or 12.0))
        text = "NULL" if lines is None else q(" ".join(s[0] for line in lines for s in line).strip())
        return f"({i}, {font}, {size}::DOUBLE, {text})"

    return "SELECT * FROM (VALUES " + ", ".join(row(*r) for r in FIXED_FONTS) + ") v(i, font, size, text)"


def _modes() -> str:
    rows = [f"('{m}', {s.block_ocr}, {s.full_page_ocr}, {s.grid_ocr}, {s.image_ocr})" for m in (*MODES, "other") for s in [stages_of(m)]]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(mode, block_ocr, full_page_ocr, grid_ocr, image_ocr)"


_PARTS = {
    "block_scan": f"SELECT {_P}, seq, block_id, text, x0, y0, x1, y1 FROM direct",
    "block_counts": f"SELECT {_P}, seq, word_count, char_count FROM direct",
    "block_confidence": f"SELECT {_P}, seq, confidence, confidence >= 0.3 AS high FROM direct",
    "page_text_validation": f"SELECT {_P}, (w >= 5 AND NOT (s / w > 0.5) AND confidence > 0.1) AS valid, confidence FROM scored",
    "structured_confidence": f"SELECT {_P}, seq, least(1.0::DOUBLE, word_count / 10.0::DOUBLE) AS confidence, least(1.0::DOUBLE, word_count / 10.0::DOUBLE) < 0.1 AS needs_ocr FROM direct",
    "direction_three_way": f"SELECT {_P}, seq, {_ratio('text')} AS rtl_ratio, {_direction(_ratio('text'))} AS direction FROM mixed",
    "direction_two_way": f"SELECT {_P}, seq, CASE WHEN {_ratio('text')} > 0.3 THEN 'rtl' ELSE 'ltr' END AS direction FROM mixed",
    "font_info": _fonts(),
    "ocr_candidates": f"SELECT {_P}, seq, text FROM recognised",
    "ocr_accept": f"SELECT {_P}, seq, block_id || '_ocr' AS block_id, better AS text, 0.8::DOUBLE AS confidence, {_words('better')}::INT AS word_count, length(better)::INT AS char_count FROM accepted",
    "full_page_trigger": f"SELECT {_P}, total_chars, coverage, (total_chars < 100 OR coverage < 20.0 OR page_number = 1) AS needs_full_page FROM totals",
    "grid_cells": f"SELECT {_P}, cell, x0, y0, x1, y1 FROM cells",
    "grid_sparse": f"""SELECT {_P}, (row_number() OVER (PARTITION BY {_P} ORDER BY cell) - 1)::INT AS seq, cell FROM cells a JOIN totals t USING ({_P})
      WHERE total_chars <= 200 AND NOT EXISTS (SELECT 1 FROM direct b WHERE b.doc_id = a.doc_id AND b.page_number = a.page_number AND {_IOU} > 0.3)""",
    "iou_pairs": f"SELECT {_P.replace('doc_id', 'a.doc_id').replace('page_number', 'a.page_number')}, a.ord AS later, b.ord AS earlier, round({_IOU}, 9) AS iou FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.ord > b.ord AND {_IOU} >= 0.7",
    "dedup_exact": f"SELECT {_P}, seq AS out_seq, block_id FROM direct",
    "dedup_counters": f"SELECT {_P}, count(*)::INT AS total_input_blocks, (count(*) FILTER (stage_ord = 1))::INT AS duplicates_removed, 0 AS blocks_merged FROM copied GROUP BY ALL",
    "dedup_priority_reversed": f"SELECT {_P}, seq AS out_seq, block_id FROM direct",
    "arabic_normalize": f"SELECT {_P}, seq, translate(text, '{ALEF_FORMS + TATWEEL}', '{ALEF * 3}') AS text FROM mixed",
    "broken_words": f"SELECT {_P}, seq, {_unbroken('text')} AS text FROM direct",
    "ocr_artifacts": f"SELECT {_P}, seq, {_artifacts('text')} AS text FROM noisy",
    "punct_spacing": f"SELECT {_P}, seq, {_spacing('text')} AS text FROM noisy",
    "post_process": f"SELECT {_P}, seq, clean AS text, {_words('clean')}::INT AS word_count, length({_strip('clean')})::INT AS char_count, clean <> text AS fixed, 'post_processed' AS source_stage FROM cleaned",
    "post_process_counters": f"SELECT {_P}, 0::BIGINT AS arabic_blocks_reshaped, count(*) FILTER (clean <> text) AS words_fixed FROM cleaned GROUP BY ALL",
    "column_detect": f"SELECT {_P}, columns FROM columned",
    "column_assign": f"SELECT {_P}, seq, CASE WHEN columns = 1 THEN 1 ELSE least(trunc(cx / (576.0::DOUBLE / columns))::INT + 1, columns) END AS \"column\" FROM direct JOIN columned USING ({_P})",
    "stage_stats_page": f"SELECT {_P}, source_stage, count(*) AS n FROM copied GROUP BY ALL",
    "stage_stats_doc": "SELECT doc_id, source_stage, count(*) AS n FROM copied GROUP BY ALL",
    "stage_stats_maps": "SELECT doc_id, count(*) FILTER (stage_ord = 0) AS n_direct, count(*) FILTER (stage_ord = 1) AS n_block_ocr FROM copied GROUP BY ALL",
    "stage_summary": f"SELECT {_P}, source_stage, count(*) AS block_count, sum(char_count)::BIGINT AS total_chars, round(avg(confidence), 9) AS avg_confidence FROM copied GROUP BY ALL",
    "page_summary": f"SELECT {_P}, 576.0::DOUBLE AS width, 768.0::DOUBLE AS height, n_blocks, total_chars AS n_chars, 0::BIGINT AS n_images, round(mean, 9) AS total_confidence, coverage AS text_coverage FROM totals",
    "document_summary": "SELECT doc_id, count(*) AS total_pages, sum(n_blocks)::BIGINT AS total_blocks, 0::BIGINT AS total_images, round(coalesce(avg(mean) FILTER (mean > 0), 0.0), 9) AS avg_confidence FROM totals GROUP BY ALL",
    "high_low_counts": f"SELECT {_P}, count(*) AS total_blocks, count(*) FILTER (confidence >= 0.3) AS high_confidence_blocks, count(*) FILTER (confidence < 0.3) AS low_confidence_blocks FROM direct GROUP BY ALL",
    "stage_union": f"""SELECT {_P}, (row_number() OVER (PARTITION BY {_P} ORDER BY o, seq) - 1)::INT AS ord, block_id, source_stage FROM (
      SELECT {_P}, seq, block_id, 'direct' AS source_stage, 0 AS o FROM direct UNION ALL SELECT {_P}, seq, block_id || '_ocr', 'block_ocr', 1 FROM accepted)""",
    "viewer_filters": """SELECT v AS "view", doc_id, count(*) AS n FROM copied, (VALUES ('all'), ('direct'), ('ocr')) x(v)
      WHERE v = 'all' OR (v = 'direct') = (source_stage = 'direct') GROUP BY ALL""",
    "hybrid_routing": f"SELECT {_P}, method, CASE WHEN method = 'ocr' THEN 0.8::DOUBLE ELSE confidence END AS confidence FROM routed",
    "hybrid_methods": "SELECT doc_id, method, count(*) AS n_pages FROM routed GROUP BY ALL",
    "hybrid_full_text": """SELECT doc_id, string_agg(chr(10) || repeat('=', 50) || chr(10) || 'Page ' || page_number || ' (' || upper(method) || ')' || chr(10) || repeat('=', 50) || chr(10) || text || chr(10), '' ORDER BY page_number) AS full_text
      FROM routed GROUP BY ALL""",
    "structured_blocks": None,
    "structured_counts": f"SELECT {_P}, count(*) AS text_blocks, 0::BIGINT AS image_blocks, count(*) AS direct_blocks, 0::BIGINT AS ocr_blocks FROM direct WHERE char_count >= 3 GROUP BY ALL",
    "coordinate_scaling": f"""SELECT {_P}, seq, px0, py0, px1, py1, round(px0 * (576.0::DOUBLE / 2400), 6) AS qx0, round(py0 * (768.0::DOUBLE / 3200), 6) AS qy0, round(px1 * (576.0::DOUBLE / 2400), 6) AS qx1, round(py1 * (768.0::DOUBLE / 3200), 6) AS qy1
      FROM (SELECT *, trunc(x0 * (2400.0::DOUBLE / 576))::INT AS px0, trunc(y0 * (3200.0::DOUBLE / 768))::INT AS py0, trunc(x1 * (2400.0::DOUBLE / 576))::INT AS px1, trunc(y1 * (3200.0::DOUBLE / 768))::INT AS py1 FROM direct)""",
    "image_blocks": f"""SELECT {_P}, 'p' || page_number || '_img' || img_index AS image_id, 'out/page' || page_number || '_img' || img_index || '.png' AS image_path, ocr_text,
      CASE WHEN ocr_text <> '' THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS confidence, 'png' AS format, b[1] AS x0, b[2] AS y0, b[3] AS x1, b[4] AS y1 FROM pictures""",
    "image_counters": f"SELECT {_P}, 3::BIGINT AS images, 1::BIGINT AS images_with_text, 'p' || page_number || '_img0_text' AS block_id, 4 AS word_count FROM pictures WHERE img_index = 0",
    "stage_counters": f"""
      , boxes AS (
        SELECT {_P}, x0, y0, x1, y1, char_count FROM direct UNION ALL SELECT {_P}, x0, y0, x1, y1, length(better) FROM accepted
        UNION ALL SELECT {_P}, 0, 0, 576, 768, length('scan of page ' || page_number) FROM totals WHERE total_chars < 100 OR coverage < 20.0 OR page_number = 1),
      free AS (
        SELECT a.* FROM cells a JOIN (SELECT {_P} FROM pages_ LEFT JOIN boxes USING ({_P}) GROUP BY ALL HAVING coalesce(sum(char_count), 0) <= 200) USING ({_P})
        WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.doc_id = a.doc_id AND b.page_number = a.page_number AND {_IOU} > 0.3)),
      n AS (
        SELECT {_P}, 1 AS a, 0 AS b, 0 AS c, 0 AS d FROM recognised UNION ALL SELECT {_P}, 0, 1, 0, 0 FROM accepted UNION ALL SELECT {_P}, 0, 0, 1, (cell % 2 = 0)::INT FROM free)
      SELECT {_P}, coalesce(sum(a), 0)::BIGINT AS blocks_processed, coalesce(sum(b), 0)::BIGINT AS blocks_improved, coalesce(sum(c), 0)::BIGINT AS grid_regions,
             coalesce(sum(d), 0)::BIGINT AS regions_with_text, 3::BIGINT AS images, 1::BIGINT AS images_with_text FROM pages_ LEFT JOIN n USING ({_P}) GROUP BY ALL""",
    "hybrid_images": f"SELECT {_P}, method, 2::BIGINT AS images_count FROM routed",
    "run_summary": """SELECT count(*) AS documents, sum(p)::BIGINT AS total_pages, sum(b)::BIGINT AS total_blocks, 0::BIGINT AS total_images, round(coalesce(avg(m) FILTER (m > 0), 0.0), 9) AS avg_confidence
      FROM (SELECT count(*) AS p, sum(n_blocks) AS b, coalesce(avg(mean) FILTER (mean > 0), 0.0) AS m FROM totals GROUP BY doc_id)""",
    "mode_stage_matrix": _modes(),
    "job_status": "SELECT source AS job_id, count(*) AS total, count(*) FILTER (length(text) >= 100) AS results, count(*) FILTER (length(text) < 100) AS errors, 'completed' AS status FROM documents GROUP BY ALL",
    "output_names": "SELECT * FROM (VALUES ('a.pdf', 'a_intelligent.json'), ('a.b.PDF', 'a.b_intelligent.json'), ('noext', 'noext_intelligent.json'), ('.hidden', '.hidden_intelligent.json'), ('dir.d.pdf', 'dir.d_intelligent.json')) v(name, out)",
}
_PARTS["structured_blocks"] = f"""
  SELECT {_P}, 'p' || page_number || '_b' || k AS block_id, 'text' AS type, 'direct' AS extraction_method, least(1.0::DOUBLE, word_count / 10.0::DOUBLE) AS confidence,
         CASE WHEN {_ratio('text')} > 0.3 THEN 'rtl' ELSE 'ltr' END AS direction, CASE WHEN columns = 1 THEN 1 ELSE least(trunc(cx / (576.0::DOUBLE / columns))::INT + 1, columns) END AS "column", columns
  FROM (SELECT *, CASE WHEN l + m + r < 2 THEN 1 WHEN l > 0 AND r > 0 AND m < 2 THEN 2 WHEN l > 0 AND m > 0 AND r > 0 THEN 3 ELSE 1 END AS columns FROM (
    SELECT *, row_number() OVER (PARTITION BY {_P} ORDER BY seq) - 1 AS k, count(*) FILTER (cx < 192) OVER w AS l, count(*) FILTER (cx >= 192 AND cx < 384) OVER w AS m, count(*) FILTER (cx >= 384) OVER w AS r
    FROM direct WHERE char_count >= 3 WINDOW w AS (PARTITION BY {_P})))
"""
ORACLE_SQL = {k: f"WITH {BASE.rstrip()} {v}" for k, v in _PARTS.items()}
