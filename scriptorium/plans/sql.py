"""SQL for the queries whose rules are long: pieces that say again, in literals of their own,
what the operators compute, so that neither shares anything with the other."""

from __future__ import annotations

SPACES = r"[\x{0009}-\x{000D}\x{0020}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PAGES = "(SELECT DISTINCT page_id, entry_id, slug, page, text FROM document_pages)"
META = """(SELECT entry_id, extractor, confidence, chars, source_pages, indexed_pages, index_status, index_note FROM
  (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY extracted_at DESC NULLS LAST, extractor DESC NULLS LAST, confidence DESC NULLS LAST, chars DESC NULLS LAST,
  source_pages DESC NULLS LAST, indexed_pages DESC NULLS LAST, index_status DESC NULLS LAST, index_note DESC NULLS LAST) AS rn FROM extraction_meta) WHERE rn = 1)"""
KEPT = "[^A-Za-zА-Яа-яЁё0-9.,:;!?\\-–—«»\"''()/\\\\%+№§°\\n\\r\\t ]"


def trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SPACES}+', ''), '{SPACES}+$', '')"


def norm(c: str) -> str:
    return f"replace(lower({c}), 'ё', 'е')"


def count(c: str, terms: list[str]) -> str:
    return " + ".join(f"CAST((length({c}) - length(replace({c}, '{t}', ''))) / {len(t)} AS INTEGER)" for t in terms)


# --- quality ----------------------------------------------------------------------------

_S = SPACES
_LETTER = "[A-ZА-ЯЁa-zа-яё0-9\\-–—,/()«»\"''\\." + SPACES[1:]


def _marked(c: str) -> str:
    """Text with a mark after each number that may end an entry of a table of contents: up to
    three digits before white space or the end, or before the number of another entry."""
    once = f"regexp_replace({c}, '({_S}\\d{{1,3}})({_S}|$)', '\\1' || chr(1) || '\\2', 'g')"
    once = once.replace("{c}", c)
    twice = f"regexp_replace({once}, '({_S}\\d{{1,3}})({_S}|$)', '\\1' || chr(1) || '\\2', 'g')"
    short = f"regexp_replace({twice}, '({_S}\\d{{1,2}})(\\d\\.)', '\\1' || chr(1) || '\\2', 'g')"
    return f"regexp_replace({short}, '({_S}\\d{{3}})(\\d+\\.)', '\\1' || chr(1) || '\\2', 'g')"


_NUMBER = "(?:\\d\\x01?)+"
_ENTRY = f"{_NUMBER}(?:\\.{_NUMBER})?\\.{_S}+[A-ZА-ЯЁ](?:{_LETTER}\\x01?){{4,120}}?{_S}+\\d{{1,3}}\\x01"
_HEADING = f"(?m)^{_S}*\\d+(?:\\.\\d+)*\\.?{_S}+[А-ЯЁA-Z][^\\n]{{6,120}}$"
_HEADING_START = f"^\\d+(?:\\.\\d+)*\\.?{_S}+[А-ЯЁA-Z]"


def facts(source: str, keys: str) -> str:
    """Keys, text and what the quality rules go by, of a source with a column text."""
    return f"""(SELECT {keys}, text, length(text) AS n, len(regexp_extract_all(text, '[А-Яа-яЁё]')) AS cyr, contains(text, chr(10)) AS breaks, len(e) AS entries, coalesce(list_sum(list_transform(e, lambda x: length(replace(x, chr(1), '')))), 0) AS entry_chars,
      len(h) AS headings, coalesce(list_sum(list_transform(h, lambda x: length(x))), 0) AS heading_chars, len(list_filter(l, lambda x: length(x) > 55 AND NOT regexp_matches(x, '{_HEADING_START}'))) AS bodies
      FROM (SELECT {keys}, text, regexp_extract_all({_marked("text")}, '{_ENTRY}') AS e, regexp_extract_all(text, '{_HEADING}') AS h, list_transform(string_split_regex(text, '\\n+'), lambda x: {trim("x")}) AS l FROM {source}))"""


def heavy(p: str) -> str:
    thin = f"({p} >= 3 AND n < 300 * {p})"
    return f"""CASE WHEN n < 120 THEN false WHEN entries >= 4 AND entry_chars >= 0.45::DOUBLE * n THEN true
      WHEN breaks THEN (headings >= 5 AND heading_chars >= 0.2::DOUBLE * n AND bodies < headings / 3.0) OR {thin} ELSE {thin} END"""


def usable(p: str) -> str:
    per = f"(n / CASE WHEN {p} > 0 THEN {p} ELSE 1 END)"
    return f"""CASE WHEN n IS NULL OR n < 120 THEN false WHEN cyr < 20 THEN false WHEN n >= 12000 AND cyr >= 400 THEN true WHEN n >= 6000 AND cyr >= 200 THEN true
      WHEN {p} >= 40 AND n >= 3000 AND cyr >= 150 THEN true WHEN {per} >= 250 THEN true WHEN {p} >= 3 AND {per} < 300 THEN n >= 8000 AND cyr >= 250 WHEN {heavy(p)} THEN n >= 10000 ELSE true END"""


def wanting(p: str) -> str:
    per = f"(n / CASE WHEN {p} > 0 THEN {p} ELSE 1 END)"
    return f"CASE WHEN {usable(p)} THEN false WHEN n IS NULL OR n < 800 THEN true WHEN cyr < 15 THEN true WHEN {p} >= 5 AND {per} < 80 THEN true ELSE {heavy(p)} AND n < 5000 END"


def poor(p: str) -> str:
    return f"CASE WHEN n IS NULL OR n < 120 THEN true WHEN cyr < 20 THEN true WHEN {p} >= 3 AND n < 300 * {p} THEN true ELSE {heavy(p)} END"


_PAGED = f"(SELECT e.entry_id, e.text, coalesce(m.source_pages, 0) AS p FROM extracted_documents e LEFT JOIN {META} m USING (entry_id))"
JUDGED = facts(_PAGED, "entry_id, p")
LAYERS = f"""(SELECT entry_id, 0 AS layer, text FROM extracted_documents UNION ALL SELECT entry_id, 1 AS layer, string_agg(coalesce(text, ''), chr(10) ORDER BY page NULLS FIRST, text NULLS FIRST) AS text FROM {PAGES} GROUP BY entry_id)"""
LAYER_ARGMAX = f"""SELECT entry_id, layer, score FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, layer) AS rn FROM (SELECT entry_id, layer,
  coalesce(n + 3 * cyr + CASE WHEN {usable("0")} THEN 10000 ELSE 0 END, -1) AS score FROM {facts(LAYERS, "entry_id, layer")})) WHERE rn = 1"""
WORDS = f"""len(list_distinct(list_filter(string_split_regex({norm("text")}, '{_S}+'), lambda w: length(w) > 3)))"""
QUALITY_SCORE = f"""SELECT entry_id, round(CASE WHEN n IS NULL OR n < 120 THEN 0.0::DOUBLE ELSE least(n / greatest(p, 1), 2500.0::DOUBLE) * 0.35::DOUBLE + {WORDS} * 1.8::DOUBLE + cyr * 0.04::DOUBLE - entry_chars / n * 8000.0::DOUBLE END, 6) AS score FROM {JUDGED}"""

_CLEAN = f"(SELECT page_id, text, regexp_replace(text, '{KEPT}', '', 'g') AS c FROM {PAGES})"
PHOTO_SCORED = f"""(SELECT page_id, text, cyr, words, regexp_matches(lower(c), 'вопрос|вариант|разрешается|запрещается') AS quiz, CASE WHEN coalesce(letters, 0) = 0 THEN 0.0::DOUBLE ELSE cyr * 3 + latin * 0.4::DOUBLE + digits * 0.3::DOUBLE
  + cyr / greatest(letters, 1) * 120 + CASE WHEN contains(lower(c), 'вопрос') THEN 30 ELSE 0 END + CASE WHEN contains(lower(c), 'вариант') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(lower(c), 'разрешается|запрещается') THEN 25 ELSE 0 END
  + CASE WHEN regexp_matches(lower(c), 'тепло|ремн|установ') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(c, '№[ \\t\\r\\n]*[0-9]+') THEN 15 ELSE 0 END + least(words, 12) * 4 END AS score
  FROM (SELECT page_id, text, c, length(regexp_replace(c, '[ \\t\\r\\n0-9\\p{{P}}]', '', 'g')) AS letters, len(regexp_extract_all(c, '[А-Яа-яЁё]')) AS cyr, len(regexp_extract_all(c, '[А-Яа-яЁё]{{4,}}')) AS words,
  len(regexp_extract_all(c, '[A-Za-z]')) AS latin, len(regexp_extract_all(c, '[0-9]')) AS digits FROM {_CLEAN}))"""
_T = trim("text")
PHOTO_QUALITY = f"""SELECT page_id, round(score, 6) AS score, coalesce(words >= 3 AND cyr >= 30 AND score >= 45 AND (quiz OR (score >= 55 AND cyr >= 40)), false) AS usable,
  CASE WHEN coalesce({_T}, '') = '' THEN false ELSE length({_T}) >= 25 AND (len(regexp_extract_all({_T}, '[А-Яа-яЁё]')) >= 15 OR length({_T}) >= 80) END AS as_document FROM {PHOTO_SCORED}"""
PHOTO_TEXT = f"""SELECT page_id, nullif(left({trim("array_to_string(list_filter(list_transform(string_split(replace(c, chr(13) || chr(10), chr(10)), chr(10)), lambda x: " + trim("regexp_replace(x, '[ \\t|]+', ' ', 'g')") + "), lambda x: length(x) > 1), chr(10))")}, 12000), '') AS text FROM {_CLEAN}"""

_STATE = f"""(SELECT *, greatest(p, 0) AS s, coalesce(k, 0) AS i FROM (SELECT f.*, coalesce(m.extractor, '') AS x, k FROM {JUDGED} f LEFT JOIN {META} m USING (entry_id)
  LEFT JOIN (SELECT entry_id, count(*) AS k FROM {PAGES} WHERE length(text) > 0 GROUP BY entry_id) USING (entry_id)))"""
_OF = "'OCR: ' || i || ' из ' || s"
_SPARSE = f"coalesce({poor('s')} OR n / greatest(s, 1) < 300, true)"
INDEX_STATUS = f"""SELECT entry_id, CAST(s AS INTEGER) AS source_pages, CAST(CASE WHEN s < 3 THEN CASE WHEN i > 0 THEN i WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END WHEN x = 'tesseract-ocr' THEN i ELSE 0 END AS INTEGER) AS indexed_pages,
  CASE WHEN s < 3 THEN 'ready' WHEN x = 'tesseract-ocr' THEN CASE WHEN s > i THEN 'partial' ELSE 'ready' END WHEN {_SPARSE} THEN 'partial' ELSE 'ready' END AS index_status,
  CASE WHEN s < 3 THEN NULL WHEN x = 'tesseract-ocr' THEN CASE WHEN s <= i THEN NULL WHEN i < 150 AND s > 150 THEN {_OF} || ' стр. (лимит 150). Увеличьте LIBRARY_OCR_MAX_PAGES и переиндексируйте.' ELSE {_OF} || ' стр. Запустите переиндексацию.' END
  WHEN {_SPARSE} THEN 'Текстовый слой PDF (часто только оглавление). Нужен полный OCR — переиндексируйте (↻).' END AS index_note FROM {_STATE}"""

# --- contexts ---------------------------------------------------------------------------

TERMS = ["проверка", "заземляю", "устройст"]
_TEXT = "coalesce(text, '')"


def _scored(factor: float) -> str:
    """Pages with score, contents and block."""
    return f"""(SELECT slug, entry_id, page, c AS contents, CAST(({count(norm("text"), TERMS)}) AS DOUBLE) * CASE WHEN c THEN {factor}::DOUBLE ELSE 1.0::DOUBLE END AS score, '[стр. ' || page || ']' || chr(10) || {trim("text")} AS block
      FROM (SELECT *, {heavy("1")} AS c FROM {facts(f"(SELECT slug, entry_id, page, {_TEXT} AS text FROM {PAGES})", "slug, entry_id, page")}))"""


def narrow(most: int) -> str:
    part = "PARTITION BY slug, entry_id ORDER BY"
    return f"""(SELECT slug, entry_id, left(string_agg(block, chr(10) || chr(10) ORDER BY rank), {most}) AS context, count(*) AS blocks FROM (SELECT *, max(used >= {most} OR (rank > 1 AND used + length(block) > {most})) OVER ({part} rank) AS stopped FROM
      (SELECT *, row_number() OVER w AS rank, coalesce(sum(length(block) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {_scored(0.12)} WHERE score > 0 WINDOW w AS ({part} score DESC, page, block))) WHERE NOT stopped GROUP BY slug, entry_id)"""


def spread_out(most: int) -> str:
    part = "PARTITION BY slug, entry_id"
    return f"""(SELECT slug, entry_id, left(string_agg(block, chr(10) || chr(10) ORDER BY page, block), {most}) AS context, count(*) AS blocks FROM (SELECT *, coalesce(sum(length(block) + 2) OVER ({part} ORDER BY page, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM
      (SELECT *, count(*) OVER ({part}) AS k, row_number() OVER ({part} ORDER BY page, block) - 1 AS rn FROM (SELECT *, count_if(NOT contents OR page > 4) OVER ({part}) AS bodies FROM {_scored(0.12)}) WHERE bodies < 5 OR NOT contents OR page > 4)
      WHERE rn % greatest(1, k // 12) = 0 AND rn // greatest(1, k // 12) < 16) WHERE used < {most} GROUP BY slug, entry_id)"""


def wide(most: int) -> str:
    near = "CASE WHEN o.score > 0 THEN [o.page, o.page - 1, o.page + 1] ELSE [o.page] END"
    return f"""(WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slug, entry_id ORDER BY score DESC, page) AS i, row_number() OVER (PARTITION BY slug, entry_id ORDER BY page, contents) AS j, count(*) OVER (PARTITION BY slug, entry_id) AS k FROM {_scored(0.08)}),
      pick AS (SELECT DISTINCT slug, entry_id, CAST(0 AS BIGINT) AS i, k, CAST([] AS INTEGER[]) AS chosen FROM o UNION ALL SELECT p.slug, p.entry_id, p.i + 1, p.k, CASE WHEN len(chosen) >= 24 OR (o.score <= 0 AND len(chosen) >= 8) THEN chosen ELSE list_distinct(list_concat(chosen, {near})) END
      FROM pick p JOIN o ON o.slug = p.slug AND o.entry_id = p.entry_id AND o.i = p.i + 1),
      fill AS (SELECT slug, entry_id, CAST(0 AS BIGINT) AS i, k, chosen FROM pick WHERE i = k UNION ALL SELECT p.slug, p.entry_id, p.i + 1, p.k, CASE WHEN len(chosen) < 40 AND (NOT o.contents OR o.page > 5) THEN list_distinct(list_concat(chosen, [o.page])) ELSE chosen END
      FROM fill p JOIN o ON o.slug = p.slug AND o.entry_id = p.entry_id AND o.j = p.i + 1),
      kept AS MATERIALIZED (SELECT o.slug, o.entry_id, o.block, row_number() OVER (PARTITION BY o.slug, o.entry_id ORDER BY o.page, o.block) AS r FROM o JOIN fill f ON f.slug = o.slug AND f.entry_id = o.entry_id AND f.i = f.k AND list_contains(f.chosen, o.page)),
      pack AS (SELECT DISTINCT slug, entry_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, '' AS context, CAST(0 AS BIGINT) AS blocks FROM kept UNION ALL SELECT p.slug, p.entry_id, p.i + 1, CASE WHEN f THEN p.used + length(block) + 2 ELSE p.used END,
      CASE WHEN NOT f THEN context WHEN blocks = 0 THEN block ELSE context || chr(10) || chr(10) || block END, CASE WHEN f THEN blocks + 1 ELSE blocks END
      FROM (SELECT p.*, kept.block, p.used < {most} AND (p.used + length(kept.block) <= {most} OR p.blocks = 0) AS f FROM pack p JOIN kept ON kept.slug = p.slug AND kept.entry_id = p.entry_id AND kept.r = p.i + 1) p)
      SELECT slug, entry_id, left(context, {most}) AS context, blocks FROM (SELECT *, row_number() OVER (PARTITION BY slug, entry_id ORDER BY i DESC) AS last FROM pack) WHERE last = 1)"""


TRIMMED = f"(SELECT slug, entry_id, text FROM (SELECT slug, entry_id, {trim('text')} AS text FROM extracted_documents) WHERE length(text) > 0)"


def islands(source: str = TRIMMED) -> str:
    spots = " UNION ALL ".join(
        f"SELECT slug, entry_id, text, unnest(list_transform(range(1, len(parts)), lambda k: CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) AS INTEGER) + (k - 1) * {len(t)})) AS spot FROM (SELECT slug, entry_id, text, string_split({norm('text')}, '{t}') AS parts FROM {source})" for t in TERMS
    )
    return f"""(SELECT slug, entry_id, any_value(text) AS text, CAST(min(b) AS INTEGER) AS begin, CAST(max(f) AS INTEGER) AS finish FROM (SELECT *, sum(CASE WHEN b > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY slug, entry_id ORDER BY b, f ROWS UNBOUNDED PRECEDING) AS island FROM
      (SELECT *, max(f) OVER (PARTITION BY slug, entry_id ORDER BY b, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT slug, entry_id, text, greatest(0, spot - 2200) AS b, least(length(text), spot + 2200) AS f FROM ({spots})))) GROUP BY slug, entry_id, island)"""


def windowed(most: int, source: str = TRIMMED) -> str:
    return f"""(SELECT t.slug, t.entry_id, coalesce(w.context, left(t.text, {most})) AS context, coalesce(w.blocks, 0) AS blocks FROM {source} t LEFT JOIN (SELECT slug, entry_id, count(*) AS blocks,
      left(string_agg(CASE WHEN begin > 0 THEN '... ' ELSE '' END || chunk || CASE WHEN finish < length(text) THEN ' ...' ELSE '' END, chr(10) || chr(10) ORDER BY begin), {most}) AS context FROM
      (SELECT *, coalesce(sum(length(chunk) + 2) OVER (PARTITION BY slug, entry_id ORDER BY begin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (SELECT *, {trim("substr(text, begin + 1, finish - begin)")} AS chunk FROM {islands(source)}) WHERE length(chunk) > 0)
      WHERE used < {most} GROUP BY slug, entry_id) w USING (slug, entry_id))"""


def built(most: int, source: str = TRIMMED) -> str:
    """Context and builder of every document of a source with text."""
    return f"""(SELECT t.slug, t.entry_id, CASE WHEN n.context IS NOT NULL THEN n.context WHEN s.context IS NOT NULL THEN s.context WHEN length(t.text) <= {most} THEN t.text ELSE w.context END AS context,
      CASE WHEN n.context IS NOT NULL THEN 'narrow' WHEN s.context IS NOT NULL THEN 'spread' WHEN length(t.text) <= {most} THEN 'whole' ELSE 'windows' END AS builder
      FROM {source} t LEFT JOIN {narrow(most)} n USING (slug, entry_id) LEFT JOIN {spread_out(most)} s USING (slug, entry_id) LEFT JOIN {windowed(most, source)} w USING (slug, entry_id))"""


def context_items(hits: str, most: int, limit: int) -> str:
    """The documents of the first hits with their contexts."""
    first = f"(SELECT slug, path, row_number() OVER (ORDER BY score DESC, name COLLATE ru, path, slug) AS rank FROM ({hits}) LIMIT {limit})"
    source = f"(SELECT slug, entry_id, text FROM (SELECT e.slug, e.entry_id, left({trim('e.text')}, 120000) AS text FROM extracted_documents e JOIN {first} USING (slug, path)) WHERE length(text) > 0)"
    return f"""(SELECT CAST(h.rank AS INTEGER) AS rank, h.slug, h.path, list_extract(string_split(h.path, '/'), -1) AS name, CASE WHEN m.index_status = 'partial' AND length(m.index_note) > 0 THEN '[Индекс неполный: ' || m.index_note || ']' || chr(10) || chr(10) ELSE '' END || b.context AS text, m.extractor, m.confidence
      FROM {first} h JOIN extracted_documents e USING (slug, path) JOIN {built(most, source)} b ON b.slug = e.slug AND b.entry_id = e.entry_id LEFT JOIN {META} m ON m.entry_id = e.entry_id)"""


# --- terms, names -----------------------------------------------------------------------

_STOP = "['какие', 'какой', 'какая', 'какое', 'сколько', 'данной', 'этой', 'установке', 'установка', 'установки', 'посмотри', 'напиши', 'найди', 'весь', 'паспорт', 'необходимо', 'необходим', 'произвести', 'производ']"
_MORE = """CASE left(w, 8) WHEN 'запуск' THEN ['пуск', 'пусконалад', 'монтаж', 'ввод', 'эксплуата', 'commission'] WHEN 'первый' THEN ['первичн', 'начальн'] WHEN 'монтаж' THEN ['монтаж', 'пусконалад', 'установк']
  WHEN 'извлечен' THEN ['извлеч', 'элемент', 'мембран', 'картридж'] WHEN 'элемент' THEN ['элемент', 'мембран', 'картридж', 'фильтр'] WHEN 'инструк' THEN ['инструк', 'руковод', 'регламент', 'раздел'] ELSE [] END"""


def once(list_: str) -> str:
    """A list without repetitions, in order."""
    return f"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT {list_} AS l))"


def terms(c: str, most: int = 16) -> str:
    words = f"list_filter(regexp_extract_all({norm(c)}, '[a-zа-я0-9]{{3,}}'), lambda w: NOT list_contains({_STOP}, w))"
    return f"{once(f'flatten(list_transform({words}, lambda w: list_concat([left(w, 8)], {_MORE})))')}[1:{most}]"


def sections(c: str) -> str:
    a = f"list_transform(regexp_extract_all({c}, '(?i)раздел[A-Za-z0-9_]*[^0-9]{{0,24}}([0-9]+(?:\\.[0-9]+)*)', 1), lambda n: [n, n || '.', n || ' ', 'раздел ' || n, '§ ' || n])"
    b = f"list_transform(regexp_extract_all({c}, '(?i)(?:глав[A-Za-z0-9_]*|пункт|§|п\\.?[ \\t\\n\\r]*)[ \\t\\n\\r]*([0-9]+(?:\\.[0-9]+)*)', 1), lambda n: [n, n || '.', n || ' '])"
    d = f"list_transform(regexp_extract_all({c}, '(?i)(?:^|[^A-Za-z0-9_])([0-9]{{1,2}})[ \\t\\n\\r]*(?:раздел|глав)', 1), lambda n: [n, n || '.'])"
    return once(f"flatten([flatten({a}), flatten({b}), flatten({d})])")


def slug_of(c: str) -> str:
    several = {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya", "ъ": "", "ь": ""}
    out = f"lower({trim(c)})"
    for letter, latin in several.items():
        out = f"replace({out}, '{letter}', '{latin}')"
    out = f"translate({out}, 'абвгдеёзийклмнопрстуфхыэ _.', 'abvgdeeziyklmnoprstufhye---')"
    out = f"left(regexp_replace(regexp_replace(regexp_replace({out}, '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 48)"
    return f"coalesce(nullif({out}, ''), 'napravlenie')"


_SEGMENT = "^[a-zA-Z0-9._,\\-Ѐ-ӿ №()]+$"


def segment(c: str) -> str:
    own = f"regexp_replace(regexp_replace({trim(c)}, '{_S}+', ' ', 'g'), '\\.{{2,}}', '.', 'g')"
    return f"CASE WHEN {own} <> '' AND {own} NOT IN ('.', '..') AND regexp_matches({own}, '{_SEGMENT}') THEN {own} END"


def safe_name(c: str) -> str:
    own = f"regexp_replace(regexp_replace({trim(f'list_extract(string_split_regex({c}, chr(91) || chr(47) || chr(92) || chr(92) || chr(93)), -1)')}, '{_S}+', ' ', 'g'), '\\.{{2,}}', '.', 'g')"
    own = f"regexp_replace({own}, '[^a-zA-Z0-9._,\\-Ѐ-ӿ №()]', '_', 'g')"
    return f"CASE WHEN regexp_matches(lower({own}), '^.+\\.(pdf|doc|docx|jpeg|jpg|png|md|txt)$') THEN {own} END"


def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_S}+', ' ', 'g'), ' ')"


def cut(c: str, most: int) -> str:
    return f"CASE WHEN length({c}) <= {most} THEN {c} ELSE left({c}, {most - 1}) || '…' END"


def address(slug: str, folder: str) -> str:
    """The address of a folder: each part as a part of a URI, where !'()* may stand."""
    coded = "replace(replace(replace(replace(replace(url_encode(p), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
    return f"'#/' || array_to_string(list_transform(list_concat([{slug}], list_filter(string_split({folder}, '/'), lambda p: p <> '')), lambda p: {coded}), '/')"
