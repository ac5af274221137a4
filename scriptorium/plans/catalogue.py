"""All queries of the library's own operators over whole tables, each with its SQL where SQL
can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import catalog as C
from scriptorium.functions import jobs as J
from scriptorium.functions import paths as P
from scriptorium.functions import quality as Q
from scriptorium.functions import requests as R
from scriptorium.functions import text as T
from scriptorium.operators import ask as A
from scriptorium.operators import catalog as K
from scriptorium.operators import context as X
from scriptorium.operators import jobs as Jobs
from scriptorium.operators import library as L
from scriptorium.operators import search as S
from scriptorium.plans import sql as SQL
from scriptorium.sources import extract as E
from scriptorium.sources import tree as Tr
from scriptorium.session import shared_folder, spread
from scriptorium.sources.tables import distinct_pages, latest_meta, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

QUESTION = "Проверка заземляющего устройства"
NO_TERMS = "какие да"
BY_NAME = "акт"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = " ".join(sql.split()) if "'\n" not in sql else sql
        return f

    return add


# --- tables -----------------------------------------------------------------------------


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_documents")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The same for queries that work on every text: a small table is spread over all cores."""
    return spread(table(spark, d, "extracted_documents").select("entry_id", "text"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return L.current_files(table(spark, d, "library_files"))


def _meta(spark: SparkSession, d: str) -> DataFrame:
    """The extraction that holds, by (slug, path) as well."""
    meta = latest_meta(table(spark, d, "extraction_meta"), "extractor", "confidence", "chars", "source_pages", "indexed_pages", "index_status", "index_note")
    return _docs(spark, d).select("entry_id", "slug", "path").join(meta, "entry_id")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return distinct_pages(table(spark, d, "document_pages"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """The events table read as the log of indexing jobs, one job a user."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("signup", "queued"), ("click", "started"), ("view", "file_done"), ("error", "file_failed"), ("purchase", "finished")) for x in p]), F.col("event_type"))
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), "event_id", kind.alias("kind"))


# --- SQL fragments ----------------------------------------------------------------------

_SPACES, _META, _PAGES = SQL.SPACES, SQL.META, SQL.PAGES
_FILES = """(SELECT slug, path, f.name AS name, f.size AS size, f.kind AS kind, f.content_type AS content_type, f.has_text AS has_text, f.modified_at AS modified_at
  FROM (SELECT slug, path, max(struct_pack(modified_at := coalesce(modified_at, TIMESTAMP '0001-01-01'), name := coalesce(name, ''), kind := coalesce(kind, ''), size := coalesce(size, -1), content_type := coalesce(content_type, ''),
  has_text := coalesce(has_text, false))) AS f FROM library_files GROUP BY slug, path))"""


def _norm(c: str) -> str:
    return f"replace(lower({c}), 'ё', 'е')"


def _count(c: str, asked: list[str]) -> str:
    return " + ".join(f"CAST((length({c}) - length(replace({c}, '{t}', ''))) / {len(t)} AS INTEGER)" for t in asked) or "0"


def _any(c: str, asked: list[str]) -> str:
    return " OR ".join(f"contains({c}, '{t}')" for t in asked) or "true"


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_SPACES}+', ''), '{_SPACES}+$', '')"


def _name(c: str = "path") -> str:
    return f"list_extract(string_split({c}, '/'), -1)"


#: The terms of the questions, written out: the SQL does not ask the library for them.
_ASKED = {QUESTION: ["проверка", "заземляю", "устройст"], NO_TERMS: [], BY_NAME: ["акт"]}


def _text_hits(question: str, where: str = "", source: str = "extracted_documents") -> str:
    asked = _ASKED[question]
    return f"""SELECT slug, path, {_name()} AS name, CAST(2 + {_count(_norm('text'), asked)} AS DOUBLE) AS score FROM {source}
      WHERE text IS NOT NULL AND ({_any(_norm(_name() + " || ' ' || text"), asked)}) {where}"""


def _name_hits(question: str) -> str:
    return f"""SELECT slug, path, {_name()} AS name, 1.0::DOUBLE AS score FROM {_FILES} WHERE contains(lower({_name()}), '{question.lower()}')
      AND regexp_matches(lower({_name()}), '^.+\\.(pdf|doc|docx|jpeg|jpg|png|md|txt)$')"""


def _hits(question: str, limit: int = 12) -> str:
    return f"SELECT * FROM ({_text_hits(question)} UNION ALL {_name_hits(question)}) ORDER BY score DESC, name COLLATE ru, path, slug LIMIT {limit}"


_PLAIN = ["slug", "path", "name", "score"]

# --- search -----------------------------------------------------------------------------


@query(_hits(QUESTION))
def search_topk(spark, d):
    return S.search(_docs(spark, d), _files(spark, d), QUESTION).select(*_PLAIN)


@query(f"SELECT * FROM ({_hits(QUESTION)}) WHERE path = 'gost' OR starts_with(path, 'gost/')")
def search_scope_after_limit(spark, d):
    return S.in_scope(S.search(_docs(spark, d), _files(spark, d), QUESTION), "gost").select(*_PLAIN)


@query(f"SELECT slug, path, name, score FROM ({_text_hits(BY_NAME)} UNION ALL {_name_hits(BY_NAME)})")
def search_union_names(spark, d):
    """Every hit of a query by text and by name, both kept."""
    return S.search(_docs(spark, d), _files(spark, d), BY_NAME, limit=None).select(*_PLAIN)


@query(_hits(NO_TERMS, 40))
def search_no_terms(spark, d):
    return S.search(_docs(spark, d), _files(spark, d), NO_TERMS, 40).select(*_PLAIN)


@query(
    f"""SELECT h.slug, h.path, h.name, CASE WHEN m.index_status = 'partial' THEN h.score * 0.85 ELSE h.score END AS score FROM
    ({_text_hits(QUESTION, "AND regexp_matches(path, '\\.pdf$')", f"(SELECT slug, path, entry_id, nullif(left({_trim('text')}, 120000), '') AS text FROM extracted_documents)")}) h
    JOIN extracted_documents e USING (slug, path) LEFT JOIN {_META} m USING (entry_id)"""
)
def search_routed_partial_penalty(spark, d):
    docs = _docs(spark, d)
    routes = docs.filter(F.col("path").endswith(".pdf")).select("slug", "path")
    return S.routed_search(docs, routes, _meta(spark, d), QUESTION, limit=None).select(*_PLAIN)


_TERMS = _ASKED[QUESTION]


@query(
    f"""SELECT slug, path, coalesce(nullif(trim(regexp_replace(substr(text, greatest(p, 1), 220), '{_SPACES}+', ' ', 'g')), ''), 'Файл: ' || name) AS snippet FROM (
    SELECT slug, path, {_name()} AS name, text, coalesce(least({", ".join(f"nullif(instr({_norm('text')}, '{t}'), 0)" for t in _TERMS)}), 0) AS p
    FROM extracted_documents WHERE text IS NOT NULL AND ({_any(_norm(_name() + " || ' ' || text"), _TERMS)}))"""
)
def snippet_first_hit(spark, d):
    return S.text_hits(_docs(spark, d), QUESTION).select("slug", "path", "snippet")


@query(
    f"""SELECT query, count_if(hit) AS matched, CAST(coalesce(sum(CASE WHEN hit THEN n END), 0) AS BIGINT) AS occurrences FROM (SELECT query, len(terms) = 0 OR len(list_filter(terms, lambda t: contains(whole, t))) > 0 AS hit,
    coalesce(list_sum(list_transform(terms, lambda t: (length(normal) - length(replace(normal, t, ''))) // length(t))), 0) AS n FROM (SELECT query, {SQL.terms("query")} AS terms FROM (SELECT DISTINCT title AS query FROM directions WHERE title IS NOT NULL)),
    (SELECT {_norm("concat_ws(' ', name, text)")} AS whole, {_norm('text')} AS normal FROM extracted_documents WHERE text IS NOT NULL)) GROUP BY query"""
)
def multi_query_search(spark, d):
    """Each direction's title as a query over all texts."""
    return S.many(_docs(spark, d), table(spark, d, "directions").select(F.col("title").alias("query")))


@query(
    f"""SELECT h.slug, h.path, h.name, h.score FROM ({_hits(QUESTION, 200)}) h WHERE regexp_matches(lower({_name('h.path')}), 'gost|гост|(^|[^A-Za-z0-9_])sp[\\s_-]') AND NOT
    regexp_matches(lower({_name('h.path')}), 'классиф|classif|okof|окоф|окpd|^fz|фз|закон|kodex|кодекс')"""
)
def filter_doc_types_semi(spark, d):
    files = _files(spark, d)
    return S.of_types(S.search(_docs(spark, d), files, QUESTION, 200), K.infer(files), ["standard"]).select(*_PLAIN)


@query(f"SELECT * FROM ({_hits(QUESTION, 200)}) WHERE starts_with(path, 'gost/') OR contains(path, '/gost/') OR starts_with(path, 'паспорта/') OR contains(path, '/паспорта/')")
def filter_folders(spark, d):
    return S.in_folders(S.search(_docs(spark, d), _files(spark, d), QUESTION, 200), ["gost", "паспорта"]).select(*_PLAIN)


@query(
    f"""SELECT h.slug, h.path, h.score, length(left({_trim('e.text')}, 2000)) AS chars, m.extractor, m.confidence FROM ({_hits(QUESTION, 200)}) h
    JOIN extracted_documents e USING (slug, path) LEFT JOIN {_META} m USING (entry_id)"""
)
def hits_enrich_left_join(spark, d):
    hits = S.enriched(S.search(_docs(spark, d), _files(spark, d), QUESTION, 200), _docs(spark, d), _meta(spark, d))
    return hits.select("slug", "path", "score", F.length("text").alias("chars"), "extractor", "confidence")


@query(f"SELECT slug, path, {_name()} AS name, 1.0::DOUBLE AS score FROM {_FILES} WHERE starts_with(path, 'gost/') AND regexp_matches(lower({_name()}), '^.+\\.(pdf|doc|docx|jpeg|jpg|png|md|txt)$')")
def scope_fallback_union(spark, d):
    """A query without hits: all files of the scope stand in."""
    files = _files(spark, d)
    return S.with_fallback(S.in_scope(S.search(_docs(spark, d), files, "zzzzqqqq"), "gost"), L.indexable_files(files, "gost")).select(*_PLAIN)


NAMED = ["Protokol.PDF", "gost\\\\opis.pdf", "passport.docx"]


@query(f"SELECT * FROM ({_hits(QUESTION, 200)}) WHERE lower(name) IN ('protokol.pdf', 'passport.docx') OR path = 'gost/opis.pdf' OR lower(name) = 'gost/opis.pdf' OR lower(name) = (SELECT lower({_name('min(path)')}) FROM extracted_documents) OR path = (SELECT min(path) FROM extracted_documents)")
def filter_documents_named(spark, d):
    """Hits that any of some names or paths names, among them that of the first document."""
    first = _docs(spark, d).agg(F.min("path")).first()[0]
    wanted = NAMED + ([first, first.rsplit("/", 1)[-1]] if first else [])
    return S.named(S.search(_docs(spark, d), _files(spark, d), QUESTION, 200), wanted).select(*_PLAIN)


# --- catalog ----------------------------------------------------------------------------

_NAME = f"lower({_name()})"
_TYPE = f"""CASE WHEN regexp_matches({_NAME}, 'классиф|classif|okof|окоф|окpd') THEN 'classifier' WHEN regexp_matches({_NAME}, '^fz|фз|закон|kodex|кодекс') THEN 'law'
  WHEN regexp_matches({_NAME}, 'gost|гост|(^|[^A-Za-z0-9_])sp[\\s_-]|[A-Za-z0-9_]сп[\\s_-]') THEN 'standard' WHEN regexp_matches({_NAME}, 'tkp|ткp|typov') THEN 'tkp'
  WHEN regexp_matches({_NAME}, 'prikaz|приказ|postanov|постанов|pravil|правил|reglament|регламент') THEN 'regulation' WHEN regexp_matches({_NAME}, 'инструк|instruction') THEN 'instruction' ELSE 'other' END"""
_PRIORITY = "CASE doc_type WHEN 'classifier' THEN 5 WHEN 'law' THEN 10 WHEN 'standard' THEN 8 WHEN 'tkp' THEN 7 WHEN 'regulation' THEN 9 WHEN 'instruction' THEN 6 ELSE 1 END"
_ID = f"left(regexp_replace(regexp_replace(lower(regexp_replace({_name()}, '\\.[^.]+$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)"
_INDEXABLE = f"regexp_matches({_NAME}, '^.+\\.(pdf|doc|docx|jpeg|jpg|png|md|txt)$')"
_CATALOG = f"(SELECT slug, path, {_ID} AS doc_id, regexp_replace({_name()}, '\\.[^.]+$', '') AS title, {_TYPE} AS doc_type FROM {_FILES} WHERE {_INDEXABLE})"


@query(f"SELECT slug, path, doc_id, title, doc_type, {_PRIORITY} AS priority FROM {_CATALOG}")
def catalog_infer(spark, d):
    return K.infer(_files(spark, d)).select("slug", "path", "doc_id", "title", "doc_type", "priority")


_TOPICS = """CASE doc_type WHEN 'classifier' THEN 'код|классификатор|номенклатура' WHEN 'law' THEN 'закон|норма|требование|ответственность' WHEN 'standard' THEN 'стандарт|гост|сп|технические требования'
  WHEN 'tkp' THEN 'типовой проект|ткp|проектирование' WHEN 'regulation' THEN 'правила|приказ|регламент|порядок' WHEN 'instruction' THEN 'инструкция|процедура|безопасность' ELSE '' END"""
_ALIASES = f"""{_name()} || CASE doc_type WHEN 'classifier' THEN '|классификатор' WHEN 'law' THEN '|закон' WHEN 'standard' THEN '|гост|сп' WHEN 'tkp' THEN '|ткp' WHEN 'regulation' THEN '|правила' WHEN 'instruction' THEN '|инструкция' ELSE '' END"""


def _listed(*columns):
    return [F.array_join(c, "|").alias(c) for c in columns]


@query(f"SELECT slug, path, {_ALIASES} AS aliases, {_TOPICS} AS topics, '' AS \"references\" FROM {_CATALOG}")
def catalog_aliases_topics(spark, d):
    return K.infer(_files(spark, d)).select("slug", "path", *_listed("aliases", "topics", "references"))


@query(
    f"""SELECT c.slug, c.path, coalesce(nullif({_trim("s.title")}, ''), c.title) AS title, coalesce(s.doc_type, c.doc_type) AS doc_type, coalesce(s.n_chars % 5, {_PRIORITY.replace('doc_type', 'c.doc_type')}) AS priority,
    CASE WHEN s.doc_type IS NULL THEN {_TOPICS.replace('doc_type', 'c.doc_type')} ELSE s.doc_type END AS topics, {_ALIASES.replace('path', 'c.path').replace('doc_type', 'c.doc_type')} || coalesce('|' || s.title, '') AS aliases,
    coalesce(s.source, '') AS "references", coalesce(s.lang || '=' || s.source, '') AS hints FROM {_CATALOG} c LEFT JOIN (SELECT e.slug, e.path, d.title, d.doc_type, d.source, d.lang, d.n_chars FROM extracted_documents e JOIN documents d ON d.doc_id = e.entry_id) s USING (slug, path)"""
)
def catalog_merge(spark, d):
    """Catalog entries with what documents of the same number state as their stored entries."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c))).otherwise(F.array().cast("array<string>"))
    hints = F.when(F.col("lang").isNotNull() & F.col("source").isNotNull(), F.create_map("lang", "source"))
    stated = table(spark, d, "documents").select(
        F.col("doc_id").alias("entry_id"), "title", "doc_type", F.lit(None).cast("string").alias("doc_id"), one("doc_type").alias("topics"), one("title").alias("aliases"), one("source").alias("references"), hints.alias("sections_hint"), (F.col("n_chars") % 5).cast("int").alias("priority")
    )
    stored = _docs(spark, d).select("entry_id", "slug", "path").join(stated, "entry_id")
    shown = F.array_join(F.transform(F.map_entries("sections_hint"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("hints")
    return K.merge(K.infer(_files(spark, d)), stored).select("slug", "path", "title", "doc_type", "priority", *_listed("topics", "aliases", "references"), shown)


@query(f"SELECT slug, path, title, {_PRIORITY} AS priority, row_number() OVER (ORDER BY {_PRIORITY} DESC, title COLLATE ru, path, slug) AS place FROM {_CATALOG} WHERE starts_with(path, 'gost/')")
def catalog_scope_sorted(spark, d):
    """All entries of a scope, with their places in order."""
    own = K.in_order(K.infer(_files(spark, d), "gost")).select("slug", "path", "title", "priority")
    return L.with_place(own, F.desc("priority"), F.collate("title", "ru"), "path", "slug")


@query(f"SELECT DISTINCT c.slug, c.path FROM {_CATALOG} c JOIN documents t ON t.title IS NOT NULL AND (c.path = replace(t.title, '\\', '/') OR lower({_name('c.path')}) = lower(t.title || '.pdf'))")
def routing_theta_join(spark, d):
    """Entries named by any document's title, with the ending of a PDF."""
    wanted = table(spark, d, "documents").select(F.concat("title", F.lit(".pdf")).alias("wanted"))
    return K.routed(K.infer(_files(spark, d)), wanted)


# --- contexts ---------------------------------------------------------------------------

ASKED = T.boosted_terms(QUESTION, [])


def _long(spark, d):
    return _pages(spark, d)


@query(f"SELECT * FROM {SQL.narrow(2000)}")
def pages_narrow_budget(spark, d):
    return X.narrow(_long(spark, d), ASKED, 2000)


@query(f"SELECT * FROM {SQL.wide(3000)}")
def pages_wide_firstfit(spark, d):
    return X.wide(_long(spark, d), ASKED, 3000)


@query(f"SELECT * FROM {SQL.spread_out(4000)}")
def pages_spread_sample(spark, d):
    return X.spread_out(_long(spark, d), 4000)


@query(f"SELECT slug, entry_id, begin, finish FROM {SQL.islands()}")
def windows_islands(spark, d):
    return X.windows(_docs(spark, d), ASKED)


@query(f"SELECT * FROM {SQL.windowed(4000)}")
def windows_context(spark, d):
    return X.windowed(_docs(spark, d), ASKED, 4000)


@query(f"SELECT * FROM {SQL.built(4000)}")
def documents_context(spark, d):
    return X.build(_docs(spark, d), _pages(spark, d), QUESTION, 4000)


@query(f"SELECT * FROM {SQL.context_items(_hits(QUESTION), 4000, 4)}")
def context_items(spark, d):
    return X.for_query(_docs(spark, d), _files(spark, d), _pages(spark, d), _meta(spark, d), QUESTION, most=4000, limit=4, prefer_wide=False)


@query(f"SELECT entry_id, CAST(sum({_count(_norm('text'), _TERMS)}) AS BIGINT) AS occurrences, count(*) AS pages FROM {_PAGES} WHERE text IS NOT NULL GROUP BY entry_id")
def page_occurrences(spark, d):
    own = _pages(spark, d).filter(F.col("text").isNotNull())
    return own.groupBy("entry_id").agg(F.sum(T.occurrences(T.normalized(F.col("text")), ASKED)).alias("occurrences"), F.count("*").alias("pages"))


# --- quality and index ------------------------------------------------------------------


@query(
    f"""SELECT entry_id, coalesce(len(regexp_extract_all(text, '[А-Яа-яЁё]')), 0) AS cyrillic, coalesce(len(regexp_extract_all(text, '[А-Яа-яЁё]{{4,}}')), 0) AS words, coalesce(length(text), 0) AS chars FROM extracted_documents"""
)
def cyrillic_counts(spark, d):
    return _docs(spark, d).select("entry_id", T.cyrillic_letters(F.col("text")).alias("cyrillic"), T.cyrillic_words(F.col("text")).alias("words"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))


@query(f"SELECT entry_id, coalesce({SQL.heavy('p')}, false) AS contents FROM {SQL.JUDGED}")
def toc_heavy(spark, d):
    """Which texts are tables of contents, by their pages."""
    own = _texts(spark, d).join(_meta(spark, d).select("entry_id", F.coalesce("source_pages", F.lit(0)).alias("n")), "entry_id", "left")
    return own.select("entry_id", F.coalesce(Q.contents_heavy(F.col("text"), F.coalesce("n", F.lit(0))), F.lit(False)).alias("contents"))


@query(f"SELECT entry_id, {SQL.usable('p')} AS usable, {SQL.wanting('p')} AS recognise, {SQL.poor('p')} AS poor FROM {SQL.JUDGED}")
def usable_text_layer(spark, d):
    own = _texts(spark, d).join(_meta(spark, d).select("entry_id", F.coalesce("source_pages", F.lit(0)).alias("n")), "entry_id", "left")
    judged = own.select("entry_id", Q.judged(F.col("text"), F.coalesce("n", F.lit(0))).alias("j"))
    return judged.select("entry_id", "j.usable", "j.recognise", "j.poor")


@query(SQL.QUALITY_SCORE)
def text_quality_score(spark, d):
    own = _texts(spark, d).join(_meta(spark, d).select("entry_id", "source_pages"), "entry_id", "left")
    return own.select("entry_id", F.round(Q.extraction_score(F.col("text"), F.coalesce("source_pages", F.lit(0))), 6).alias("score"))


@query(SQL.LAYER_ARGMAX)
def text_layer_argmax(spark, d):
    """Of an entry's text and its pages' texts joined, the better layer; the first on a tie."""
    joined = _pages(spark, d).groupBy("entry_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))
    both = _texts(spark, d).select("entry_id", F.lit(0).alias("layer"), "text").unionByName(joined.select("entry_id", F.lit(1).alias("layer"), "text"))
    best = both.groupBy("entry_id").agg(F.max(F.struct(F.coalesce(Q.layer_score(F.col("text"), F.lit(0)), F.lit(-1)).alias("score"), (-F.col("layer")).alias("o"))).alias("b"))
    return best.select("entry_id", (-F.col("b.o")).alias("layer"), "b.score")


@query(SQL.PHOTO_QUALITY)
def photo_text_quality(spark, d):
    own = spread(_pages(spark, d).select("page_id", "text"))
    own = own.select("page_id", Q.photo_judged(F.col("text")).alias("j"), Q.attachment_usable(F.col("text"), F.lit(False)).alias("as_document"))
    return own.select("page_id", F.round("j.score", 6).alias("score"), "j.usable", "as_document")


@query(SQL.INDEX_STATUS)
def index_status(spark, d):
    n = _pages(spark, d).filter(F.length("text") > 0).groupBy("entry_id").agg(F.count("*").alias("n"))
    own = _texts(spark, d).join(_meta(spark, d).select("entry_id", "extractor", "source_pages"), "entry_id", "left").join(n, "entry_id", "left")
    info = Q.index_status(F.col("text"), F.coalesce("extractor", F.lit("")), F.col("n"), F.coalesce("source_pages", F.lit(0)))
    return own.select("entry_id", info.alias("i")).select("entry_id", "i.*")


_OCR = "coalesce(m.extractor, '') = 'tesseract-ocr'"
_IDX = "coalesce(n.n, m.indexed_pages, 0)"


@query(
    f"""SELECT m.entry_id, CASE WHEN m.index_status IN ('ready', 'partial') THEN m.index_status WHEN NOT ends_with(lower(e.path), '.pdf') THEN 'ready'
    WHEN NOT {_OCR} AND m.index_status IS NULL AND coalesce(m.chars, 0) >= 120 AND (coalesce(m.source_pages, 0) <= 1 OR coalesce(m.chars, 0) / greatest(coalesce(m.source_pages, 0), 1) >= 300) THEN 'ready'
    WHEN NOT {_OCR} THEN 'partial' WHEN coalesce(m.source_pages, 0) > 0 AND {_IDX} > 0 AND {_IDX} < m.source_pages THEN 'partial'
    WHEN n.n IS NULL AND m.indexed_pages IS NULL THEN 'partial' ELSE 'ready' END AS text_index_status
    FROM {_META} m JOIN extracted_documents e USING (entry_id) LEFT JOIN (SELECT entry_id, count(*) AS n FROM {_PAGES} GROUP BY entry_id) n USING (entry_id)"""
)
def index_display(spark, d):
    n = _pages(spark, d).groupBy("entry_id").agg(F.count("*").cast("int").alias("n"))
    own = _meta(spark, d).join(n, "entry_id", "left")
    shown = Q.index_display(F.lit(True), F.col("index_status"), F.col("index_note"), F.lower("path").endswith(".pdf"), F.col("extractor"), F.col("chars"), F.col("source_pages"), F.col("indexed_pages"), F.col("n"))
    return own.select("entry_id", shown["text_index_status"].alias("text_index_status"))


@query(
    f"""SELECT slug, count(*) AS processed, count_if(chars > 0) AS updated, count_if(text IS NULL) AS failed FROM
    (SELECT slug, text, coalesce(length(text), 0) AS chars FROM extracted_documents) GROUP BY slug"""
)
def reindex_counts(spark, d):
    results = _docs(spark, d).select("slug", F.col("text").isNotNull().alias("ok"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return L.reindex_counts(results, "slug")


@query(f"SELECT entry_id, extractor, confidence, CAST(chars AS DOUBLE) AS chars FROM {_META}")
def latest_extraction(spark, d):
    return _meta(spark, d).select("entry_id", "extractor", "confidence", F.col("chars").cast("double").alias("chars"))


@query(f"SELECT slug, path, name, CAST(nullif(size, -1) AS DOUBLE) AS size, modified_at FROM {_FILES}")
def current_file_states(spark, d):
    return _files(spark, d).select("slug", "path", "name", F.col("size").cast("double").alias("size"), "modified_at")


@query(
    f"""SELECT f.slug, f.path, e.entry_id IS NOT NULL AND m.entry_id IS NOT NULL AS has_text, CASE WHEN e.entry_id IS NULL OR m.entry_id IS NULL THEN 'none' ELSE coalesce(m.index_status, 'ready') END AS text_index_status
    FROM {_FILES} f LEFT JOIN extracted_documents e USING (slug, path) LEFT JOIN {_META} m USING (entry_id)"""
)
def file_status_join(spark, d):
    return L.with_status(_files(spark, d), _meta(spark, d)).select("slug", "path", "has_text", "text_index_status")


# --- texts and names --------------------------------------------------------------------

_KEPT = SQL.KEPT


@query(f"SELECT page_id, regexp_replace(text, '{_KEPT}', '', 'g') AS text FROM {_PAGES}")
def sanitize_text(spark, d):
    return _pages(spark, d).select("page_id", T.sanitized(F.col("text")).alias("text"))


@query(f"SELECT entry_id, nullif(left(trim(regexp_replace(regexp_replace(text, '{_KEPT}', '', 'g'), '[\\t\\n\\r ]+', ' ', 'g')), 120000), '') AS text FROM extracted_documents")
def normalize_text(spark, d):
    return _docs(spark, d).select("entry_id", T.extracted_text(F.col("text")).alias("text"))


@query(SQL.PHOTO_TEXT)
def photo_text(spark, d):
    return _pages(spark, d).select("page_id", T.photo_text(F.col("text")).alias("text"))


@query("SELECT entry_id, nullif(array_to_string(regexp_extract_all(text, '[ -~]{12,}'), ' '), '') AS runs FROM extracted_documents")
def doc_runs_extract(spark, d):
    """Readable runs of the texts' bytes, as in a legacy document."""
    return _docs(spark, d).select("entry_id", T.latin_runs(F.col("text").cast("binary")).alias("runs"))


@query(f"SELECT slug, {SQL.slug_of('title')} AS made FROM directions")
def slugify_titles(spark, d):
    return table(spark, d, "directions").select("slug", P.slug_of(F.col("title")).alias("made"))


@query(
    f"""SELECT slug, CASE WHEN NOT list_contains(taken, base) THEN base ELSE list_filter(list_transform(range(2, 1000), lambda n: base || '-' || n), lambda x: NOT list_contains(taken, x))[1] END AS free
    FROM (SELECT slug, {SQL.slug_of("coalesce(title, '')")} AS base, (SELECT list(slug) FROM directions) AS taken FROM directions)"""
)
def unique_slug(spark, d):
    """A free slug for each direction's title among all slugs. The slugs are a row that is joined;
    whether it is broadcast is left to its size."""
    own = table(spark, d, "directions")
    taken = own.agg(F.collect_set("slug").alias("taken")).withColumn("one", F.lit(1))
    return own.withColumn("one", F.lit(1)).join(taken, "one").select("slug", P.unique_slug(F.coalesce("title", F.lit("")), F.col("taken")).alias("free"))


@query(f"SELECT doc_id, array_to_string({SQL.terms('title')}, '|') AS terms, array_to_string({SQL.sections('title')}, '|') AS sections FROM (SELECT doc_id, coalesce(title, '') AS title FROM documents)")
def terms_of_titles(spark, d):
    """Search terms and section numbers of each document's title."""
    own = table(spark, d, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("title"))
    return own.select("doc_id", F.array_join(T.terms(F.col("title")), "|").alias("terms"), F.array_join(T.section_terms_column(F.col("title")), "|").alias("sections"))


@query(f"SELECT path, slug, regexp_matches(path, '^[^/\\\\]') AND len(list_filter(string_split_regex(path, '[/\\\\]'), lambda p: p <> '' AND (p IN ('.', '..') OR NOT regexp_matches(p, '^[a-zA-Z0-9._,\\-Ѐ-ӿ №()]+$')))) = 0 AS valid FROM {_FILES}")
def valid_paths(spark, d):
    return _files(spark, d).select("path", "slug", P.valid_path(F.col("path")).alias("valid"))


@query(f"SELECT slug, path, {SQL.safe_name('name')} AS safe, {SQL.segment('name')} AS segment FROM (SELECT slug, path, nullif(name, '') AS name FROM {_FILES})")
def safe_names(spark, d):
    return _files(spark, d).select("slug", "path", P.safe_name(F.col("name")).alias("safe"), P.segment(F.col("name")).alias("segment"))


@query(
    f"""SELECT slug, path, CASE WHEN ends_with({_NAME}, '.pdf') THEN 'application/pdf' WHEN ends_with({_NAME}, '.doc') THEN 'application/msword'
    WHEN ends_with({_NAME}, '.docx') THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN ends_with({_NAME}, '.jpeg') OR ends_with({_NAME}, '.jpg') THEN 'image/jpeg'
    WHEN ends_with({_NAME}, '.png') THEN 'image/png' WHEN ends_with({_NAME}, '.md') THEN 'text/markdown; charset=utf-8' WHEN ends_with({_NAME}, '.txt') THEN 'text/plain; charset=utf-8' ELSE 'application/octet-stream' END AS content_type,
    CASE WHEN ends_with({_NAME}, '.pdf') THEN 'PDF' WHEN ends_with({_NAME}, '.docx') OR ends_with({_NAME}, '.doc') THEN 'Word' WHEN ends_with({_NAME}, '.txt') OR ends_with({_NAME}, '.md') THEN 'Текст'
    WHEN regexp_matches({_NAME}, '\\.(jpe?g|png)$') THEN 'OCR фото' ELSE 'Индексация' END AS label,
    CASE WHEN size < 0 THEN NULL WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{{:.1f}} KB', size / 1024.0) ELSE format('{{:.1f}} MB', size / 1048576.0) END AS shown,
    CASE WHEN ends_with({_NAME}, '.pdf') THEN 'Текстовый PDF индексируется за секунды. Полный OCR (↻ с force) — только для сканов без текста.' WHEN regexp_matches({_NAME}, '\\.(docx?|txt|md)$') THEN 'Word и текстовые файлы индексируются за секунды — OCR не нужен.' END AS hint,
    CASE WHEN regexp_matches({_NAME}, '\\.(jpe?g|png)$') THEN 'фото' WHEN ends_with({_NAME}, '.pdf') THEN 'PDF' WHEN regexp_matches({_NAME}, '\\.docx?$') THEN 'Word' WHEN regexp_matches({_NAME}, '\\.(txt|md)$') THEN 'текст' ELSE 'файл' END AS kind,
    CASE WHEN modified_at > TIMESTAMP '0001-01-02' THEN strftime(modified_at, '%d.%m.%Y') ELSE '—' END AS day,
    CASE WHEN size < 0 THEN 'оценка…' WHEN size = 0 THEN 'скоро' WHEN size < 60 THEN size || ' сек' WHEN size % 60 > 0 THEN (size // 60) || ' мин ' || (size % 60) || ' сек' ELSE (size // 60) || ' мин' END AS lasting FROM {_FILES}"""
)
def file_labels(spark, d):
    """How files are shown; the size read as seconds too, for the form of a duration."""
    path, size = F.col("path"), F.col("size")
    return _files(spark, d).select(
        "slug", "path", P.content_type(path).alias("content_type"), J.action_label(path).alias("label"), J.byte_size(size).alias("shown"), J.action_hint(path).alias("hint"), J.attachment_label(path).alias("kind"), J.date(F.col("modified_at")).alias("day"), J.duration(size).alias("lasting")
    )


_CLIP = f"(SELECT doc_id, {SQL.cut(SQL.squeezed('text'), 280)} AS clip, {SQL.cut(SQL.trim("replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"), 4000)} AS message FROM documents)"


@query(
    f"""SELECT doc_id, clip, message, CASE WHEN spot > 0 THEN left(clip, spot - 1) ELSE clip END AS before, CASE WHEN spot > 0 THEN substr(clip, spot, 7) END AS hit, CASE WHEN spot > 0 THEN substr(clip, spot + 7) END AS after
    FROM (SELECT *, instr(lower(clip), 'порядок') AS spot FROM {_CLIP})"""
)
def formatted_texts(spark, d):
    own = table(spark, d, "documents").select("doc_id", T.clipped(F.col("text")).alias("clip"), T.truncated(T.escape_html(F.col("text"))).alias("message"))
    return own.select("doc_id", "clip", "message", T.highlighted(F.col("clip"), F.lit("порядок")).alias("marked")).select("doc_id", "clip", "message", "marked.*")


@query(
    f"""SELECT slug, path, {SQL.address('slug', 'folder')} AS address, 'direction' AS "view", folder FROM (SELECT slug, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder FROM {_FILES})"""
)
def routes(spark, d):
    own = _files(spark, d).select("slug", "path", J.route(F.col("slug"), P.parent(F.col("path"))).alias("address"))
    return own.select("slug", "path", "address", J.parsed_route(F.col("address")).alias("parsed")).select("slug", "path", "address", "parsed.view", F.col("parsed.path").alias("folder"))


# --- directions, folders, changes -------------------------------------------------------


@query(f"SELECT slug, coalesce(nullif({_trim('title')}, ''), slug) AS title, coalesce(created_at, TIMESTAMP '1970-01-01') AS created_at FROM directions WHERE regexp_matches(slug, '^[a-z0-9][a-z0-9-]*$')")
def directions_list(spark, d):
    return L.directions(table(spark, d, "directions"))


@query(
    f"""SELECT slug, folder AS path, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') ELSE '' END AS parent, len(string_split(folder, '/')) AS depth, {_name('folder')} AS name, count(*) AS files
    FROM (SELECT slug, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS folder FROM {_FILES}) GROUP BY slug, folder"""
)
def folder_tree(spark, d):
    return L.folders(_files(spark, d))


@query(
    f"""SELECT DISTINCT slug, CASE WHEN contains(substr(path, 6), '/') THEN 'folder' ELSE 'file' END AS kind, 'gost/' || split_part(substr(path, 6), '/', 1) AS path, split_part(substr(path, 6), '/', 1) AS name
    FROM {_FILES} WHERE starts_with(path, 'gost/')"""
)
def directory_listing(spark, d):
    return L.listing(_files(spark, d), "gost")


@query(
    f"""WITH shown AS (SELECT DISTINCT slug, CASE WHEN contains(path, '/') THEN 'folder' ELSE 'file' END AS kind, split_part(path, '/', 1) AS name FROM {_FILES})
    SELECT slug, coalesce(nullif({_trim('title')}, ''), slug) AS title, '' AS path, coalesce(folders, '') AS folders, coalesce(files, '') AS files FROM directions
    LEFT JOIN (SELECT slug, string_agg(name, '|' ORDER BY name COLLATE ru, name) FILTER (kind = 'folder') AS folders, string_agg(name, '|' ORDER BY name COLLATE ru, name) FILTER (kind = 'file') AS files FROM shown GROUP BY slug) USING (slug)
    WHERE regexp_matches(slug, '^[a-z0-9][a-z0-9-]*$')"""
)
def folder_view(spark, d):
    own = L.folder_view(table(spark, d, "directions"), _files(spark, d), "")
    names = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["name"]), "|"), F.lit("")).alias(c)
    return own.select("slug", "title", "path", names("folders"), names("files"))


@query(f"SELECT slug, CASE WHEN slug = 'electro' AND starts_with(path, 'gost/') THEN 'standards' || substr(path, 5) ELSE path END AS path FROM {_FILES}")
def rename_folder(spark, d):
    """A folder of one direction renamed."""
    return L.rename_folder(_files(spark, d), "electro", "gost", "standards").select("slug", "path")


@query(f"SELECT slug, path FROM {_FILES} WHERE NOT (slug = 'electro' AND (path = 'gost' OR starts_with(path, 'gost/')))")
def delete_folder(spark, d):
    return L.delete_folder(_files(spark, d), "electro", "gost", recursive=True).select("slug", "path")


@query(f"SELECT entry_id, e.slug, e.path, length(left({_trim('e.text')}, 120000)) AS chars, m.extractor FROM extracted_documents e LEFT JOIN {_META} m USING (entry_id) WHERE length({_trim('e.text')}) > 0")
def corpus_export(spark, d):
    meta = _meta(spark, d).select("entry_id", "extractor")
    return L.corpus(_docs(spark, d), meta).select("entry_id", "slug", "path", F.length("text").alias("chars"), "extractor")


@query("SELECT slug, 'Раздел ' || slug AS title, created_at FROM directions WHERE slug IN ('electro', 'osmos') UNION ALL SELECT slug, title, created_at FROM directions WHERE slug NOT IN ('electro', 'osmos')")
def upsert_directions(spark, d):
    own = table(spark, d, "directions")
    changes = own.filter(F.col("slug").isin("electro", "osmos")).withColumn("title", F.concat(F.lit("Раздел "), F.col("slug")))
    return L.upsert(own, changes, ["slug"])


@query(
    "SELECT slug, CASE WHEN r < 12 THEN [32, 168, 210, 278, 12, 145, 95, 48, 320, 185, 220, 55][r + 1] ELSE (r * 137) % 360 END AS hue FROM (SELECT slug, CAST(row_number() OVER (ORDER BY slug COLLATE ru) - 1 AS INTEGER) AS r FROM (SELECT DISTINCT slug FROM directions))"
)
def direction_hues(spark, d):
    """Hues by rank among all slugs, a fixed small table."""
    rank = F.dense_rank().over(W.orderBy(F.collate("slug", "ru"))) - 1
    return table(spark, d, "directions").select("slug").distinct().select("slug", J.hue_of_rank(rank).alias("hue"))


# --- conversations ----------------------------------------------------------------------

_TALK = "(SELECT coalesce(source, '') AS conv_id, doc_id AS turn, CASE WHEN doc_id % 3 = 0 THEN 'assistant' WHEN doc_id % 7 = 0 THEN 'system' ELSE 'user' END AS role, text AS content FROM documents)"


def _talk(spark, d):
    """Documents read as messages: a source is a conversation, documents are its turns."""
    role = F.when(F.col("doc_id") % 3 == 0, "assistant").when(F.col("doc_id") % 7 == 0, "system").otherwise("user")
    return table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("conv_id"), F.col("doc_id").alias("turn"), role.alias("role"), F.col("text").alias("content"))


@query(
    f"""SELECT conv_id, turn, role, left(content, 4000) AS content FROM (SELECT conv_id, turn, role, {_trim('content')} AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM {_TALK}
    WHERE role IN ('user', 'assistant') AND length({_trim('content')}) > 0) WHERE rn <= 8"""
)
def history_last8(spark, d):
    return A.history(_talk(spark, d))


@query(f"SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM {_TALK}) WHERE rn <= 40")
def chat_last40(spark, d):
    return A.last(_talk(spark, d), 40).select("conv_id", "turn", "role")


@query(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN role = 'assistant' AND turn % 5 = 0 THEN turn END) OVER (PARTITION BY conv_id) AS upto FROM {_TALK}) WHERE turn <= upto")
def history_prefix_pending(spark, d):
    own = _talk(spark, d).withColumn("pending", (F.col("role") == "assistant") & (F.col("turn") % 5 == 0))
    return A.pending(own).select("conv_id", "turn")


_EXPAND = f"^(да|покажи|показать|подробнее|разверни|открой|выведи)({SQL.SPACES}+(полный|подробный))?({SQL.SPACES}+ответ|{SQL.SPACES}+текст)?[.!?]*$"


@query(
    f"""SELECT conv_id, turn, CASE WHEN starts_with(t, '/') THEN 'command' WHEN coalesce(x, false) THEN 'expand' WHEN length(t) >= 3 THEN 'ask' ELSE 'ignore' END AS action, coalesce(x, false) AS expand
    FROM (SELECT *, regexp_matches(lower(t), '{_EXPAND}') AS x FROM (SELECT conv_id, turn, {_trim('content')} AS t FROM {_TALK}))"""
)
def expand_requests(spark, d):
    """What each message would do, each text being the message."""
    own = _talk(spark, d).withColumns({"mode": F.lit("idle"), "has_pending": F.lit(True), "slug": F.lit("electro")})
    return A.routed(own).select("conv_id", "turn", "action", A.asks_to_expand(F.col("content")).alias("expand"))


_BLOCKS = f"""(SELECT string_agg('[' || rank || '] ' || name || ' (' || path || ')' || CASE WHEN extractor IS NULL THEN '' ELSE ' [extractor=' || extractor || ', confidence=' || format('{{:.2f}}', coalesce(confidence, 0.0::DOUBLE)) || ']' END || chr(10) || text,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) FROM {SQL.context_items(_hits(QUESTION), 4000, 4)})"""
_PAST = f"""(SELECT turn, role, left(content, 4000) AS content FROM (SELECT turn, role, {_trim('content')} AS content, row_number() OVER (ORDER BY turn DESC) AS rn FROM {_TALK} WHERE conv_id = 'portal_export' AND role IN ('user', 'assistant') AND length({_trim('content')}) > 0) WHERE rn <= 8)"""


@query(
    f"""SELECT 0 AS place, 'system' AS role, 'Отвечай по документам.' AS content UNION ALL SELECT CAST(row_number() OVER (ORDER BY turn) AS INTEGER) AS place, role, content FROM {_PAST} UNION ALL
    SELECT CAST((SELECT count(*) FROM {_PAST}) + 1 AS INTEGER) AS place, 'user' AS role, '{QUESTION}' || chr(10) || chr(10) || 'вложение' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {_BLOCKS} AS content"""
)
def ask_messages(spark, d):
    """The messages a model is given, one row each: with the past of one conversation."""
    items = QUERIES["context_items"](spark, d)
    past = _talk(spark, d).filter("conv_id = 'portal_export'")
    whole = A.messages(A.context_text(items), "Отвечай по документам.", QUESTION, past, " вложение ")
    return whole.select(F.posexplode("messages").alias("place", "m")).select("place", "m.role", "m.content")


# --- jobs -------------------------------------------------------------------------------

_LOG = "(SELECT user_id AS job_id, ts AS at, event_id, event_type AS k, (ts, event_id) AS t FROM events)"
_FOLD = f"""(WITH q AS (SELECT job_id, min(t) AS q FROM {_LOG} WHERE k = 'signup' GROUP BY job_id), s AS (SELECT job_id, min(t) AS s FROM {_LOG} JOIN q USING (job_id) WHERE k = 'click' AND t > q GROUP BY job_id),
  e AS (SELECT job_id, min(t) AS e FROM {_LOG} JOIN s USING (job_id) WHERE k = 'purchase' AND t > s GROUP BY job_id),
  c AS (SELECT job_id, count_if(k = 'view') AS processed, count_if(k = 'error') AS failed FROM {_LOG} JOIN s USING (job_id) LEFT JOIN e USING (job_id) WHERE k IN ('view', 'error') AND t > s AND (e IS NULL OR t < e) GROUP BY job_id)
  SELECT job_id, CASE WHEN e IS NOT NULL THEN 'done' WHEN s IS NOT NULL THEN 'running' ELSE 'queued' END AS status, q[1] AS queued_at, s[1] AS started_at, e[1] AS ended_at, coalesce(processed, 0) AS processed, coalesce(failed, 0) AS failed
  FROM q LEFT JOIN s USING (job_id) LEFT JOIN e USING (job_id) LEFT JOIN c USING (job_id))"""


@query(f"SELECT * FROM {_FOLD}")
def job_state_fold(spark, d):
    return Jobs.fold(_jobs(spark, d))


@query(f"SELECT job_id, status, started_at FROM {_FOLD} ORDER BY started_at DESC NULLS LAST, job_id DESC LIMIT 40")
def jobs_prune_40(spark, d):
    return Jobs.pruned(Jobs.fold(_jobs(spark, d))).select("job_id", "status", "started_at")


_QUEUE = "(SELECT slug, path AS job_id, modified_at AS queued_at, CASE WHEN has_text THEN 'running' ELSE 'queued' END AS status FROM " + _FILES + ")"


@query(
    f"""SELECT slug, job_id, queue_position FROM (SELECT slug, job_id, status, CAST(sum(CASE WHEN status = 'running' THEN 1 ELSE 0 END) OVER (PARTITION BY slug)
    + sum(CASE WHEN status = 'queued' THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY queued_at, job_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS queue_position FROM {_QUEUE}) WHERE status = 'queued'"""
)
def queue_positions(spark, d):
    """Files with text read as running jobs of their direction, the others as its queue."""
    own = _files(spark, d).select("slug", F.col("path").alias("job_id"), F.coalesce("modified_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("queued_at"), F.when(F.coalesce("has_text", F.lit(False)), "running").otherwise("queued").alias("status"))
    return Jobs.queue(own, "slug").select("slug", "job_id", "queue_position")


@query(
    f"""SELECT slug, job_id FROM (SELECT slug, job_id, row_number() OVER (PARTITION BY slug ORDER BY queued_at, job_id) + coalesce(r, 0) AS place FROM {_QUEUE} LEFT JOIN (SELECT slug, count(*) AS r FROM {_QUEUE} WHERE status = 'running' AND length(job_id) % 8 = 0 GROUP BY slug) USING (slug) WHERE status = 'queued') WHERE place <= 9"""
)
def jobs_startable(spark, d):
    """The jobs of a direction's queue that may start while nine run at most; of the files with text those with paths of some lengths are read as running."""
    own = _files(spark, d).select("slug", F.col("path").alias("job_id"), F.coalesce("modified_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("queued_at"), F.coalesce("has_text", F.lit(False)).alias("text"))
    status = F.when(F.col("text"), F.when(F.length("job_id") % 8 == 0, "running").otherwise("done")).otherwise("queued")
    return Jobs.startable(own.withColumn("status", status), 9, "slug").select("slug", "job_id")


_NOW = 1_740_000_000_000


def _progress(spark, d):
    own = _files(spark, d).withColumn("size", F.coalesce("size", F.lit(0)))
    ms = F.coalesce(F.unix_millis(F.col("modified_at").cast("timestamp")), F.lit(_NOW))
    return own.select(
        "slug", F.col("path").alias("job_id"), F.lit("running").alias("status"), F.lit("indexing").alias("phase"), (F.col("size") % 7).cast("int").alias("processed"), F.lit(8).alias("total"), F.col("name").alias("current_file"),
        F.lit(None).cast("int").alias("ocr_page"), F.lit(None).cast("int").alias("ocr_page_total"), ms.alias("started_ms"), (F.lit(_NOW) - F.col("size") % 900_000).alias("file_started_ms"),
    )


@query(
    f"""WITH j AS (SELECT slug, path AS job_id, greatest(size, 0) % 7 AS processed, CASE WHEN modified_at > TIMESTAMP '0001-01-02' THEN epoch_ms(modified_at) ELSE {_NOW} END AS started, greatest(size, 0) % 900000 AS elapsed, CASE WHEN ends_with({_NAME}, '.pdf') THEN 900000.0 ELSE 30000.0 END AS est, name FROM {_FILES}),
    w AS (SELECT *, CASE WHEN name = '' THEN 0::DOUBLE WHEN elapsed <= 0 THEN 0.03::DOUBLE WHEN elapsed < est THEN 0.03::DOUBLE + elapsed / est * 0.89::DOUBLE ELSE least(0.99::DOUBLE, 0.92::DOUBLE + least(1.0::DOUBLE, (elapsed - est) / (est * 4)) * 0.07::DOUBLE) END AS w FROM j)
    SELECT slug, job_id, CAST(CASE WHEN name = '' THEN floor(100.0::DOUBLE * processed / 8 + 0.5) ELSE least(99, greatest(1, floor(100.0::DOUBLE * (processed + w) / 8 + 0.5))) END AS INTEGER) AS percent, CAST(greatest(0, floor(({_NOW} - started) / 1000.0::DOUBLE + 0.5)) AS BIGINT) AS elapsed_seconds,
    CAST(CASE WHEN processed + w > 0 THEN greatest(0, floor(({_NOW} - started) / (processed + w) * (8 - (processed + w)) / 1000 + 0.5)) ELSE floor(8 * est / 1000 + 0.5) END AS BIGINT) AS eta_seconds FROM w"""
)
def job_percent_eta(spark, d):
    """Files read as jobs of eight files, at a fixed time."""
    return Jobs.snapshot(_progress(spark, d), F.lit(_NOW)).select("slug", "job_id", "percent", "elapsed_seconds", "eta_seconds")


@query(f"SELECT slug, CAST(sum(CASE WHEN contains(path, '/') THEN 1 ELSE 0 END) AS BIGINT) AS nested, count_if(path = 'gost' OR starts_with(path, 'gost@batch') OR starts_with(path, 'gost/') OR starts_with('gost', path || '/')) AS concerned FROM {_FILES} GROUP BY slug")
def jobs_of_scope(spark, d):
    """Files read as jobs' scopes: how many concern a folder."""
    own = _files(spark, d)
    return own.groupBy("slug").agg(F.sum(F.when(F.col("path").contains("/"), 1).otherwise(0)).alias("nested"), F.count_if(J.matches_scope(F.col("path"), F.lit("gost"))).alias("concerned"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_rollup(spark, d):
    """Events per day and kind (an extension; the library's own log has no windows)."""
    return Jobs.rollup(table(spark, d, "events"), "ts", "1 day", "event_type").withColumn("value", F.round("value", 4))


# --- requests, sessions, further changes ------------------------------------------------


@query(
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda x: {_trim('x')}), lambda x: x <> ''), '|') AS listed,
    CAST(CASE WHEN n IS NULL THEN 20000 ELSE greatest(2000, least(120000, n)) END AS INTEGER) AS context_chars, CAST(CASE WHEN n IS NULL THEN 120000 ELSE greatest(1000, least(200000, n)) END AS INTEGER) AS extracted_chars
    FROM (SELECT doc_id, text, TRY_CAST(nullif(regexp_extract({_trim("concat(n_chars, lang)")}, '^([+-]?[0-9]{{1,15}})', 1), '') AS BIGINT) AS n FROM documents)"""
)
def request_values(spark, d):
    """Each text read as a list with commas, each length (with its language behind it) as a limit."""
    own = table(spark, d, "documents").withColumn("asked", F.concat(F.coalesce(F.col("n_chars").cast("string"), F.lit("")), F.coalesce("lang", F.lit(""))))
    asked = F.col("asked")
    return own.select("doc_id", F.array_join(R.listed(F.col("text")), "|").alias("listed"), R.limited(asked, R.CONTEXT_CHARS).alias("context_chars"), R.limited(asked, R.EXTRACTED_CHARS).alias("extracted_chars"))


@query(
    f"""SELECT f.slug, path, CASE WHEN folder = '' THEN coalesce(nullif(title, ''), f.slug) || ' (все папки)' ELSE coalesce(nullif(title, ''), f.slug) || ' → ' || {_name('folder')} END AS label
    FROM (SELECT slug, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder FROM {_FILES}) f LEFT JOIN directions USING (slug)"""
)
def session_labels(spark, d):
    own = _files(spark, d).select("slug", "path", P.parent(F.col("path")).alias("scope")).join(table(spark, d, "directions").select("slug", "title"), "slug", "left")
    return own.select("slug", "path", R.session_label(F.col("slug"), F.col("title"), F.col("scope")).alias("label"))


@query(
    """SELECT wanted, coalesce(min(a.slug), min(b.slug)) AS slug FROM (SELECT slug AS wanted FROM directions UNION SELECT upper(title) FROM directions WHERE title IS NOT NULL UNION SELECT title FROM documents WHERE title IS NOT NULL) w
    LEFT JOIN directions a ON a.slug = wanted LEFT JOIN directions b ON lower(b.title) = lower(wanted) GROUP BY wanted HAVING coalesce(min(a.slug), min(b.slug)) IS NOT NULL"""
)
def direction_lookup(spark, d):
    """Directions named by their slugs, their titles in capitals and documents' titles."""
    own = table(spark, d, "directions")
    wanted = own.select(F.col("slug").alias("wanted")).unionByName(own.select(F.upper("title").alias("wanted"))).unionByName(table(spark, d, "documents").select(F.col("title").alias("wanted")))
    return L.direction_named(own, wanted).select("wanted", "slug")


@query(
    f"""SELECT slug, folder AS path, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') ELSE '' END AS parent, len(string_split(folder, '/')) AS depth, {_name('folder')} AS name, CAST(sum(n) AS BIGINT) AS files
    FROM (SELECT slug, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS folder, 1 AS n FROM {_FILES}
    UNION ALL SELECT slug, unnest(['новое', 'новое/' || slug]) AS folder, 0 AS n FROM directions) GROUP BY slug, folder"""
)
def folder_tree_with_empty(spark, d):
    """The folder tree with an empty folder made in every direction."""
    made = table(spark, d, "directions").select("slug", F.concat(F.lit("новое/"), "slug").alias("path"))
    return L.folders(_files(spark, d), made)


@query(
    """SELECT slug, title, created_at FROM directions WHERE slug NOT IN ('electro', 'osmos', 'novoe') UNION ALL SELECT 'electro', 'Заново', TIMESTAMP '2024-05-06 07:08:09'
    UNION ALL SELECT 'novoe', 'Новое', TIMESTAMP '2024-05-06 07:08:09'"""
)
def direction_changes(spark, d):
    """One direction made anew, one made as it is missing, one that is there left, one deleted."""
    from datetime import datetime

    at = datetime(2024, 5, 6, 7, 8, 9)
    own = L.create_direction(table(spark, d, "directions"), "electro", " Заново ", at)
    own = L.ensure_direction(L.ensure_direction(own, "electro", "Иначе", at), "novoe", "Новое", at)
    return L.delete_direction(own, "osmos")


@query(
    f"""SELECT slug, path FROM (SELECT slug, path || unnest(['', '.extracted.txt', '.extracted.meta.json', '.extracted.pages.json', '.library.json']) AS path, path AS own FROM {_FILES})
    WHERE NOT (ends_with(own, '.pdf') AND regexp_matches(path, '\\.extracted\\.(txt|meta\\.json|pages\\.json)$'))"""
)
def sidecars_removed(spark, d):
    """Every file with all that may be kept beside it, without the extractions of PDF files."""
    own = _files(spark, d).select("slug", "path")
    stored = own.select("slug", F.explode(F.array(F.col("path"), *[F.concat("path", F.lit(k)) for k in P.SIDECARS])).alias("path"))
    return L.without_sidecars(stored, own.filter(F.col("path").endswith(".pdf")), catalog=False)


@query(
    f"""SELECT slug, path, name, size, modified_at, content_type FROM (SELECT *, row_number() OVER (PARTITION BY slug, path ORDER BY modified_at DESC NULLS LAST, size DESC NULLS LAST, filename DESC) AS rn FROM (SELECT slug, 'вход/' || safe AS path, safe AS name, filename, CAST(size AS DOUBLE) AS size, modified_at,
    CASE WHEN ends_with(lower(filename), '.pdf') THEN 'application/pdf' WHEN ends_with(lower(filename), '.doc') THEN 'application/msword' WHEN ends_with(lower(filename), '.docx') THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    WHEN ends_with(lower(filename), '.jpeg') OR ends_with(lower(filename), '.jpg') THEN 'image/jpeg' WHEN ends_with(lower(filename), '.png') THEN 'image/png' WHEN ends_with(lower(filename), '.md') THEN 'text/markdown; charset=utf-8'
    WHEN ends_with(lower(filename), '.txt') THEN 'text/plain; charset=utf-8' ELSE 'application/octet-stream' END AS content_type FROM (SELECT slug, name AS filename, size, modified_at, {SQL.safe_name('name')} AS safe FROM library_files) WHERE safe IS NOT NULL)) WHERE rn = 1"""
)
def uploads(spark, d):
    """All deliveries of files sent to one folder of their direction: the last of a name holds."""
    sent = table(spark, d, "library_files").select("slug", F.lit(" вход ").alias("folder"), F.col("name").alias("filename"), "size", "modified_at")
    return L.uploaded(sent).select("slug", "path", "name", F.col("size").cast("double").alias("size"), "modified_at", "content_type")


@query(f"SELECT c.slug, c.path, coalesce(s.title, c.title) AS title, coalesce(s.doc_type, c.doc_type) AS doc_type FROM {_CATALOG} c LEFT JOIN (SELECT e.slug, e.path, e.name AS title, 'law' AS doc_type FROM extracted_documents e WHERE entry_id % 2 = 0) s USING (slug, path)")
def catalog_ensured(spark, d):
    """The catalog after missing entries are made, every other one being stored as a law."""
    files = _files(spark, d)
    own = K.infer(files)
    known = _docs(spark, d).filter("entry_id % 2 = 0").select("slug", "path", F.col("name").alias("stated"))
    stored = own.join(known, ["slug", "path"]).withColumns({"title": F.col("stated"), "doc_type": F.lit("law")}).drop("stated")
    return K.ensured(stored, files).select("slug", "path", "title", "doc_type")


@query("SELECT path, slug, name FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY modified_at DESC NULLS LAST, slug DESC, name DESC NULLS LAST) AS rn FROM library_files) WHERE rn = 1")
def files_by_path(spark, d):
    """One row for each path over all directions and deliveries: the last holds."""
    return K.by_path(table(spark, d, "library_files").select("path", "modified_at", "slug", "name"), "modified_at")


_EXTRACTED = "left(trim(regexp_replace(regexp_replace({c}, '" + _KEPT + "', '', 'g'), '[\\t\\n\\r ]+', ' ', 'g')), 120000)"


_KIND = "CASE entry_id % 3 WHEN 0 THEN 'plain-text' WHEN 1 THEN 'legacy-doc-fallback' ELSE 'mammoth' END"


@query(
    f"""SELECT entry_id, x AS extractor, nullif(t, '') AS text, coalesce(length(t), 0) AS chars, CASE WHEN nullif(t, '') IS NULL THEN 0.0 WHEN x = 'plain-text' THEN 1.0 WHEN x = 'mammoth' THEN 0.8 ELSE 0.35 END::DOUBLE AS confidence, CASE WHEN nullif(t, '') IS NULL THEN 'extract_no_text' END AS error
    FROM (SELECT entry_id, {_KIND} AS x, CASE WHEN entry_id % 3 = 1 THEN {_EXTRACTED.format(c="array_to_string(regexp_extract_all(text, '[ -~]{12,}'), ' ')")} ELSE {_EXTRACTED.format(c='text')} END AS t FROM extracted_documents)"""
)
def files_extracted(spark, d):
    """Texts written to plain, legacy and Word files, by turns, and read again."""

    def words(batches):
        import io
        import re
        import zipfile
        from xml.sax.saxutils import escape

        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                # a paragraph for each line; what XML can't hold is left out
                lines = re.sub("[^\t\n\r -\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", text or "").replace("\r", "\n").split("\n")
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
                    z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    own = _texts(spark, d)
    name = lambda ending: F.concat(F.col("entry_id").cast("string"), F.lit(ending)).alias("path")
    plain = own.filter("entry_id % 3 = 0").select(name(".txt"), F.col("text").cast("binary").alias("content"))
    legacy = own.filter("entry_id % 3 = 1").select(name(".doc"), F.col("text").cast("binary").alias("content"))
    word = own.filter("entry_id % 3 = 2").select(name(".docx"), "text").mapInArrow(words, "path string, content binary")
    done = E.extract(plain.unionByName(legacy).unionByName(word).select(F.lit("files").alias("slug"), "path", "content"))
    return done.select(F.substring_index("path", ".", 1).cast("long").alias("entry_id"), "extractor", "text", "chars", "confidence", "error")


def _as_pdf(spark, d):
    """Files that hold an entry's text as one text layer, its pages' texts as another, and the
    pages to be recognised; and tools that read them. Pages without text can't be recognised."""
    import json

    parts = F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    pages = _pages(spark, d).groupBy("entry_id").agg(parts.alias("pages"))
    own = _docs(spark, d).select("entry_id", "text").join(pages, "entry_id", "left").join(_meta(spark, d).select("entry_id", "source_pages"), "entry_id", "left")
    texts = F.transform("pages", lambda p: p["text"])
    layers = F.to_json(F.struct(F.col("text").alias("first"), F.array_join(texts, "\n").alias("second"), F.coalesce("source_pages", F.lit(0)).alias("n"), texts.alias("pages")))
    files = own.select(F.lit("files").alias("slug"), F.concat(F.col("entry_id").cast("string"), F.lit(".pdf")).alias("path"), layers.cast("binary").alias("content"))
    tools = E.Tools(
        layers=(("pdftotext", lambda b: json.loads(b).get("first")), ("pdf-parse", lambda b: json.loads(b).get("second"))),
        count=lambda b: json.loads(b)["n"],
        raster=lambda b, page, dpi, seconds: (json.loads(b).get("pages") or [])[page - 1 : page][0].encode() if page <= len(json.loads(b).get("pages") or []) else None,
        recognise=lambda picture, seconds, mode, spaces: picture.decode(),
    )
    return files, tools


_LAYERED = f"""(SELECT entry_id, layer, p, nullif({_EXTRACTED.format(c='text')}, '') AS text FROM (SELECT e.entry_id, 0 AS layer, e.text, coalesce(m.source_pages, 0) AS p FROM extracted_documents e LEFT JOIN {_META} m USING (entry_id)
  UNION ALL SELECT e.entry_id, 1 AS layer, t.text, coalesce(m.source_pages, 0) AS p FROM extracted_documents e LEFT JOIN {_META} m USING (entry_id) LEFT JOIN (SELECT entry_id, string_agg(coalesce(text, ''), chr(10) ORDER BY page NULLS FIRST, text NULLS FIRST) AS text FROM {_PAGES} GROUP BY entry_id) t USING (entry_id)))"""
_BEST = f"""(SELECT * FROM (SELECT entry_id, layer, p, text, {SQL.usable('p')} AS usable, {SQL.wanting('p')} AS wants, row_number() OVER (PARTITION BY entry_id ORDER BY coalesce(n + 3 * cyr + CASE WHEN {SQL.usable('p')} THEN 10000 ELSE 0 END, -1) DESC, layer) AS rn FROM {SQL.facts(_LAYERED, "entry_id, layer, p")}) WHERE rn = 1)"""
_READ = f"""(SELECT entry_id, string_agg(t, chr(10) || chr(10) ORDER BY k) AS text, count(*) AS pages FROM (SELECT entry_id, p.k, trim(regexp_replace(regexp_replace(p.text, '{_KEPT}', '', 'g'), '[\\t\\n\\r ]+', ' ', 'g')) AS t, coalesce(m.source_pages, 0) AS n
  FROM (SELECT entry_id, text, row_number() OVER (PARTITION BY entry_id ORDER BY page NULLS FIRST, coalesce(text, '')) AS k FROM {_PAGES}) p JOIN {_META} m USING (entry_id)) WHERE t <> '' AND k <= CASE WHEN n > 0 THEN least(n, 150) ELSE 150 END GROUP BY entry_id)"""


@query(
    f"""SELECT b.entry_id, CASE WHEN o.text IS NOT NULL THEN 'tesseract-ocr' WHEN b.wants AND b.text IS NULL THEN 'tesseract-ocr' WHEN b.layer = 0 OR b.text IS NULL THEN CASE WHEN b.text IS NULL THEN 'pdf-parse' ELSE 'pdftotext' END ELSE 'pdf-parse' END AS extractor,
    CASE WHEN coalesce(o.text, b.text) IS NULL THEN 0 WHEN o.text IS NOT NULL THEN 0.65 WHEN b.wants THEN 0.5 WHEN b.usable THEN 0.85 ELSE 0.75 END::DOUBLE AS confidence, coalesce(length(coalesce(o.text, b.text)), 0) AS chars, CAST(b.p AS INTEGER) AS source_pages, o.pages
    FROM {_BEST} b LEFT JOIN (SELECT entry_id, nullif({_EXTRACTED.format(c='text')}, '') AS text, pages FROM {_READ}) o ON o.entry_id = b.entry_id AND b.wants"""
)
def pdf_in_tiers(spark, d):
    """Every entry as a PDF with two text layers and pages to be recognised, read in tiers."""
    files, tools = _as_pdf(spark, d)
    done = E.pdf_tiers(spread(files), tools)
    return done.select(F.substring_index("path", ".", 1).cast("long").alias("entry_id"), "extractor", "confidence", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), "source_pages", F.when(F.col("pages").isNotNull(), F.size("pages")).cast("long").alias("pages"))


@query(
    f"""SELECT entry_id, CASE WHEN score >= 20 THEN text END AS text, round(score, 6) AS score FROM (SELECT entry_id, q.score, t.text, row_number() OVER (PARTITION BY entry_id ORDER BY q.score DESC, page_id) AS rn
    FROM (SELECT page_id, entry_id FROM {_PAGES}) JOIN (SELECT page_id, score FROM {SQL.PHOTO_SCORED}) q USING (page_id) JOIN ({SQL.PHOTO_TEXT}) t USING (page_id)) WHERE rn = 1"""
)
def photo_attempts(spark, d):
    """Each entry's pages read as attempts at one photo, a number of them in one round."""
    own = _pages(spark, d).select("entry_id", F.floor(F.col("page_id") / 4).cast("int").alias("round"), F.col("page_id").cast("int").alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    best = E.best_attempts(own, "entry_id")
    return best.select("entry_id", "text", F.round("score", 6).alias("score"))


@query(
    f"""SELECT entry_id, t AS text, CASE WHEN t IS NULL THEN false ELSE length(t) >= 25 AND (len(regexp_extract_all(t, '[А-Яа-яЁё]')) >= 15 OR length(t) >= 80) END AS usable
    FROM (SELECT entry_id, nullif(left({_trim("CASE WHEN entry_id % 2 = 0 THEN text ELSE array_to_string(regexp_extract_all(text, '[ -~]{8,}'), ' ') END")}, 12000), '') AS t FROM extracted_documents)"""
)
def attachments(spark, d):
    """Texts sent with questions as plain and legacy files, by turns."""
    own = _texts(spark, d).select(F.lit("files").alias("slug"), F.concat(F.col("entry_id").cast("string"), F.when(F.col("entry_id") % 2 == 0, ".md").otherwise(".doc")).alias("path"), F.col("text").cast("binary").alias("content"))
    return E.attachment_texts(own).select(F.substring_index("path", ".", 1).cast("long").alias("entry_id"), "text", "usable")


_ACTIVE = f"(SELECT slug, regexp_replace(path, '/[^/]*$', '') AS scope_path, path AS job_id, coalesce(modified_at, TIMESTAMP '0001-01-01') AS queued_at, CASE WHEN size < 0 OR has_text IS NULL THEN 'done' WHEN has_text THEN 'running' ELSE 'queued' END AS status FROM {_FILES})"


@query(f"SELECT slug, scope_path, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY slug, scope_path ORDER BY queued_at, job_id) AS rn FROM {_ACTIVE} WHERE status <> 'done') WHERE rn = 1")
def first_active_jobs(spark, d):
    """Files read as jobs of their folder: the first active one of each."""
    status = F.when(F.col("size").isNull(), "done").when(F.coalesce("has_text", F.lit(False)), "running").otherwise("queued")
    own = _files(spark, d).select("slug", F.regexp_replace("path", "/[^/]*$", "").alias("scope_path"), F.col("path").alias("job_id"), F.coalesce("modified_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("queued_at"), status.alias("status"))
    return Jobs.first_active(own).select("slug", "scope_path", "job_id", "status")


@query(f"SELECT * FROM {_FOLD} WHERE job_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def followed_jobs(spark, d):
    """Jobs of users with an error, read as the jobs that are followed."""
    refs = table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("job_id"))
    return Jobs.followed(refs, Jobs.fold(_jobs(spark, d)))


@query(f"SELECT job_id, status FROM {_FOLD} WHERE status IN ('running', 'queued') OR epoch_ms((SELECT max(ts) FROM events)) - epoch_ms(ended_at) < 2592000000")
def jobs_still_shown(spark, d):
    """Jobs to show when the last event came in, ended ones for thirty days."""
    last = table(spark, d, "events").agg(F.unix_millis(F.max("ts").cast("timestamp")).alias("now"))
    jobs = Jobs.fold(_jobs(spark, d)).withColumn("one", F.lit(1)).join(last.withColumn("one", F.lit(1)), "one")
    return Jobs.still_shown(jobs, F.col("now"), 2_592_000_000).select("job_id", "status")


@query("SELECT user_id AS job_id, CAST(max_by(event_id % 40, (ts, event_id)) AS INTEGER) AS ocr_page, CAST(max_by(event_id % 41, (ts, event_id)) AS INTEGER) AS ocr_page_total FROM events WHERE event_id % 41 > 0 GROUP BY user_id")
def page_progress(spark, d):
    """Events read as reports of pages."""
    own = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), "event_id", (F.col("event_id") % 40).cast("int").alias("page"), (F.col("event_id") % 41).cast("int").alias("total"))
    return Jobs.page_progress(own)


@query(
    """SELECT user_id AS user, max(ts) AS "at", max_by(event_type, (ts, event_type)) AS query FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, part"""
)
def settled_queries(spark, d):
    """Events read as what users typed, with pauses of six hours."""
    own = table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("ts").alias("at"), F.col("event_type").alias("query"))
    return Jobs.settled_queries(own, "6 hours")


_CHAT = "(SELECT user_id AS chat, (ts, event_id) AS t, CASE event_type WHEN 'signup' THEN 'direction' WHEN 'click' THEN 'folder' WHEN 'view' THEN 'mode' WHEN 'purchase' THEN 'question' ELSE 'answered' END AS kind, 'v' || event_id AS v FROM events)"


@query(
    f"""SELECT chat, coalesce(max_by(v, t) FILTER (kind = 'direction'), '') AS slug, CASE WHEN max_by(kind, t) FILTER (kind IN ('direction', 'folder')) = 'folder' THEN max_by(v, t) FILTER (kind IN ('direction', 'folder')) ELSE '' END AS scope_path,
    CASE WHEN max_by(kind, t) FILTER (kind IN ('direction', 'mode')) = 'mode' THEN max_by(v, t) FILTER (kind IN ('direction', 'mode')) ELSE 'none' END AS mode,
    CASE WHEN max_by(kind, t) FILTER (kind <> 'mode') = 'question' THEN max_by(v, t) FILTER (kind <> 'mode') END AS pending FROM {_CHAT} GROUP BY chat"""
)
def chat_sessions(spark, d):
    """Events read as those of chats: each chat's session at the end."""
    kinds = F.create_map(*[F.lit(x) for p in (("signup", "direction"), ("click", "folder"), ("view", "mode"), ("purchase", "question"), ("error", "answered")) for x in p])
    own = table(spark, d, "events").select(F.col("user_id").alias("chat"), F.col("ts").alias("at"), "event_id", F.element_at(kinds, F.col("event_type")).alias("kind"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"))
    return A.sessions(own).select("chat", "slug", "scope_path", "mode", "pending")


@query(f"SELECT slug, CAST(count_if(CASE WHEN has_text THEN true ELSE folder = 'gost' OR path = 'gost/x.pdf' END) AS BIGINT) AS concerned FROM (SELECT slug, path, coalesce(has_text, false) AND path = 'gost/x.pdf' AS has_text, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder FROM {_FILES}) GROUP BY slug")
def jobs_of_file(spark, d):
    """Files read as batches of their folders that wait: how many concern a file of 'gost'."""
    own = _files(spark, d).select("slug", F.concat(P.parent(F.col("path")), F.lit("@batch-1")).alias("scope"))
    hit = J.affects(F.lit("queued"), F.col("scope"), F.lit(None).cast("string"), F.lit("gost/x.pdf"))
    return own.groupBy("slug").agg(F.count_if(hit).alias("concerned"))


@query("SELECT slug, CASE WHEN slug = 'electro' THEN 'Новое имя' ELSE title END AS title FROM directions")
def direction_retitled(spark, d):
    return L.retitle(table(spark, d, "directions"), "electro", " Новое имя ").select("slug", "title")


@query(f"SELECT slug, path FROM {_FILES} WHERE NOT (slug = 'electro' AND path = (SELECT min(path) FROM library_files WHERE slug = 'electro'))")
def file_deleted(spark, d):
    """All files but the first one of a direction."""
    own = _files(spark, d)
    first = own.filter("slug = 'electro'").agg(F.min("path")).first()[0]
    return L.delete_file(own, "electro", first or "none").select("slug", "path")


@query(
    f"""SELECT slug, path, CASE WHEN one THEN 'Иначе' ELSE title END AS title, CASE WHEN one THEN 'law' ELSE doc_type END AS doc_type, {_PRIORITY} AS priority
    FROM (SELECT *, slug = 'electro' AND path = (SELECT min(path) FROM {_CATALOG} WHERE slug = 'electro') AS one FROM {_CATALOG})"""
)
def catalog_put(spark, d):
    """The catalog with one entry's type and title set; what followed from its type stays."""
    own = K.infer(_files(spark, d))
    first = own.filter("slug = 'electro'").agg(F.min("path")).first()[0]
    return K.set_type(own, "electro", first or "none", "law", "Иначе").select("slug", "path", "title", "doc_type", "priority")


@query(f"SELECT slug, path FROM {_CATALOG} WHERE lower({_name()}) = 'гост' OR list_contains(string_split({_ALIASES}, '|'), 'гост')")
def catalog_by_alias(spark, d):
    return K.by_alias(K.infer(_files(spark, d)), " ГОСТ ").select("slug", "path")


@query("SELECT doc_id, coalesce(doc_type IN ('classifier', 'law', 'standard', 'tkp', 'regulation', 'instruction', 'other'), false) AS valid FROM documents")
def valid_types(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(C.valid_type(F.col("doc_type")), F.lit(False)).alias("valid"))


_SHOWN, _POLLED = "(SELECT user_id AS job_id, max(ts) AS updated_at, 'shown' AS status FROM events WHERE event_id % 3 > 0 GROUP BY user_id)", "(SELECT user_id AS job_id, max(ts) AS updated_at, 'polled' AS status FROM events WHERE event_id % 2 = 0 GROUP BY user_id)"


@query(f"SELECT job_id, max(updated_at) AS updated_at, max_by(status, (updated_at, status)) AS status FROM (SELECT * FROM {_SHOWN} UNION ALL SELECT * FROM {_POLLED}) GROUP BY job_id")
def jobs_merged(spark, d):
    """Two lists of jobs, each from a part of the events, as one with the newest state of each."""
    part = lambda which, status: table(spark, d, "events").filter(which).groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("updated_at")).withColumn("status", F.lit(status))
    return Jobs.merged(part("event_id % 3 > 0", "shown"), part("event_id % 2 = 0", "polled"))


def _folder_jobs(spark, d):
    status = F.when(F.col("size").isNull(), "done").when(F.coalesce("has_text", F.lit(False)), "running").otherwise("queued")
    return _files(spark, d).select("slug", P.parent(F.col("path")).alias("scope_path"), F.col("path").alias("job_id"), status.alias("status"), F.when(status == "running", F.col("path")).alias("current_file"), F.when(status == "queued", F.length("path")).alias("queue_position"))


_PARENT = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
_FOLDER_JOBS = f"(SELECT slug, {_PARENT} AS scope_path, path AS job_id, CASE WHEN size < 0 THEN 'done' WHEN has_text THEN 'running' ELSE 'queued' END AS status FROM {_FILES})"


@query(f"SELECT slug, scope_path FROM (SELECT DISTINCT slug, unnest([{_PARENT}, 'свободно']) AS scope_path FROM {_FILES}) WHERE (slug, scope_path) NOT IN (SELECT (slug, scope_path) FROM {_FOLDER_JOBS} WHERE status <> 'done')")
def requests_accepted(spark, d):
    """Requests to index every folder, and one more of each direction, without those that a job is at work on."""
    asked = _files(spark, d).select("slug", F.explode(F.array(P.parent(F.col("path")), F.lit("свободно"))).alias("scope_path")).distinct()
    return Jobs.accepted(_folder_jobs(spark, d), asked)


@query(
    f"""SELECT slug, job_id, row_number() OVER (ORDER BY CASE WHEN status = 'queued' THEN length(job_id) ELSE 999 END, job_id, slug) AS place FROM {_FOLDER_JOBS}
    WHERE status <> 'done' AND CASE WHEN status = 'running' THEN starts_with(job_id, 'gost/') ELSE scope_path = 'gost' OR starts_with(scope_path, 'gost@batch') OR starts_with(scope_path, 'gost/') OR starts_with('gost', scope_path || '/') END"""
)
def jobs_listed(spark, d):
    """Active jobs of interest in a folder, with their places."""
    own = Jobs.listed(_folder_jobs(spark, d), "gost").select("slug", "job_id", F.coalesce("queue_position", F.lit(999)).alias("q"))
    return L.with_place(own, "q", "job_id", "slug").select("slug", "job_id", "place")


# --- files on disk ----------------------------------------------------------------------


def _written(spark, d) -> str:
    """A library on disk with all entries' sidecars, in the shared folder."""
    import uuid

    root = shared_folder(spark).removeprefix("file://") + f"/library-{uuid.uuid4().hex[:12]}"
    pages = _pages(spark, d).groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text")))).alias("pages"))
    own = _docs(spark, d).select("entry_id", "slug", "path", "text").join(_meta(spark, d).drop("slug", "path"), "entry_id", "left").join(pages, "entry_id", "left")
    Tr.write_sidecars(spread(own.withColumn("extracted_at", F.lit("2024-01-01"))), root)
    return root


@query(f"SELECT slug, path, {_name()} AS name, left({_trim('text')}, 120000) AS text FROM extracted_documents WHERE length({_trim('text')}) > 0")
def stored_texts(spark, d):
    """Texts written beside their files and read back from the tree."""
    return Tr.texts(spark, _written(spark, d))


@query(f"SELECT e.slug, e.path, m.extractor, m.confidence, m.chars, m.source_pages, m.indexed_pages, m.index_status, m.index_note FROM extracted_documents e JOIN {_META} m USING (entry_id) WHERE length(e.text) > 0 AND m.extractor IS NOT NULL")
def stored_extractions(spark, d):
    return Tr.metas(spark, _written(spark, d)).drop("source_document", "extracted_at")


@query(f"SELECT e.slug, e.path, p.page, coalesce(p.text, '') AS text FROM extracted_documents e JOIN {_PAGES} p USING (entry_id) WHERE length(e.text) > 0")
def stored_pages(spark, d):
    return Tr.pages(spark, _written(spark, d))
