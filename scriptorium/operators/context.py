"""Contexts for questions: the best pages or windows of a document within a number of characters.

Budgets that stop at the first overflow are running sums over the pages of an entry, which
share one partitioning; windows of a text are folds within its row. The packing that skips
and goes on is a fold over the at most 112 pages that were chosen by their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.quality import contents_heavy
from scriptorium.session import spread

KEYS = ["slug", "entry_id"]
GAP, RADIUS = 200, 2200
HITS = 12


def _block(page: Column, text: Column) -> Column:
    return F.concat(F.lit("[стр. "), page.cast("string"), F.lit("]\n"), T.trim(text))


def scored(pages: DataFrame, asked: list[str], factor: float = 0.12) -> DataFrame:
    """Pages with their score: occurrences of the terms, much less for tables of contents.
    Null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = pages.select(*KEYS, "page", text.alias("text"), contents_heavy(text, 1).alias("contents"), T.let(T.normalized(text), lambda t: T.occurrences(t, asked)).alias("hits"))
    score = F.col("hits") * F.when(F.col("contents"), factor).otherwise(1.0)
    return own.select(*KEYS, "page", score.cast("double").alias("score"), "contents", _block(F.col("page"), F.col("text")).alias("block"))


def _joined(blocks: DataFrame, order: Column, most: int, name: str = "context", taken: Column | None = None) -> list[Column]:
    """The blocks of a group that are ``taken``, in order, as one text, and their number."""
    one = F.struct(order.alias("o"), "block")
    own = F.collect_list(one if taken is None else F.when(taken, one))
    text = F.array_join(F.transform(F.sort_array(own), lambda x: x["block"]), "\n\n")
    return [F.substring(text, 1, most).alias(name), F.size(own).cast("long").alias("blocks" if taken is None else name + "_blocks")]


def _until(order: Column) -> Column:
    return order.rowsBetween(W.unboundedPreceding, -1)


def _by_score(own: DataFrame, most: int) -> DataFrame:
    """Scored pages with ``rank`` and whether they are ``near``: the best until one doesn't fit."""
    order = W.partitionBy(*KEYS).orderBy(F.desc("score"), "page", "block")
    hit = F.col("score") > 0
    own = own.withColumn("rank", F.row_number().over(order)).withColumn("used", F.coalesce(F.sum(F.length("block") + 2).over(_until(order)), F.lit(0)))
    over = ~hit | (F.col("used") >= most) | ((F.col("rank") > 1) & (F.col("used") + F.length("block") > most))
    return own.withColumn("near", ~F.max(over).over(order.rowsBetween(W.unboundedPreceding, 0)))


def _evenly(own: DataFrame, most: int) -> DataFrame:
    """Pages and whether they are ``even``: taken evenly from each entry while they last."""
    all_ = W.partitionBy(*KEYS)
    order = all_.orderBy("page", "block")
    body = ~F.col("contents") | (F.col("page") > 4)
    own = own.withColumn("kept", (F.count_if(body).over(all_) < 5) | body)
    own = own.withColumn("n", F.count_if(F.col("kept")).over(all_)).withColumn("rn", F.coalesce(F.count_if(F.col("kept")).over(_until(order)), F.lit(0)))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 12))
    own = own.withColumn("even", F.col("kept") & (F.col("rn") % step == 0) & (F.col("rn") / step < 16))
    used = F.coalesce(F.sum(F.when(F.col("even"), F.length("block") + 2)).over(_until(order)), F.lit(0))
    return own.withColumn("even", F.col("even") & (used < most))


def narrow(pages: DataFrame, asked: list[str], most: int) -> DataFrame:
    """(slug, entry_id, context, blocks): the best-scored pages of each entry, in that order,
    until one doesn't fit; the first is taken in any case and cut. Entries none of whose
    pages scores have no row here, see ``spread_out``."""
    kept = _by_score(scored(pages, asked).filter("score > 0"), most).filter("near")
    return kept.groupBy(*KEYS).agg(*_joined(kept, F.col("rank"), most))


def spread_out(pages: DataFrame, most: int) -> DataFrame:
    """(slug, entry_id, context, blocks): pages taken evenly from each entry, at most 16.

    Tables of contents among the first four pages are left out where five others remain.
    """
    kept = _evenly(scored(pages, []), most).filter("even")
    return kept.groupBy(*KEYS).agg(*_joined(kept, F.col("page"), most))


def _near_or_even(pages: DataFrame, asked: list[str], most: int) -> DataFrame:
    """(slug, entry_id, context, builder) of every entry with pages: ``narrow``, and where no page
    scores ``spread_out``, by one shuffle of the pages."""
    own = _evenly(_by_score(scored(pages, asked), most), most).filter("near or even")
    near, even = _joined(own, F.col("rank"), most, "by_score", F.col("near")), _joined(own, F.col("page"), most, "evenly", F.col("even"))
    both = own.groupBy(*KEYS).agg(*near, *even)
    hit = F.col("by_score_blocks") > 0
    return both.select(*KEYS, F.when(hit, F.col("by_score")).otherwise(F.col("evenly")).alias("context"), F.when(hit, "narrow").otherwise("spread").alias("builder"))


def wide(pages: DataFrame, asked: list[str], most: int) -> DataFrame:
    """(slug, entry_id, context, blocks): the best pages with their neighbours, filled up in
    page order to 40, packed in page order; a page that doesn't fit is skipped.

    The choice depends on what was chosen before, so it is a fold, over the pages' numbers and
    scores only; the texts of the chosen pages are joined to it.
    """
    pages = scored(pages, asked, 0.08)
    own = pages.groupBy(*KEYS).agg(F.collect_list(F.struct("score", "page", "contents")).alias("p"))
    by_score = F.transform(F.array_sort(F.transform("p", lambda x: F.struct((-x["score"]).alias("o"), x["page"].alias("page"), x["score"].alias("score")))), lambda x: x)
    start = F.array().cast("array<int>")

    def pick(chosen, x):
        near = F.when(x["score"] > 0, F.array(x["page"], x["page"] - 1, x["page"] + 1)).otherwise(F.array(x["page"]))
        full = (F.size(chosen) >= 24) | ((x["score"] <= 0) & (F.size(chosen) >= 8))
        return F.when(full, chosen).otherwise(F.array_union(chosen, near))

    fill = lambda chosen, x: F.when((F.size(chosen) < 40) & (~x["contents"] | (x["page"] > 5)), F.array_union(chosen, F.array(x["page"]))).otherwise(chosen)
    by_page = F.array_sort(F.transform("p", lambda x: F.struct(x["page"].alias("page"), x["contents"].alias("contents"))))
    own = own.withColumn("chosen", F.aggregate(by_score, start, pick))
    own = own.withColumn("chosen", F.aggregate(by_page, F.col("chosen"), fill)).select(*KEYS, "chosen")
    none = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("blocks"))

    def pack(s, x):
        fits = (s["used"] < most) & ((s["used"] + F.length(x["block"]) <= most) | (F.size(s["blocks"]) == 0))
        return F.when(fits, F.struct((s["used"] + F.length(x["block"]) + 2).alias("used"), F.concat(s["blocks"], F.array(x["block"])).alias("blocks"))).otherwise(s)

    ordered = pages.join(own, KEYS).filter(F.array_contains("chosen", F.col("page"))).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("page", "block"))).alias("p"))
    packed = ordered.withColumn("s", F.aggregate("p", none, pack))
    return packed.select(*KEYS, F.substring(F.array_join("s.blocks", "\n\n"), 1, most).alias("context"), F.size("s.blocks").cast("long").alias("blocks"))


def _placed(size: int):
    """A fold from the sizes of what lies between occurrences to the occurrences' offsets."""
    return lambda s, n: F.struct((s["at"] + n + size).alias("at"), F.concat(s["all"], F.array(s["at"] + n)).alias("all"))


def _spots(normal: Column, asked: list[str]) -> Column:
    """Offsets of all terms in a normalised text, in order."""
    out = []
    for t in asked:
        parts = F.split(normal, "\\Q" + t + "\\E", -1)
        sizes = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.length)
        out.append(F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), _placed(len(t)))["all"])
    return F.array_sort(F.concat(*out)) if out else F.array().cast("array<int>")


def islands(text: Column, asked: list[str]) -> Column:
    """Stretches (begin, finish) around the terms' occurrences in a text, joined where at most
    200 characters lie between them; a fold over the offsets in order."""
    one = lambda a, b: F.struct(a.alias("begin"), b.alias("finish"))
    size = F.length(text)

    def grow(s, at):
        begin, finish = F.greatest(F.lit(0), at - RADIUS), F.least(size, at + RADIUS)
        last = F.element_at(s, -1)
        joins = (F.size(s) > 0) & (begin <= F.try_element_at(s, F.lit(-1))["finish"] + GAP)
        return F.when(joins, F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(one(last["begin"], finish)))).otherwise(F.concat(s, F.array(one(begin, finish))))

    none = F.array().cast("array<struct<begin:int,finish:int>>")
    return F.aggregate(T.let(T.normalized(text), lambda t: _spots(t, asked)), none, grow)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(*KEYS, T.trim(F.col("text")).alias("text")).filter(F.length("text") > 0)


def windows(documents: DataFrame, asked: list[str]) -> DataFrame:
    """(slug, entry_id, begin, finish): stretches around the terms' occurrences, joined where at
    most 200 characters lie between them."""
    return spread(_texts(documents)).select(*KEYS, F.explode(islands(F.col("text"), asked)).alias("i")).select(*KEYS, "i.begin", "i.finish")


def _window_blocks(text: Column, asked: list[str], most: int) -> Column:
    """The windows of a text from its start on, with ellipses, while the characters last."""
    piece = lambda i: F.struct(i["begin"].alias("begin"), i["finish"].alias("finish"), T.trim(F.substring(text, i["begin"] + 1, i["finish"] - i["begin"])).alias("chunk"))
    pieces = F.filter(F.transform(islands(text, asked), piece), lambda x: F.length(x["chunk"]) > 0)
    none = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("blocks"))

    def pack(s, x):
        block = F.concat(F.when(x["begin"] > 0, "... ").otherwise(""), x["chunk"], F.when(x["finish"] < F.length(text), " ...").otherwise(""))
        return F.when(s["used"] < most, F.struct((s["used"] + F.length(x["chunk"]) + 2).alias("used"), F.concat(s["blocks"], F.array(block)).alias("blocks"))).otherwise(s)

    return F.aggregate(pieces, none, pack)["blocks"]


def windowed(documents: DataFrame, asked: list[str], most: int) -> DataFrame:
    """(slug, entry_id, context, blocks): the windows of each entry from the start on, with
    ellipses, while the characters last; the beginning of the text where nothing hits."""
    own = spread(_texts(documents)).select(*KEYS, "text", _window_blocks(F.col("text"), asked, most).alias("b"))
    return own.select(*KEYS, F.when(F.size("b") > 0, F.substring(F.array_join("b", "\n\n"), 1, most)).otherwise(F.substring("text", 1, most)).alias("context"), F.size("b").cast("long").alias("blocks"))


def build(documents: DataFrame, pages: DataFrame, query: str, most: int, boost: list[str] = (), prefer_wide: bool = False) -> DataFrame:
    """(slug, entry_id, context, builder) of every document with text.

    A text that fits and has no pages stands as a whole; pages are packed wide or narrow,
    with an even choice where no page scores; texts without pages give their beginning or
    windows. Null and blank texts have no row.
    """
    asked = T.boosted_terms(query, [*boost, *T.section_terms(query)])
    if prefer_wide:
        by_pages = wide(pages, asked, most).select(*KEYS, "context", F.lit("wide").alias("builder"))
    else:
        by_pages = _near_or_even(pages, asked, most)
    own = _texts(documents).join(by_pages, KEYS, "left")
    text, fits, paged = F.col("text"), F.length("text") <= most, F.col("builder").isNotNull()
    head = F.substring(text, 1, most)
    if prefer_wide or not asked:
        rest, how = head, F.lit("head")
    else:
        # only long texts without pages are searched for windows
        blocks = F.when(~paged & ~fits, _window_blocks(text, asked, most))
        own, how = own.withColumn("b", blocks), F.lit("windows")
        rest = F.when(F.size("b") > 0, F.substring(F.array_join("b", "\n\n"), 1, most)).otherwise(head)
    context = F.when(paged, F.col("context")).when(fits, text).otherwise(rest)
    return own.select(*KEYS, context.alias("context"), F.when(paged, F.col("builder")).when(fits, "whole").otherwise(how).alias("builder"))


def width(option: bool | None, scope_files: int, hits: int) -> bool:
    """Whether to build wide contexts: as asked, else for small scopes and few hits."""
    return option if option is not None else 0 < scope_files <= 3 or hits <= 2


def noted(context: Column, status: Column, note: Column) -> Column:
    """A context with a remark where the index is incomplete."""
    return F.when((status == "partial") & (F.length(note) > 0), F.concat(F.lit("[Индекс неполный: "), note, F.lit("]\n\n"), context)).otherwise(context)


def for_query(documents: DataFrame, files: DataFrame, pages: DataFrame, meta: DataFrame, query: str, *, scope: str = "", folders: list[str] = (), wanted: list[str] = (), types: list[str] = (), boost: list[str] = (), most: int = 20_000, limit: int = 4, prefer_wide: bool | None = None) -> DataFrame:
    """(rank, slug, path, name, text, extractor, confidence): contexts of the documents that
    answer a query.

    Hits are limited to twelve before folders, types, names and scope filter them; without
    any left, all files of the scope stand in. Documents without text drop out after the
    limit. ``meta`` has (slug, path, extractor, confidence, index_status, index_note). The
    search runs once, when the frame is built: its at most twelve rows come to the driver,
    and only the documents and pages they name are read after that.
    """
    from scriptorium.operators import catalog as K
    from scriptorium.operators import search as S
    from scriptorium.operators.library import indexable_files

    spark = documents.sparkSession
    hits = None
    if wanted:
        routes = K.routed(K.infer(files, scope), spark.createDataFrame([(w,) for w in wanted], "wanted string"))
        if not routes.isEmpty():
            hits = S.routed_search(documents, routes, meta, query, HITS)
    hits = hits if hits is not None else S.search(documents, files, query, HITS)
    found = spark.createDataFrame(hits.collect(), S.HITS)
    found = S.named(S.of_types(S.in_folders(found, list(folders)), K.infer(files, scope), list(types)), list(wanted))
    in_scope, order = 0, [F.desc("score"), F.collate("name", "ru"), "path", "slug"]
    if scope:
        found = S.in_scope(found, scope)
        inside = indexable_files(files, scope)
        in_scope = inside.limit(4).count()
    few = found.orderBy(*order).collect()
    if scope and not few:
        # files that stand in for missing hits come in the order of their paths
        order = [F.collate("path", "ru"), "slug"]
        few = S.with_fallback(found, inside).orderBy(*order).limit(HITS).collect()
    use_wide = width(prefer_wide, in_scope, len(few))
    most, limit = (max(most, 80_000), min(limit, 2)) if use_wide else (most, limit)
    kept = few[:limit]
    ranked = F.broadcast(spark.createDataFrame([(r.slug, r.path, k) for k, r in enumerate(kept, 1)], "slug string, path string, rank int"))
    chosen = documents.filter(F.col("path").isin([r.path for r in kept])).join(ranked, ["slug", "path"])
    text = chosen.withColumn("text", F.substring(T.trim(F.col("text")), 1, 120_000))
    ids = [r.entry_id for r in chosen.select("entry_id").distinct().limit(4 * HITS).collect()]
    built = build(text, pages.filter(F.col("entry_id").isin(ids)), query, most, list(boost), use_wide)
    state = meta.filter(F.col("path").isin([r.path for r in kept])).select("slug", "path", "extractor", "confidence", "index_status", "index_note")
    out = chosen.select(*KEYS, "path", "rank").join(built, KEYS).join(state, ["slug", "path"], "left")
    return out.select("rank", "slug", "path", F.substring_index("path", "/", -1).alias("name"), noted(F.col("context"), F.col("index_status"), F.col("index_note")).alias("text"), "extractor", "confidence")
