"""What a file's name tells about a document, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.paths import base_name
from scriptorium.functions.text import trim

#: A word boundary between ASCII word characters and anything else.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Document types in the order they are tried (pattern on the lower-case name; the
# letters p and d in окpd and ткp are Latin), with priority, further aliases and topics.
TYPES = {
    "classifier": ("классиф|classif|okof|окоф|окpd", 5, ["классификатор"], ["код", "классификатор", "номенклатура"]),
    "law": ("^fz|фз|закон|kodex|кодекс", 10, ["закон"], ["закон", "норма", "требование", "ответственность"]),
    "standard": (rf"gost|гост|{_EDGE}sp[\s_-]|{_EDGE}сп[\s_-]", 8, ["гост", "сп"], ["стандарт", "гост", "сп", "технические требования"]),
    "tkp": ("tkp|ткp|typov", 7, ["ткp"], ["типовой проект", "ткp", "проектирование"]),
    "regulation": ("prikaz|приказ|postanov|постанов|pravil|правил|reglament|регламент", 9, ["правила"], ["правила", "приказ", "регламент", "порядок"]),
    "instruction": ("инструк|instruction", 6, ["инструкция"], ["инструкция", "процедура", "безопасность"]),
    "other": ("", 1, [], []),
}

FIELDS = ("doc_id", "path", "title", "doc_type", "topics", "aliases", "references", "sections_hint", "priority")


def _by_type(kind: Column, value) -> Column:
    return F.element_at(F.create_map(*[x for name, row in TYPES.items() for x in (F.lit(name), value(row))]), kind)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def doc_type(path: Column) -> Column:
    """The type a name suggests; the first that fits, else 'other'."""
    name, out = F.lower(base_name(path)), None
    for kind, (pattern, *_) in TYPES.items():
        if pattern:
            out = F.when(name.rlike(pattern), kind) if out is None else out.when(name.rlike(pattern), kind)
    return out.otherwise("other")


def valid_type(c: Column) -> Column:
    return c.isin(*TYPES)


def priority(kind: Column) -> Column:
    return _by_type(kind, lambda row: F.lit(row[1]))


def topics(kind: Column) -> Column:
    return _by_type(kind, lambda row: _strings(row[3]))


def aliases(path: Column, kind: Column) -> Column:
    return F.array_distinct(F.concat(F.array(base_name(path)), _by_type(kind, lambda row: _strings(row[2]))))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def doc_id(path: Column) -> Column:
    """ASCII letters and digits of the name, joined by hyphens; empty for names without any."""
    name = F.regexp_replace(F.lower(without_extension(base_name(path))), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(name, "^-+|-+$", ""), 1, 80)


def inferred(path: Column, kind: Column | None = None) -> dict[str, Column]:
    """All fields of the catalog entry that a path suggests; ``kind`` where its type is known."""
    own = F.replace(path, F.lit("\\"), F.lit("/"))
    kind = doc_type(own) if kind is None else kind
    return {
        "doc_id": doc_id(own),
        "path": own,
        "title": without_extension(base_name(own)),
        "doc_type": kind,
        "topics": topics(kind),
        "aliases": aliases(own, kind),
        "references": _strings([]),
        "sections_hint": F.create_map().cast("map<string,string>"),
        "priority": priority(kind),
    }


def _filled(stored: Column, own: Column) -> Column:
    return F.coalesce(F.nullif(trim(stored), F.lit("")), own)


def merged(own: dict[str, Column], stored: dict[str, Column]) -> dict[str, Column]:
    """A stored entry over an inferred one: filled texts and lists win, aliases and
    references are joined, hints of the stored entry overwrite."""
    joined = lambda f: F.when(F.size(stored[f]) > 0, F.array_union(own[f], stored[f])).otherwise(own[f])
    hints = F.map_concat(F.map_filter(own["sections_hint"], lambda k, v: ~F.coalesce(F.map_contains_key(stored["sections_hint"], k), F.lit(False))), F.coalesce(stored["sections_hint"], F.create_map().cast("map<string,string>")))
    return {
        "doc_id": _filled(stored["doc_id"], own["doc_id"]),
        "path": own["path"],
        "title": _filled(stored["title"], own["title"]),
        "doc_type": F.coalesce(stored["doc_type"], own["doc_type"]),
        "topics": F.when(F.size(stored["topics"]) > 0, stored["topics"]).otherwise(own["topics"]),
        "aliases": joined("aliases"),
        "references": joined("references"),
        "sections_hint": hints,
        "priority": F.coalesce(stored["priority"], own["priority"]),
    }


def matches_path(path: Column, wanted: Column) -> Column:
    """Whether a filter names a document: its path, its name, or its name in any case."""
    name, wanted = base_name(path), F.replace(wanted, F.lit("\\"), F.lit("/"))
    return (path == wanted) | (F.lower(name) == F.lower(wanted))


def matches_alias(own: Column, alias: Column) -> Column:
    needle = F.lower(trim(alias))
    return (needle != "") & F.exists(own, lambda a: F.lower(a) == needle)
