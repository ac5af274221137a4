"""Values of requests and settings: lists, limits, labels, as column expressions or checked on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.paths import check_slug, scope_of
from scriptorium.functions.text import trim

#: (least, most, where none is given) characters of a context and of an extracted text.
CONTEXT_CHARS, EXTRACTED_CHARS = (2_000, 120_000, 20_000), (1_000, 200_000, 120_000)


def listed(c: Column) -> Column:
    """Values of a list with commas, trimmed, without blank ones; null counts as blank."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), trim), lambda x: x != "")


def number(c: Column) -> Column:
    """The whole number that a text begins with, null if it begins with none."""
    return F.try_to_number(F.nullif(F.regexp_extract(trim(c), r"^([+-]?[0-9]{1,15})", 1), F.lit("")), F.lit("S999999999999999")).cast("long")


def limited(c: Column, bounds: tuple[int, int, int]) -> Column:
    """A number of characters as asked for, within bounds."""
    least, most, usual = bounds
    n = number(c)
    return F.when(n.isNull(), usual).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), n))).cast("int")


def session_label(slug: Column, title: Column, scope: Column) -> Column:
    """What a session is about, for its user."""
    name = F.coalesce(F.nullif(title, F.lit("")), slug)
    folder = F.concat(name, F.lit(" → "), F.substring_index(scope, "/", -1))
    return F.when(F.coalesce(slug, F.lit("")) == "", "направление не выбрано").when(F.coalesce(scope, F.lit("")) == "", F.concat(name, F.lit(" (все папки)"))).otherwise(folder)


@dataclass(frozen=True)
class Settings:
    """Limits of a library, with the values that hold where none are set."""

    max_file_mb: int = 200
    upload_max_files: int = 20
    ocr_max_pages: int = 150
    ocr_timeout_sec: int = 900
    ocr_dpi: int = 150
    ocr_max_concurrent: int = 1
    index_max_concurrent: int = 2
    default_slug: str | None = None
    default_scope: str = ""

    @classmethod
    def of(cls, values: Mapping[str, str]) -> Settings:
        """Settings from texts by the names of the fields; blank texts count as none. Numbers
        must be whole and positive, a slug valid; a scope that isn't valid is the whole library."""
        out: dict = {}
        for f in fields(cls):
            given = str(values.get(f.name) or "").strip()
            if not given:
                continue
            if f.name == "default_slug":
                out[f.name] = check_slug(given)
            elif f.name == "default_scope":
                out[f.name] = scope_of(given)
            else:
                if not given.isdecimal() or int(given) < 1:
                    raise ValueError(f"invalid_{f.name}")
                out[f.name] = int(given)
        return cls(**out)
